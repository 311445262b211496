"""SNK-11: the ownership graph as stored tables: edges from both ends and
nodes with their degree, in folders by month (edges) and node bucket, sorted by
node. A request for a few nodes reads their buckets only: the join on (bucket,
node) prunes the folders at run time. A new graph is written beside the served
one and takes its place when both tables are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import adjacency, node_table, search_nodes
from tessera.sources.stored import StoredTable

BUCKETS = 64
_EDGES = "node string, nbr string, type string, src string, dst string, reference_month string, bucket int"
_NODES = "node string, kind string, key string, label string, degree long, bucket int"


class GraphStore(StoredTable):
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root, ("edges", "nodes"))
        self.buckets = buckets

    def ready(self) -> bool:
        return self.path() is not None

    def _bucket(self):
        return F.pmod(F.xxhash64("node"), F.lit(self.buckets)).cast("int")

    def write(self, edges: DataFrame, companies: DataFrame, people: DataFrame) -> str:
        path = self.next_path()

        def put(df: DataFrame, name: str, by: list[str]) -> None:
            (df.withColumn("bucket", self._bucket()).hint("rebalance", *by).sortWithinPartitions(*by, "node")
             .write.option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{name}"))

        put(adjacency(edges), "edges", ["reference_month", "bucket"])
        degree = self.spark.read.schema(_EDGES).parquet(f"{path}/edges").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        nodes = node_table(companies, people).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
        put(nodes, "nodes", ["bucket"])
        self.tidy()
        return path

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path()}/{name}")

    def edges(self, month: str | None = None) -> DataFrame:
        """All edges from both their ends, or those of a month."""
        e = self._table("edges", _EDGES)
        return e.filter(F.col("reference_month") == month) if month else e

    def nodes(self) -> DataFrame:
        return self._table("nodes", _NODES)

    def _wanted(self, rows: DataFrame) -> DataFrame:
        # the test is always true: it marks the side as one worth pruning by
        return rows.withColumn("bucket", self._bucket()).filter("bucket >= 0")

    def neighbours(self, rows: DataFrame, month: str | None = None) -> DataFrame:
        """``rows`` (with a column ``node``) joined to their edges."""
        return self.edges(month).join(self._wanted(rows), ["bucket", "node"]).drop("bucket")

    def describe(self, network: DataFrame) -> DataFrame:
        """``seed`` and the stored node rows of every end of a network."""
        ends = network.select("seed", F.col("src").alias("node")).unionByName(network.select("seed", F.col("dst").alias("node"))).distinct()
        return self.nodes().join(self._wanted(ends), ["bucket", "node"]).select("seed", "node", "kind", "label", "degree")

    def search(self, q: str, k: int = 20) -> DataFrame:
        """GRA-9 on the stored nodes."""
        return search_nodes(self.nodes(), q).orderBy("rank", "label", "node").limit(k)
