"""Operator 9, benchmark decontamination through a distributed positional
inverted index, in DataFrame operations only.

The index holds one posting (document, position, term) for every training
token that is a word of the test set, in document order, written once to the
shared folder. A test window's terms are ranked by their document-side
frequency; the rarest term's postings, shifted by its offset, give candidate
starts, which are intersected with the shifted postings of the second rarest
and then of all other terms. Nothing depends on how often a passage or word
occurs: candidates are rows that are grouped and joined by document and
position.

Defined results: null or empty texts, and texts without a word, have no words
and are not hit; an item without a word has no window; items of one id count
once, items of null id mark hits but are neither listed nor counted; repeated
document rows are judged alike and repeat; empty tables give an empty result
or no hits. Columns besides the named ones are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_broadcast, free_names, prepare, small_broadcast, stage, text_of

WINDOW = 10
#: the most words that a term may be off its place in a proximity match
SLACK = 2
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ends every document in the index, at the position that is its word count
_END = "\x00"


def words(text: str) -> Column:
    """The words of a text, A-Z in lower case, other letters as they are."""
    t = text_of(text)
    low = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, _BREAK), "")


def test_windows(items: DataFrame, text: str = "text", key: str = "item_id", size: int = WINDOW) -> DataFrame:
    """``item_id, window`` (array of words): every run of ``size`` words of an
    item, or all of a shorter item."""
    w = items.select(F.col(key).alias("item_id"), words(text).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, size).alias("window")).distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, h, pos, term``: postings of the ``vocabulary`` (``word,
    term``) in ``docs``, and term -1 at each document's end.
    ``h`` is the text's hash, so that rows of one id stay apart."""
    each = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"),
                       F.posexplode(F.concat(words(text), F.array(F.lit(_END)))).alias("pos", "word"))
    return stage(each.join(small_broadcast(vocabulary), "word").select("doc_id", "h", "pos", "term"), "postings")


def ranked_windows(windows: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """``wid, size, plan``: windows all of whose terms occur, with their terms
    as (frequency, offset, term) from the rarest on."""
    seen = index.filter("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    parts = windows.select("wid", F.size("window").alias("size"), F.posexplode("window").alias("off", "word"))
    return (parts.join(vocabulary, "word").join(seen, "term")
            .groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("freq", "off", "term"))).alias("plan"))
            .filter(F.size("plan") == F.col("size")))


def _same_place(at: str, slack: int) -> Column:
    return F.explode(F.sequence(F.col(at) - slack, F.col(at) + slack)) if slack else F.col(at)


def intersect(index: DataFrame, ranked: DataFrame, n_windows: int, slack: int = 0) -> DataFrame:
    """``doc_id, h, start, wid``: where a window's terms stand in a document,
    each at most ``slack`` words off its place counted from the rarest term
    (0: the exact phrase)."""
    postings = index.filter("term >= 0")
    first = ranked.select("wid", "size", "plan", F.col("plan")[0]["term"].alias("term"), F.col("plan")[0]["off"].alias("off"))
    place = ["doc_id", "h", "start", "wid"]
    found = (postings.join(bounded_broadcast(first.select("wid", "term", "off"), n_windows), "term")
             .select("doc_id", "h", (F.col("pos") - F.col("off")).alias("start"), "wid")
             .filter(F.lit(bool(slack)) | (F.col("start") >= 0)).distinct())
    found = stage(found, "rarest")

    def near(wanted: DataFrame, against: DataFrame) -> DataFrame:
        """The wanted terms (``at``, ``want``) that a posting meets."""
        spread = wanted.withColumn("at", _same_place("at", slack))
        on = [spread["doc_id"].eqNullSafe(against["doc_id"]), spread["h"] == against["h"], spread["at"] == against["pos"], spread["want"] == against["term"]]
        return spread.join(against, on, "left_semi")

    # the second rarest term, against its own postings only
    second = ranked.filter("size > 1").select("wid", F.col("plan")[1]["term"].alias("want"), F.col("plan")[1]["off"].alias("off"))
    needed = second.select(F.col("want").alias("term")).distinct()
    wanted = found.join(bounded_broadcast(second, n_windows), "wid").select(*place, (F.col("start") + F.col("off")).alias("at"), "want")
    both = near(wanted, postings.join(bounded_broadcast(needed, n_windows), "term", "left_semi")).select(*place).distinct()
    short = found.join(bounded_broadcast(ranked.filter("size = 1").select("wid"), n_windows), "wid", "left_semi")
    both = stage(both.unionByName(short), "second")
    # all others, in the documents that are left
    left = stage(both.select("doc_id", "h").distinct(), "candidates")
    left = small_broadcast(left)
    there = postings.join(left, [postings["doc_id"].eqNullSafe(left["doc_id"]), postings["h"] == left["h"]], "left_semi")
    rest = ranked.filter("size > 2").select("wid", "size", F.explode(F.slice("plan", 3, F.col("size"))).alias("p"))
    wanted = both.join(small_broadcast(rest), "wid").select(
        *place, "size", F.col("p.off").alias("off"), (F.col("start") + F.col("p.off")).alias("at"), F.col("p.term").alias("want"))
    met = near(wanted, there).select(*place, "size", "off")
    met = (met.distinct() if slack else met).groupBy(*place, "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size - 2").select(*place)
    brief = both.join(bounded_broadcast(ranked.filter("size <= 2").select("wid"), n_windows), "wid", "left_semi")
    return met.unionByName(brief)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
                  item_key: str = "item_id", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit`` (words inside an exact match),
    ``n_items, items_sha256, contaminated, n_near`` (windows met in the document
    with terms up to ``slack`` words off, exact matches included) and ``h``."""
    prepare(docs.sparkSession)
    of = stage(test_windows(items, item_text, item_key, size), "items")
    windows = stage(of.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    n_windows = windows.count()
    vocabulary = windows.select(F.explode("window").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    end = docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.lit(-1).cast("long").alias("term"))
    vocabulary = stage(vocabulary.unionByName(end), "vocabulary")
    index = build_index(docs, vocabulary, text, key)
    ranked = stage(ranked_windows(windows, vocabulary, index), "ranked")
    exact = stage(intersect(index, ranked, n_windows).join(bounded_broadcast(ranked.select("wid", "size"), n_windows), "wid"), "exact")
    doc = ["doc_id", "h"]
    spans = exact.select(*doc, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start")))
    hits = spans.select(*doc, covered.alias("n")).groupBy(*doc).agg(F.sum("n").alias("n_hit"))
    names = (exact.join(small_broadcast(windows), "wid").join(of, "window").filter("item_id is not null")
             .select(*doc, F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(*doc).agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = hits.withColumn("items", F.lit(None).cast("array<string>")).unionByName(
        names.withColumn("n_hit", F.lit(None).cast("long")))
    if slack:
        close = intersect(index, ranked, n_windows, slack).select(*doc, "wid").distinct().groupBy(*doc).agg(F.count(F.lit(1)).alias("n_near"))
        found = found.withColumn("n_near", F.lit(None).cast("long")).unionByName(
            close.withColumns({"n_hit": F.lit(None).cast("long"), "items": F.lit(None).cast("array<string>")}))
    else:
        found = found.withColumn("n_near", F.lit(0).cast("long"))
    found = found.groupBy(*doc).agg(F.max("n_hit").alias("n_hit"), F.any_value("items", ignoreNulls=True).alias("items"), F.max("n_near").alias("n_near"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "n_hit", "items", "n_near")
    rows = index.filter("term = -1").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "h")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that no test window occurs in, with all their
    columns."""
    judged = decontaminate(docs, items, text, key, slack=0, **options)
    one, two = free_names(docs, "hit_id", "hit_h")
    hit = stage(judged.filter("contaminated").select(F.col("doc_id").alias(one), F.col("h").alias(two)).distinct(), "contaminated")
    return docs.join(small_broadcast(hit), F.col(key).eqNullSafe(F.col(one)) & (F.xxhash64(text_of(text)) == F.col(two)), "left_anti")


def _sql_words(table: str) -> str:
    return f"regexp_extract_all(translate(coalesce({table}.text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: the rows of the registered query in DuckDB SQL (ids taken to be unique)
ORACLE_SQL = f"""
WITH text AS MATERIALIZED (SELECT doc_id, {_sql_words('documents')} AS w FROM documents),
item AS (SELECT item_id, {_sql_words('benchmark')} AS w FROM benchmark),
part AS MATERIALIZED (SELECT DISTINCT item_id, w[s + 1:s + {WINDOW}] AS win FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM item WHERE len(w) > 0)),
win AS MATERIALIZED (SELECT row_number() OVER () AS wid, win, len(win) AS n FROM (SELECT DISTINCT win FROM part)),
place AS (SELECT wid, n, unnest(win) AS word, generate_subscripts(win, 1) - 1 AS off FROM win),
post AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM text) WHERE word IN (SELECT word FROM place)),
ranked AS MATERIALIZED (SELECT place.*, row_number() OVER (PARTITION BY wid ORDER BY f, off) AS r, count(f) OVER (PARTITION BY wid) AS known
  FROM place LEFT JOIN (SELECT word, count(*) AS f FROM post GROUP BY word) USING (word)),
start AS MATERIALIZED (SELECT DISTINCT doc_id, pos - off AS s, wid, n FROM post JOIN ranked USING (word) WHERE r = 1 AND known = n),
met AS MATERIALIZED (SELECT doc_id, s, wid, n, count(*) AS near, sum(here) AS exact FROM (
    SELECT start.doc_id, s, start.wid, start.n, off, max((pos = s + off)::INT) AS here
    FROM start JOIN ranked ON ranked.wid = start.wid JOIN post ON post.doc_id = start.doc_id AND post.word = ranked.word
    WHERE pos BETWEEN s + off - {SLACK} AND s + off + {SLACK} GROUP BY ALL) GROUP BY ALL),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM met WHERE exact = n) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met JOIN win USING (wid) JOIN part ON part.win = win.win WHERE exact = met.n AND item_id IS NOT NULL) GROUP BY doc_id),
close AS (SELECT doc_id, count(DISTINCT wid) AS n_near FROM met WHERE near = n GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM text LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN close USING (doc_id)
"""
