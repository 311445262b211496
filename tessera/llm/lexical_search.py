"""Operator 12, ranked lexical search by Block-Max MaxScore.

A first pass counts the documents with a term (N) and all terms (L). Tasks then
read whole texts and cut what they read into shards of bounded size. A shard's
inverted index has one row a term: its documents in blocks of ``BLOCK``
postings, compressed, with the last document and the greatest impact of every
block beside them. The index holds every row and every term and is written to
the shared folder; document frequencies are counted from it.

Queries are rows too: every block of queries asks every shard. Within a shard
a query's lists lie by their greatest score. Those whose greatest scores
together cannot reach the tenth best score so far are non-essential: only
documents of the other, essential lists are candidates. A candidate's score so
far, with the maxima of the non-essential lists' blocks that it would lie in,
must still reach that score, or it is rejected before any of those blocks is
decompressed; blocks of the survivors are decompressed list by list. Each
shard hands on its best, which are merged by rank.

Defined results: null or empty texts, and texts without a term, have no terms
and are not counted; an item without a term, or none of whose terms occurs
with a weight, has no rows; repeated document rows are documents of their own;
equal scores are ranked by id, null ids last; repeated items are ranked each
on its own; an empty table gives an empty result. Columns besides the named
ones are not read."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_broadcast, prepare, stage, text_of

TOP = 10
#: parameters of the score: impact = tf * 1000000000 div (1000 * tf + 8 * m),
#: m = 100 - LENGTH + LENGTH * n * N div L
LENGTH = 75
#: postings a block; bytes of text a shard at most (one longer text is one shard)
BLOCK = 128
SHARD_BYTES = 16 << 20
#: a list of so few postings is one block that is left as it is
SHORT = 16
#: queries a block in the mean, documents that one step looks at
QUERY_BLOCK = 1000
STEP = 1024
#: parts of the join that deals the queries to the shards
DEALS = 64

#: everything that is not in a word becomes a space, A-Z lower case
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_INDEX = "shard string, term string, n long, best long, lasts binary, maxima binary, ends binary, body binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(_BYTES).split()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term and terms, one row a task."""
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms_of(text.as_py() or b""))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["n", "l"])


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What an occurrence count gives a term of weight 1 in a document of
    ``n`` terms."""
    m = 100 - LENGTH + (LENGTH * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def pack(docs: np.ndarray, impacts: np.ndarray) -> bytes:
    """A block: the steps from document to document and the impacts, each in
    the fewest bytes that hold them, compressed where that is shorter."""
    parts = []
    for values in (np.diff(docs, prepend=0), impacts):
        width = next(w for w in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * w)
        parts.append(bytes([width]) + values.astype(f"<u{width}").tobytes())
    plain = bytes([len(docs)]) + b"".join(parts)
    packed = zstandard.compress(plain, 1)
    return b"\x01" + packed if len(packed) < len(plain) else b"\x00" + plain


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents and impacts of a block; kind 2 is a short list as it is."""
    if block[0] == 2:
        both = np.frombuffer(block, "<u4", offset=1).astype(np.int64)
        return both[:len(both) // 2], both[len(both) // 2:]
    plain = zstandard.decompress(block[1:]) if block[0] else block[1:]
    n, at, out = plain[0], 1, []
    for _ in range(2):
        width = plain[at]
        out.append(np.frombuffer(plain, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return np.cumsum(out[0]), out[1]


class _Shard:
    """Documents taken in until the shard is sealed."""

    def __init__(self):
        self.ids, self.lengths, self.kinds, self.which, self.counts, self.bytes = [], [], [], [], [], 0
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__

    def add(self, key: int | None, text: bytes) -> None:
        found = Counter(terms_of(text))
        if found:
            self.ids.append(key)
            self.lengths.append(found.total())
            self.kinds.append(len(found))
            self.which.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
            self.counts.append(np.fromiter(found.values(), np.int32, len(found)))
            self.bytes += len(text)

    def seal(self, name: str, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows: its ids by number (term null), then its terms."""
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        none = np.array([i is None for i in self.ids])
        order = np.lexsort((ids, none))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        yield _batch([name], [None], [int((~none).sum())], [len(order)], [None], [None], [None], [ids[order].tobytes()])
        kinds = np.array(self.kinds)
        doc, term, tf = np.repeat(number, kinds), np.concatenate(self.which), np.concatenate(self.counts).astype(np.int64)
        score = impact(tf, np.repeat(np.array(self.lengths, np.int64), kinds), docs, terms)
        by = np.lexsort((doc, term))
        doc, term, score = doc[by], term[by], score[by]
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        sizes = np.diff(cuts)
        starts = np.flatnonzero((np.arange(len(doc)) - np.repeat(cuts[:-1], sizes)) % BLOCK == 0)
        first = np.searchsorted(starts, cuts).tolist()
        maxima = np.maximum.reduceat(score, starts).astype("<u4").tobytes()
        lasts = doc[np.append(starts[1:], len(doc)) - 1].astype("<u4").tobytes()
        best, whole_doc, whole_score = np.maximum.reduceat(score, cuts[:-1]), doc.astype("<u4").tobytes(), score.astype("<u4").tobytes()
        words, bounds = list(self.vocabulary), cuts.tolist()
        for part in range(0, len(words), 20_000):
            some = range(part, min(part + 20_000, len(words)))
            body, ends = [], []
            for i in some:
                lo, hi = bounds[i], bounds[i + 1]
                if hi - lo <= SHORT:
                    body.append(b"\x02" + whole_doc[4 * lo:4 * hi] + whole_score[4 * lo:4 * hi])
                    ends.append((1 + 8 * (hi - lo)).to_bytes(8, "little"))
                else:
                    blocks = [pack(doc[a:min(a + BLOCK, hi)], score[a:min(a + BLOCK, hi)]) for a in range(lo, hi, BLOCK)]
                    body.append(b"".join(blocks))
                    ends.append(np.cumsum([len(b) for b in blocks]).astype("<u8").tobytes())
            yield _batch([name] * len(some), [words[i].decode("utf-8", "replace") for i in some], sizes[part:some.stop], best[part:some.stop],
                         [lasts[4 * first[i]:4 * first[i + 1]] for i in some], [maxima[4 * first[i]:4 * first[i + 1]] for i in some], ends, body)


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "term", "n", "best", "lasts", "maxima", "ends", "body"])


def _index(docs: int, terms: int, shard_bytes: int):
    """``key, text`` rows -> index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(key, text.as_py() or b"")
                if shard.bytes >= shard_bytes:
                    yield from shard.seal(f"{part}-{made}", docs, terms)
                    made, shard = made + 1, _Shard()
        if shard.ids:
            yield from shard.seal(f"{part}-{made}", docs, terms)

    return run


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The index, the documents with a term and the terms of all documents."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).cast("binary").alias("text"))
    n, l = rows.select("text").mapInArrow(_lengths, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    index = stage(rows.mapInArrow(_index(n, l, shard_bytes), _INDEX), "lexical")
    return index, n, l


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``qid, text`` -> ``qid, term, times``."""
    for batch in batches:
        qids, words, times = [], [], []
        for qid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = Counter(terms_of(text.as_py() or b""))
            qids += repeat(qid, len(found))
            words += [w.decode("utf-8", "replace") for w in found]
            times += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["qid", "term", "times"])


class Lists:
    """A shard's posting lists, decompressed block by block on demand."""

    def __init__(self, rows: list[dict]):
        self.at = {}
        self.docs, self.named, self.ids = 0, 0, np.zeros(0, np.int64)
        for r in rows:
            if r["term"] is None:
                self.docs, self.named, self.ids = r["best"], r["n"], np.frombuffer(r["body"], "<i8")
            else:
                self.at[r["term"]] = (r["best"], np.frombuffer(r["lasts"], "<u4").astype(np.int64), np.frombuffer(r["maxima"], "<u4").astype(np.int64),
                                      np.frombuffer(r["ends"], "<u8").astype(np.int64), r["body"])
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, term: str, b: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.open.get((term, b))
        if got is None:
            ends, body = self.at[term][3:]
            got = self.open[term, b] = unpack(body[ends[b - 1] if b else 0:ends[b]])
        return got

    def blocks(self, term: str, which) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(term, int(b)) for b in which]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def best_of(lists: Lists, terms: list[tuple[str, int]], top: int = TOP, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """``(documents, scores)``: the ``top`` best of the shard for one query of
    ``(term, weight)``, best first, equal ones by number."""
    held = sorted(((w * lists.at[t][0], t, w) for t, w in terms if w > 0 and t in lists.at))
    bounds = np.concatenate(([0], np.cumsum([b for b, _, _ in held])))
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for lo in range(0, lists.docs, step):
        hi = min(lo + step, lists.docs)
        essential = int(np.searchsorted(bounds[1:], least))  # the lists before it cannot reach ``least`` together
        if essential == len(held):
            break
        total = np.zeros(hi - lo, np.int64)
        for _, t, w in held[essential:]:
            lasts = lists.at[t][1]
            a, b = np.searchsorted(lasts, lo), np.searchsorted(lasts, hi - 1)
            if a < len(lasts):
                d, g = lists.blocks(t, range(a, min(b + 1, len(lasts))))
                here = slice(*np.searchsorted(d, (lo, hi)))
                total[d[here] - lo] += w * g[here]
        cand = np.flatnonzero((total > 0) & (total + bounds[essential] >= least))
        score, cand = total[cand], cand + lo
        if essential and len(cand):
            # the maxima of the blocks that a candidate would lie in
            limit = np.zeros((essential, len(cand)), np.int64)
            place = np.zeros((essential, len(cand)), np.int64)
            for i, (_, t, w) in enumerate(held[:essential]):
                _, lasts, maxima = lists.at[t][:3]
                place[i] = np.searchsorted(lasts, cand)
                limit[i] = np.where(place[i] < len(lasts), w * maxima[np.minimum(place[i], len(lasts) - 1)], 0)
            for i in range(essential - 1, -1, -1):
                keep = score + limit[:i + 1].sum(0) >= least
                cand, score, limit, place = cand[keep], score[keep], limit[:, keep], place[:, keep]
                if not len(cand):
                    break
                _, t, w = held[i]
                inside = np.flatnonzero(limit[i] > 0)
                if len(inside):
                    d, g = lists.blocks(t, np.unique(place[i][inside]))
                    at = np.minimum(np.searchsorted(d, cand[inside]), len(d) - 1)
                    score[inside] += np.where(d[at] == cand[inside], w * g[at], 0)
        docs, scores = np.concatenate((docs, cand)), np.concatenate((scores, score))
        order = np.lexsort((docs, -scores))[:top]
        docs, scores = docs[order], scores[order]
        if len(docs) == top:
            least = max(1, int(scores[-1]))
    return docs, scores


def _search(top: int):
    """One cell: a shard's lists and a block of queries."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        qids, keys, scores = [], [], []
        if len(index) and len(queries):
            lists = Lists(index.select(["term", "n", "best", "lasts", "maxima", "ends", "body"]).to_pylist())
            for qid, terms, weights in zip(*(queries[c].to_pylist() for c in ("qid", "terms", "weights"))):
                docs, score = best_of(lists, list(zip(terms, weights)), top)
                qids += repeat(qid, len(docs))
                keys += [int(lists.ids[d]) if d < lists.named else None for d in docs.tolist()]
                scores += score.tolist()
        return pa.table({"qid": pa.array(qids, pa.int64()), "doc_id": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
           top: int = TOP, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item."""
    prepare(docs.sparkSession)
    index, n, _ = build_index(docs, text, key, shard_bytes)
    asked = stage(items.select(F.col(item_key).alias("item_id"), text_of(item_text).cast("binary").alias("text"))
                  .withColumn("qid", F.monotonically_increasing_id()), "items")
    terms = stage(asked.select("qid", "text").mapInArrow(_query_terms, "qid long, term string, times long"), "terms")
    wanted = terms.select("term").distinct()
    frequency = index.filter("term is not null").select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1))).cast("long")
    known = frequency.select("term", weight.alias("w")).filter("w > 0")
    queries = stage(terms.join(known, "term").groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("w") * F.col("times")).alias("weights")), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    used = index.join(queries.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
    used = used.unionByName(index.filter("term is null")).withColumn("block", F.explode(every))
    # queries are dealt to the shards in parts, so that no task writes all cells
    shards = (index.filter("term is null").select("shard", F.pmod(F.xxhash64("shard"), F.lit(DEALS)).alias("deal"), F.explode(every).alias("block")))
    cells = (queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
             .withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))).join(shards, ["block", "deal"])
             .select("qid", "terms", "weights", F.col("shard").alias("to_shard"), F.col("block").alias("to_block")))
    found = used.groupBy("shard", "block").cogroup(cells.groupBy("to_shard", "to_block")).applyInArrow(_search(top), "qid long, doc_id long, score long")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = stage(found, "found").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = asked.select("qid", "item_id")
    return best.join(bounded_broadcast(names, names.count()), "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SQL_TERMS = r"regexp_extract_all(translate(coalesce({0}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: the registered query's rows in DuckDB SQL: every term of every document scored (ids taken to be unique)
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM (SELECT doc_id, {_SQL_TERMS.format('documents')} AS w FROM documents)),
size AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS words FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS.format('benchmark')}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, size GROUP BY term, docs),
hit AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {LENGTH} + ({LENGTH} * n * docs) // words))))::BIGINT AS score
    FROM post JOIN w USING (term) JOIN q USING (term), size GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM hit WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
