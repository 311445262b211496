"""Operator 2, SimHash near-duplicates by bit-sliced comparison.

Fingerprints (64 bits over XXH64 of word shingles) are compared within buckets
that every pair inside the radius must share: the bits are cut into blocks,
and two fingerprints at most ``radius`` bits apart agree on all but ``radius``
of the blocks (pigeonhole), so no link is lost. Within a bucket the
fingerprints lie as vertical bit planes; 64 distances are updated by one word
operation through carry-save counters, and a block is abandoned once all its
distances exceed the radius. A bucket of more than ``TILE`` fingerprints is
split into pairs of tiles, so no bucket has to fit one task. A task hands on a
spanning set of its links, never all pairs.

Defined results: a null or empty text, or one without a word, has fingerprint
zero and is linked like any other; a text of fewer words than a shingle hashes
its whole word sequence; equal fingerprints form one group; ids that are null
are passed over when the smallest id of a group is taken (a group of null ids
only has a null component); repeated rows repeat; an empty table gives an
empty result. Columns besides the named ones are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_broadcast, free_names, prepare, stage, text_of, text_udf
from tessera.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: fingerprints compared at once: small buckets are packed up to PACK rows,
#: buckets over TILE rows are split into pairs of tiles
PACK = 512
TILE = 2048
#: blocks are added until an even bucket holds at most so many fingerprints
BUCKET = 4096
#: bytes of text whose words are held at once
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]").search
_LOW = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: eight counters a word, emptied
    before they overflow."""
    rows = -(-len(h) // 255)
    padded = np.zeros(rows * 255, dtype=np.uint64)
    padded[:len(h)] = h
    padded = padded.reshape(rows, 255)
    out = np.zeros((8, 8), dtype=np.int64)
    for b in range(8):
        out[:, b] = ((padded >> np.uint64(b)) & _LOW).sum(axis=1).view(np.uint8).reshape(rows, 8).sum(axis=0)
    return out.reshape(64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    import xxhash
    hash64 = xxhash.xxh64_intdigest
    data = text.encode("utf-8", "replace").lower()
    counts, n, carry, at = np.zeros(64, dtype=np.int64), 0, [], 0
    while at < len(data):
        end = at + PIECE
        cut = _BLANK(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        words = carry + data[at:end].split()
        at = end
        if len(words) >= shingle:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size)[:len(words) - shingle + 1].tolist()
            ends = ends[shingle - 1:].tolist()
            h = np.fromiter([hash64(line[s:e], SEED) for s, e in zip(starts, ends)], dtype=np.uint64, count=len(ends))
            counts += _bit_counts(h)
            n += len(h)
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if not n:
        if not carry:
            return 0
        return hash64(b" ".join(carry), SEED)
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint_udf(shingle: int = SHINGLE):
    """Arrow UDF ``text -> struct(fp bigint)``, the fingerprint as signed."""
    def make():
        def step(texts):
            out = []
            for t in texts:
                f = fingerprint(t, shingle)
                out.append({"fp": f - (1 << 64) if f >> 63 else f})
            return out
        return step

    return text_udf(make, T.StructType([T.StructField("fp", T.LongType())]))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- bit-sliced comparison ------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit ``p`` of fingerprint ``i`` is bit ``i`` of plane ``p``."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(fps) // 64) * 8), dtype=np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def links_within(fps: np.ndarray, radius: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i < j`` of fingerprints at most ``radius`` bits apart."""
    n = len(fps)
    planes = bit_planes(fps)
    depth = (radius + 1).bit_length()
    pad = np.uint64((1 << 64) - 1)
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        word = lo // 64
        lanes = planes[:, word:]
        bits = (fps[lo:hi, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        flip = np.uint64(0) - bits  # all ones where the query's bit is set
        counter = [np.zeros((hi - lo, lanes.shape[1]), dtype=np.uint64) for _ in range(depth)]
        over = np.zeros_like(counter[0])
        if n % 64:
            over[:, -1] = pad << np.uint64(n % 64)
        dead = over
        for p in range(0, 64, 2):
            a = lanes[p] ^ flip[:, p, None]
            b = lanes[p + 1] ^ flip[:, p + 1, None]
            half = a ^ b
            # carry-save: two planes and the lowest counter into sum and carry
            carry = (a & b) | (counter[0] & half)
            counter[0] = counter[0] ^ half
            for k in range(1, depth):
                carry, counter[k] = counter[k] & carry, counter[k] ^ carry
            over |= carry
            if p % 8 == 6:
                dead = over | _exceeds(counter, radius)
                if (dead == pad).all():
                    break
        else:
            live = np.unpackbits((~dead).view(np.uint8).reshape(hi - lo, -1), axis=1, bitorder="little")
            i, j = np.nonzero(live)
            i, j = i + lo, j + word * 64
            up = j > i
            if up.any():
                yield i[up], j[up]


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``, compared from the top bit."""
    greater, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            greater, equal = greater | (equal & counter[k]), equal & ~counter[k]
    return greater


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprint, group's smallest)`` of each linked fingerprint: as many
    rows as fingerprints at most, however many pairs are linked."""
    order = np.argsort(fps.view(np.int64), kind="stable")
    fps = fps[order]
    root = np.arange(len(fps))
    for i, j in links_within(fps, radius):
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero((root != np.arange(len(fps))) & (fps[root] != fps))
    return fps[moved].view(np.int64), fps[root[moved]].view(np.int64)


def _compare(radius: int):
    """Groups arrive sorted by their number ``g``; whole groups are packed."""

    def flush(g: np.ndarray, f: np.ndarray):
        cuts = np.flatnonzero(np.diff(g)) + 1
        bounds = [0, *cuts.tolist(), len(g)]
        at = 0
        for k in range(1, len(bounds)):
            if k + 1 == len(bounds) or bounds[k + 1] - at > PACK:
                if bounds[k] - at > 1:
                    u, v = spanning_links(f[at:bounds[k]].view(np.uint64), radius)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                at = bounds[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g = np.concatenate((g, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((f, batch.column(1).to_numpy(zero_copy_only=False)))
            whole = np.searchsorted(g == g[-1], True) if len(g) else 0
            if whole >= PACK * 4:
                yield from flush(g[:whole], f[:whole])
                g, f = g[whole:], f[whole:]
        if len(g):
            yield from flush(g, f)

    return run


def _masks(radius: int, blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: a spanning set of the links among the distinct fingerprints
    ``fps`` (column ``fp``)."""
    prepare(fps.sparkSession)
    n = fps.count()
    blocks = radius + 1
    while n >> min(bin(m).count("1") for m in _masks(radius, blocks)) > BUCKET:
        blocks += 1
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, blocks)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    members = fps.select("fp", F.explode(keys).alias("g"))
    hot = stage(members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE), "hot-buckets")
    many = hot.count()
    if many:
        tiles = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / TILE).cast("int")
        tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("t")).cast("int")
        members = (members.join(bounded_broadcast(hot, many), "g", "left").select("g", "fp", tiles.alias("t"))
                   .select("g", "fp", "t", tile.alias("a"))
                   .select("g", "fp", "a", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("b"))
                   .select(F.xxhash64("g", F.least("a", "b"), F.greatest("a", "b")).alias("g"), "fp"))
    return members.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInArrow(_compare(radius), "u long, v long")


def assign_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, h, fp, root``: each row's fingerprint and the smallest
    fingerprint of its group (``h``: XXH64 of the text)."""
    prepare(docs.sparkSession)
    rows = stage(docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"),
                             fingerprint_udf(shingle)(text_of(text))["fp"].alias("fp")), "fingerprints")
    groups = connected_components(near_links(rows.select("fp").distinct(), radius))
    return rows.join(groups, rows["fp"] == groups["node"], "left").select("doc_id", "h", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    rows = assign_groups(docs, text, key, shingle, radius)
    first = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "root").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one a group
    stays: that of the smallest id (null ids last; of rows with one id the
    smallest text hash)."""
    rows = assign_groups(docs, text, key, shingle, radius)
    one, two, many, mark = free_names(docs, "chosen_id", "chosen_h", "chosen_n", "text_h")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n")
    chosen = stage(rows.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("root").agg(F.min(order).alias("o"))
                   .select(F.col("o.doc_id").alias(one), F.col("o.h").alias(two), F.col("o.n").alias(many)), "chosen")
    kept = docs.withColumn(mark, F.xxhash64(text_of(text))).join(
        chosen, F.col(key).eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)))
    if not chosen.filter(F.col(many) > 1).isEmpty():  # rows that repeat a group's first row
        once = kept.filter(F.col(many) == 1)
        kept = once.unionByName(kept.filter(F.col(many) > 1).dropDuplicates([one, two]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
