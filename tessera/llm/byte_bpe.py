"""Operator 3, byte-level BPE encoding and decoding through a sentencepiece
model that is written directly from a rank vocabulary: every byte string
becomes a piece of byte-mapped characters, scored by its negative rank, with
the identity normaliser. Pre-tokens are encoded one by one; decoding maps ids
back to byte strings.

Defined results: a null or empty text has no tokens and decodes to nothing;
repeated rows repeat; an empty table gives an empty result; texts of any
length are encoded whole. Columns besides the named ones are not read."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import array_udf, prepare, text_of, text_udf

#: pre-tokens remembered in each of a worker's two tables; when the newer is
#: full it becomes the older
MEMORY = 250_000
GROUP_CHARS = 1 << 19
#: longer pre-tokens are encoded without being remembered
REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 byte string and rank, one pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and
    no blank, else one of those from U+0100 on, in byte order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    import struct
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown
    piece comes after the last rank. Ranks must run from 0 without a gap."""
    names = byte_characters()
    pieces = [b""] * len(ranks)
    for value, rank in ranks.items():
        pieces[rank] = "".join(names[b] for b in value).encode()
    # ModelProto: pieces = 1 (piece 1, score 2, type 3), trainer_spec = 2, normalizer_spec = 3
    body = b"".join(_field(1, _field(1, p) + _field(2, -float(i))) for i, p in enumerate(pieces))
    body += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(
        _varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # BPE; unk id; no begin, end or padding
    # identity: no dummy prefix, no white space removed or escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normalizer)


@lru_cache(maxsize=None)
def library_class(kind: str, top: int) -> str:
    """The characters below ``top`` of Unicode class ``kind`` as the tiktoken
    library sees them, as the inside of a bracket class. (Regex engines follow
    different Unicode versions.)"""
    import tiktoken
    every = "".join(chr(c) for c in range(top) if not 0xD800 <= c < 0xE000)
    plain = tiktoken.Encoding("bytes", pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = [ord(c) for c in bytes(plain.encode_ordinary(every)).decode()]
    out, first = [], None
    for i, c in enumerate(found):
        first = c if first is None else first
        if i + 1 == len(found) or found[i + 1] != c + 1:
            out.append(f"\\U{first:08x}-\\U{c:08x}" if c > first else f"\\U{c:08x}")
            first = None
    return "".join(out)


def spelt_pattern(pattern: str, top: int) -> str:
    """The pattern for texts below code point ``top`` with its letters and
    numbers spelt out, which the ``re`` module can run."""
    def put(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(r"\\p\{([LN])\}", lambda x: library_class(x[1], top), m[0])
        return f"[{library_class(m[1], top)}]"

    spelt = re.sub(r"\[(?:[^\]\\]|\\.)*\]|\\p\{([LN])\}", put, pattern)
    # white space without U+001C to U+001F, which only ``re`` counts as such
    blank = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    inside = re.sub(r"\[(?:[^\]\\]|\\.)*\]", lambda m: m[0].replace(r"\s", blank), spelt)
    return inside.replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")


def splitter(pattern: str):
    """``text -> pre-tokens``; texts of Latin-1 go by a smaller pattern."""
    latin, whole = re.compile(spelt_pattern(pattern, 0x100)).findall, re.compile(spelt_pattern(pattern, 0x110000)).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return whole(text)
        return latin(text)

    return split


class ByteBpe:
    """Encoder and decoder for one rank vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece
        self.split = splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.bytes = [b""] * len(ranks)
        for value, rank in ranks.items():
            self.bytes[rank] = value
        self.ranks = ranks
        self.names = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def _mapped(self, token: str) -> str:
        return token.encode("utf-8", "replace").decode("latin-1").translate(self.names)

    def _learn(self, tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens; a pre-token that is itself in the vocabulary is
        one token."""
        out, rest = {}, []
        for t in tokens:
            whole = self.ranks.get(t.encode("utf-8", "replace"))
            if whole is None:
                rest.append(t)
            else:
                out[t] = (whole,)
        for t, ids in zip(rest, self.model.encode([self._mapped(t) for t in rest], num_threads=1) if rest else ()):
            out[t] = tuple(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text. Texts are taken in groups of about
        ``GROUP_CHARS`` characters, so that the model sees many new pre-tokens
        in one call."""
        group, held = [], 0
        for text in texts:
            group.append(self.split(text))
            held += len(text)
            if held >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> Iterator[list[int]]:
        need = set(chain.from_iterable(group))
        use, before = self.known, self.before
        if len(use) + len(need) > MEMORY:  # the older half is forgotten
            self.before, self.known = before, use = use, {}
        new = need.difference(use)
        extra = {t: before[t] for t in new if t in before}
        extra.update(self._learn(new.difference(extra)))
        use.update((t, v) for t, v in extra.items() if len(t) <= REMEMBERED and len(use) < MEMORY)
        long = {t: v for t, v in extra.items() if t not in use}
        for tokens in group:
            if long:
                yield list(chain.from_iterable(long[t] if t in long else use[t] for t in tokens))
            else:
                yield list(chain.from_iterable(map(use.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker and vocabulary."""
    return ByteBpe(read_ranks(path), pattern)


def _default_path() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text in column ``out``."""
    path, pattern = _paths(path, pattern)

    def make():
        bpe = load(path, pattern)
        return lambda texts: [{"ids": ids} for ids in bpe.encode_all(texts)]

    udf = text_udf(make, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    prepare(docs.sparkSession)
    return docs.withColumn(out, udf(text_of(text))["ids"])


def decode_ids(docs: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each id list in binary column ``out`` (null
    ids: no bytes)."""
    path, pattern = _paths(path, pattern)

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            yield pa.array([bpe.decode(v.as_py() or ()) for v in batch], pa.binary())

    prepare(docs.sparkSession)
    return docs.withColumn(out, array_udf(run, T.BinaryType())(F.col(ids)))


def _paths(path, pattern):
    if path is None or pattern is None:
        default = _default_path()
        return path or default[0], pattern or default[1]
    return path, pattern


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256, n_bytes`` (decoded), in one pass, so that no id list has
    to leave its task."""
    path, pattern = _paths(path, pattern)

    def make():
        bpe = load(path, pattern)
        digits = [str(i) for i in range(len(bpe.bytes))]

        def step(texts):
            out = []
            for ids in bpe.encode_all(texts):
                back = bpe.decode(ids)
                out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(),
                            "decoded_sha256": hashlib.sha256(back).hexdigest(), "n_bytes": len(back)})
            return out
        return step

    udf = text_udf(make, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                                       T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())]))
    prepare(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), udf(text_of(text)).alias("r")).select("doc_id", "r.*")
