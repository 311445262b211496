"""Operator 4, token counts by rank-synchronous array merging: the distinct
pre-tokens of a batch lie as ragged numpy arrays, every round each of them
merges its lowest-ranked pair at once (all pre-tokens together), and the
symbols that survive are counted.

The vocabulary is a ``tokenizers`` JSON file with byte-level characters and an
end-of-word suffix. Its special strings inside a text count as one token each,
as the library's default has it; nothing is added, cut or padded.

Defined results: a null or empty text has no bytes and no tokens; repeated
rows repeat; an empty table gives an empty result; texts of any length are
counted whole. Columns besides the named ones are not read."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.byte_bpe import byte_characters
from tessera.llm.common import prepare, text_of, text_udf

LIMIT = 2048
#: pre-tokens remembered in each of a worker's two tables; when the newer is
#: full it becomes the older
MEMORY = 300_000
REMEMBERED = 64
GROUP_CHARS = 1 << 19
#: letters that one call of the merging rounds holds at once
MERGE_LETTERS = 1 << 20


class MergeTable:
    """Ranked pairs of symbol numbers, looked up for whole arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # a symbol may only be used by merges later than those that make it;
        # then merging all of a word's lowest-ranked pairs at once is the same
        # as merging one by one
        maker: dict[int, int] = {}
        for r, m in enumerate(self.made.tolist()):
            maker[m] = r
        self.in_order = all(maker.get(vocab[a], -1) < r and maker.get(vocab[b], -1) < r for r, (a, b) in enumerate(pairs))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each word after all merges. ``symbols``: all words'
        symbol numbers, one after another; ``lengths``: symbols a word (no
        word is empty)."""
        none = len(self.keys)
        left = lengths.astype(np.int64).copy()
        word = np.repeat(np.arange(len(lengths)), lengths)
        sym = symbols.astype(np.int64)
        while len(sym) > 1:
            same = word[1:] == word[:-1]
            rank = np.full(len(sym), none, dtype=np.int64)
            at = np.flatnonzero(same)
            rank[at] = self.ranks(sym[at], sym[at + 1])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            hit = (rank == best) & (best < none)
            # of overlapping hits (one symbol repeated) every second one goes
            at = np.flatnonzero(hit)
            if not len(at):
                break
            run = np.concatenate(([True], np.diff(at) != 1))
            begin = np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[at + 1] = True
            np.subtract.at(left, word[at], 1)
            # words without a further pair need no more rounds
            open_word = np.zeros(len(left), dtype=bool)
            open_word[word[at]] = True
            keep = ~gone & open_word[word]
            sym, word = sym[keep], word[keep]
        return left


class WordBpe:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        import tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_file(path)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.table = MergeTable(vocab, model["merges"])
        if not self.table.in_order:
            raise ValueError("a merge uses a symbol before it is made; rank-synchronous merging does not apply")
        names = byte_characters()
        self.inner = np.array([vocab[c] for c in names], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in names], dtype=np.int64)
        self.byte_of = {c: b for b, c in enumerate(names)}
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # for Latin-1 texts, which are their own normal form: letters and numbers spelt out
        letters = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
        numbers = "0-9\xb2\xb3\xb9\xbc-\xbe"
        blanks = "\\t-\\r \x85\xa0"
        self.latin = re.compile(split.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
                                .replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")).findall
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def _words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                # other scripts: the library's own normaliser and splitter
                byte_of = self.byte_of
                parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(byte_of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in parts]
        return self.latin(text.lower())

    def _learn(self, words: list[str]) -> Iterator[tuple[str, int]]:
        lo = 0
        while lo < len(words):
            group, held = [], 0
            while lo < len(words) and (not group or held < MERGE_LETTERS):
                group.append(words[lo].encode("utf-8", "surrogateescape"))
                held += len(group[-1])
                lo += 1
            sizes = np.array([len(w) for w in group])
            flat = np.frombuffer(b"".join(group), dtype=np.uint8)
            symbols = self.inner[flat]
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[flat[ends]]
            yield from zip(words[lo - len(group):lo], self.table.count(symbols, sizes).tolist())

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[int, int]]:
        """``(bytes, tokens)`` of each text."""
        group, held = [], 0
        for text in texts:
            pieces = self.special.split(text) if self.special else [text]
            words = self._words(pieces[0]) if len(pieces) == 1 else list(chain.from_iterable(map(self._words, pieces)))
            group.append((words, len(text.encode("utf-8", "replace")), len(pieces) - 1))
            held += len(text)
            if held >= GROUP_CHARS:
                yield from self._count_group(group)
                group, held = [], 0
        yield from self._count_group(group)

    def _count_group(self, group) -> Iterator[tuple[int, int]]:
        need = set(chain.from_iterable(words for words, _, _ in group))
        if len(self.known) + len(need) > MEMORY:  # the older half is forgotten
            self.before, self.known = self.known, {}
        use, before = self.known, self.before
        new = need.difference(use)
        found = {w: before[w] for w in new if w in before}
        found.update(self._learn(sorted(new.difference(found), key=len)))
        lookup = use
        use.update((w, n) for w, n in found.items() if len(w) <= REMEMBERED and len(use) < MEMORY)
        if any(w not in use for w in found):
            lookup = {w: found[w] if w in found else use[w] for w in need}
        for words, size, special in group:
            yield size, sum(map(lookup.__getitem__, words)) + special


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")

    def make():
        bpe = load(path)
        return lambda texts: [{"n_bytes": b, "n_tokens": n} for b, n in bpe.counts(texts)]

    udf = text_udf(make, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    prepare(docs.sparkSession)
    return (docs.select(F.col(key).alias("doc_id"), udf(text_of(text)).alias("r")).select("doc_id", "r.*")
            .withColumn("over_limit", F.col("n_tokens") > limit))
