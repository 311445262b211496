"""Hashed word and character n-grams of whole texts, in numpy.

A text is lower-cased and cut at white space; character n-grams keep to one
word with a space before and after it. Word n-grams follow one another across
white space; from two words on, a word said twice running also falls into one
bucket of its own, whatever the word. Texts are worked off in passes of about
``PASS_CHARS`` characters, cut at white space only, so memory does not follow a
text's length (but its longest run without white space); the last words of a
pass are carried over to the next of the same text, so that no n-gram of words
is lost at a seam."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

PASS_CHARS = 1 << 16
_P = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[:33] = True
_SPACE[[0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _cut(text: str, at: int) -> int:
    """Where the piece that begins at ``at`` ends: at the last white space
    within ``PASS_CHARS``, else at the first after it."""
    end = at + PASS_CHARS
    if end >= len(text):
        return len(text)
    gaps = np.flatnonzero(_SPACE[_codes(text[at:end])])
    if len(gaps) and gaps[-1]:
        return at + int(gaps[-1])
    while end < len(text):
        gaps = np.flatnonzero(_SPACE[_codes(text[end:end + PASS_CHARS])])
        if len(gaps):
            return end + int(gaps[0])
        end += PASS_CHARS
    return len(text)


@dataclass(frozen=True)
class Ngrams:
    """Which n-grams are hashed, and to how many buckets (2 ** bits)."""

    chars: tuple[int, ...] = (3, 4, 5)
    words: int = 1
    bits: int = 18

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _MIX
        h ^= h >> np.uint32(15)
        return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - self.bits)

    def passes(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, bucket)`` arrays, pass by pass; rows count from 0 in the
        order of ``texts``."""
        rows, parts, held = [], [], 0
        carry = (-1, np.zeros(0, np.uint32))
        for row, text in enumerate(texts):
            text = text.lower()
            at = 0
            while at < len(text):
                piece = text[at:_cut(text, at)]
                at += len(piece)
                if held + len(piece) > PASS_CHARS and parts:
                    who, what, carry = self._pass(rows, parts, carry)
                    yield who, what
                    rows, parts, held = [], [], 0
                rows.append(row)
                parts.append(piece)
                held += len(piece) + 1
        if parts:
            yield self._pass(rows, parts, carry)[:2]

    def _pass(self, rows: list[int], parts: list[str], carry: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[int, np.ndarray]]:
        """``carry``: the row that the last pass ended in, and its last words."""
        codes = _codes(" " + " ".join(parts) + " ")
        owner = np.repeat(np.asarray(rows, dtype=np.int64), [len(p) + 1 for p in parts])
        owner = np.concatenate((owner[:1], owner))
        gap = _SPACE[codes]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        gap, owner = gap[keep], owner[keep]
        codes = np.where(gap, np.uint32(32), codes[keep])
        owner[1:][gap[:-1]] = owner[1:][gap[:-1]]
        who, what = [], []
        n, h, ok = 1, codes.copy(), np.ones(len(codes), dtype=bool)
        # a window starts at its first letter or at the space before a word
        first = np.where(gap, np.append(owner[1:], owner[-1]), owner)
        for size in range(1, max(self.chars, default=0) + 1):
            if size > 1:
                if len(h) < 2:
                    break
                h = h[:-1] * _P + codes[size - 1:]
                ok = ok[:-1]
                if size > 2:
                    ok = ok & ~gap[size - 2:len(gap) - 1]
            if size in self.chars:
                use = ok & ~gap[:len(ok)] if size == 1 else ok & ~(gap[:len(ok)] & gap[size - 1:]) if size == 2 else ok
                who.append(first[:len(ok)][use])
                what.append(self._bucket(h[use], size))
        if self.words:
            starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
            if len(starts):
                letters = np.flatnonzero(~gap)
                number = np.cumsum((~gap[1:] & gap[:-1])[letters - 1]) - 1
                place = letters - starts[number]
                power = np.cumprod(np.concatenate(([np.uint32(1)], np.full(int(place.max()), _P, dtype=np.uint32))), dtype=np.uint32)
                cuts = np.flatnonzero(np.diff(number, prepend=-1))
                word = np.add.reduceat(codes[letters] * power[place], cuts, dtype=np.uint32)
                of = owner[starts]
                who.append(of)
                what.append(self._bucket(word, 101))
                # the row's words before this pass take part in pairs only
                old = carry[1] if carry[0] == of[0] else carry[1][:0]
                word, of = np.concatenate((old, word)), np.concatenate((np.full(len(old), of[0], of.dtype), of))
                h = word
                for k in range(2, self.words + 1):
                    if len(word) < k:
                        break
                    h = h[:-1] * np.uint32(0x27D4EB2F) + word[k - 1:]
                    same = of[:len(h)] == of[k - 1:]
                    same[:max(0, len(old) - k + 1)] = False  # counted in the last pass
                    who.append(of[:len(h)][same])
                    what.append(self._bucket(h[same], 100 + k))
                if self.words > 1 and len(word) > 1:
                    again = (of[1:] == of[:-1]) & (word[1:] == word[:-1])
                    again[:max(0, len(old) - 1)] = False
                    who.append(of[1:][again])
                    what.append(self._bucket(np.zeros(int(again.sum()), np.uint32), 100))
                mine = word[of == of[-1]]
                carry = (int(of[-1]), mine[max(0, len(mine) - self.words + 1):] if self.words > 1 else mine[:0])
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), carry
        return np.concatenate(who), np.concatenate(what), carry

    def of(self, text: str) -> np.ndarray:
        """All buckets of one text, repeats included."""
        found = [what for _, what in self.passes([text])]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)
