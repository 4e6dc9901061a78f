"""Approximate occurrences of stated patterns in texts: q-gram probes, diagonal bands, banded alignment.

Everything works on arrays of code points, for all texts of a step at once. Texts are compared in lower
case with each run of white space as one space; offsets are mapped back to the original text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from quire.llm.common import ragged_take

#: Code points of Unicode white space; fixed values.
SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
_SPACE = np.zeros(SPACES[-1] + 2, dtype=bool)
_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int32(1 << 28)
#: Shared q-grams that are looked at at once; one text position with more postings than that comes alone.
HITS = 1 << 21
#: Cells of text windows that are aligned at once.
CELLS = 1 << 20


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, original offset of each), in lower case, runs of white space as one space."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; they stay as they are
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    out = codes[at]
    out[space[at]] = 32
    return out, at


def normalize_pattern(text: str) -> np.ndarray:
    codes, _ = normalize(text.strip())
    return codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position on, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, width, block = int(_BASE), 1, codes.astype(np.uint64)
    done, total = 0, None
    bits = q
    while bits:
        if bits & 1:
            part = block[done : done + n]
            total = part if total is None else total * np.uint64(power) + part
            done += width
        bits >>= 1
        if bits:
            block = block[: len(block) - width] * np.uint64(power) + block[width:]
            power, width = power * power % (1 << 64), width * 2
    return total


@dataclass
class Patterns:
    """Patterns with the postings of chosen q-grams. chosen: for each pattern, positions to post (None: all)."""

    codes: list[np.ndarray]
    q: int
    chosen: list[np.ndarray] | None = None

    def __post_init__(self):
        hashes, owner, place = [], [], []
        for i, codes in enumerate(self.codes):
            h = gram_hashes(codes, self.q)
            at = np.arange(len(h)) if self.chosen is None else self.chosen[i]
            hashes.append(h[at])
            owner.append(np.full(len(at), i))
            place.append(at)
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = np.concatenate([*owner, []]).astype(np.int64)[order], np.concatenate([*place, []]).astype(np.int64)[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self._slot(self.keys)] = True
        self.lengths = np.array([len(c) for c in self.codes], dtype=np.int64)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) >> np.uint64(44)

    def probe(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, offset in it, pattern, offset in it) of all shared q-grams, in parts of about HITS in the order
        of the texts, which are laid end to end."""
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        if not len(self.keys) or not len(at):
            return
        where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[where] == h[at]
        at, where = at[real], where[real]
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.q <= starts[text] + lengths[text]
        at, where, text = at[inside], where[inside], text[inside]
        sums, begin = np.cumsum(self.count[where]), 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + HITS, side="right")))
            part = slice(begin, stop)
            times = self.count[where[part]]
            posting = ragged_take(np.arange(len(self.owner)), self.first, self.count, where[part])
            yield np.repeat(text[part], times), np.repeat(at[part] - starts[text[part]], times), self.owner[posting], self.place[posting]
            begin = stop


def full_bands(hits: Iterable[tuple[np.ndarray, ...]], width: np.ndarray, lengths: np.ndarray, need: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pattern, band) with at least need[pattern] hits: band b of a pattern holds the diagonals
    [b, b + 2) * width - its length.

    Bands overlap by half, so any width consecutive diagonals lie in one of them. longest: of the texts. A
    band that lies before the last hit is closed, so what is held follows the patterns that are open there,
    not the hits.
    """
    n = len(lengths)
    span = (longest + int(lengths.max(initial=0))) // int(width.min(initial=1)) + 3
    keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    full = [np.empty(0, dtype=np.int64)]
    for text, offset, pattern, place in hits:
        b = (offset - place + lengths[pattern]) // width[pattern]
        base = (text * n + pattern) * span
        new, times = np.unique(np.concatenate([base + b, (base + b - 1)[b > 0]]), return_counts=True)
        keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
        which = keys // span
        closed = (which // n < text[-1]) | ((keys % span + 2) * width[which % n] <= offset[-1])
        full.append(keys[closed & (counts >= need[which % n])])
        keys, counts = keys[~closed], counts[~closed]
    full.append(keys[counts >= need[keys // span % n]] if n else keys)
    found = np.sort(np.concatenate(full))
    return found // span // max(n, 1), found // span % max(n, 1), found % span


def like_lengths(lengths: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in parts that are aligned together: the longest pattern of a part is less than half as long again as the
    shortest, and its rows have about CELLS cells of text."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    while begin < len(order):
        stop = int(np.searchsorted(lengths[order], 1.5 * lengths[order[begin]], side="right"))
        inside = np.cumsum(cells[order[begin:stop]])
        stop = begin + max(1, int(np.searchsorted(inside, CELLS, side="right")))
        yield order[begin:stop]
        begin = stop


def windows(codes: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Rows of `size` code points from begin on; what lies outside [low, high) is a code that equals nothing."""
    at = begin[:, None] + np.arange(size)[None, :]
    out = codes[np.clip(at, 0, max(len(codes) - 1, 0))].astype(np.int32)
    out[(at < low[:, None]) | (at >= high[:, None])] = -1
    return out


def fit(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, bands: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of whole patterns to a part of each text: (edits, diagonal of the end).

    patterns: rows padded with -2. texts: rows that begin at diagonal 0; row r allows the diagonals
    0 .. bands[r] - 1. The part may begin on any diagonal, or on diagonal 0 if anchored.
    """
    n, m, d = len(patterns), patterns.shape[1], int(bands.max())
    step = np.arange(d, dtype=np.int32)
    outside = step[None, :] >= bands[:, None]
    cost = np.where(outside, _FAR, step[None, :] if anchored else 0).astype(np.int32)
    edits, end = np.full(n, _FAR, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(m + 1):
        if (done := lengths == i).any():
            edits[done] = cost[done].min(axis=1)
            end[done] = cost[done].argmin(axis=1)
        if i == m:
            break
        new = cost + (texts[:, i : i + d] != patterns[:, i : i + 1])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        new[outside] = _FAR
        cost = np.minimum.accumulate(new - step, axis=1) + step
        cost[outside] = _FAR
    return edits, end


def pad(rows: list[np.ndarray], size: int) -> np.ndarray:
    out = np.full((len(rows), size), -2, dtype=np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out
