"""License scan: winnowed fingerprints of templates in an inverted index, then banded local alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_batches
from quire.llm.license_texts import PROPRIETARY, TAG, TEMPLATES
from quire.llm.textmatch import Patterns, full_bands, gram_hashes, like_lengths, normalize, normalize_pattern, pad, windows

OUT = "license string, template int, start int, stop int, template_start int, template_stop int, coverage double, score int"


#: Share of a template shorter than a piece that must be aligned.
NOTICE = 0.8
#: An SPDX expression after its tag, and what may follow "all rights reserved" where the sentence ends.
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = re.compile(rf"[ \t]*(\(?[ \t]*{_ID}(?:[ \t]+(?:OR|AND|WITH|or|and|with)[ \t]+\(?[ \t]*{_ID}[ \t]*\)?)*[ \t]*\)?)(?![A-Za-z0-9])")
SENTENCE_ENDS = re.compile(r"[ \t]*(?:[.!;)\]\"']|[\r\n]|$)")


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window (the last of equal ones)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def local(patterns: np.ndarray, texts: np.ndarray, bands: np.ndarray, anchor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded local alignment, match 1, edit -1: (score, pattern characters, diagonal of the best end).

    Of equal scores the first row, then the first diagonal. With anchor, alignments begin at the first
    character of the pattern and on that diagonal.
    """
    n, m, d = len(patterns), patterns.shape[1], int(bands.max())
    kind = np.int16 if m + 2 * d < 1 << 13 else np.int32
    step = np.arange(d, dtype=kind)
    outside = step[None, :] >= bands[:, None]
    none = kind(-(1 << 13 if kind is np.int16 else 1 << 28))
    score = np.zeros((n, d), dtype=kind) if anchor is None else np.where(step[None, :] >= anchor[:, None], anchor[:, None] - step, none).astype(kind)
    score[outside] = none
    best, row, diagonal, rows = np.zeros(n, dtype=kind), np.zeros(n, dtype=np.int64), (bands // 2 if anchor is None else anchor).astype(np.int64), np.arange(n)
    for i in range(m):
        new = (texts[:, i : i + d] == patterns[:, i : i + 1]).astype(kind)
        new += new
        new += score
        new -= kind(1)
        np.maximum(new[:, :-1], score[:, 1:] - kind(1), out=new[:, :-1])
        if anchor is None:
            np.maximum(new, kind(0), out=new)
        new[outside] = none
        new += step
        np.maximum.accumulate(new, axis=1, out=new)
        new -= step
        new[outside] = none
        np.maximum(new, none, out=new)
        score = new
        at = score.argmax(axis=1)
        top = score[rows, at]
        better = (top > best) & (patterns[:, i] != -2)
        if better.any():
            best, row, diagonal = np.where(better, top, best), np.where(better, i + 1, row), np.where(better, at, diagonal)
    return best.astype(np.int64), row, diagonal


class Licenses:
    """slack: diagonals of a band, for each template; least: share of a template, or `piece` characters of it, that
    must be aligned."""

    def __init__(self, templates, q: int, window: int, drift: float, least: float, piece: int):
        codes = [normalize_pattern(t) for _, t in templates]
        self.names, self.least, self.piece = [n for n, _ in templates], least, piece
        self.index = Patterns(codes, q, [winnow(gram_hashes(c, q), window) for c in codes])
        self.slack = np.maximum(16, np.ceil(drift * self.index.lengths)).astype(np.int64)
        self.floor = np.minimum(least * self.index.lengths, piece)
        posted = np.bincount(self.index.owner, minlength=len(codes))
        self.need = np.where(posted < 4, 1, np.clip(posted // 3, 2, 12))

    def find(self, texts: list[str]) -> list[tuple]:
        parts = [normalize(t) for t in texts]
        lengths = np.array([len(c) for c, _ in parts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.concatenate([c for c, _ in parts])
        text, item, band = full_bands(self.index.probe(codes, starts, lengths), self.slack, self.index.lengths, self.need, int(lengths.max(initial=0)))
        found = []
        for part in like_lengths(self.index.lengths[item], self.index.lengths[item] + 2 * self.slack[item]):
            found += self._align(codes, starts, lengths, text[part], item[part], band[part])
        out, held = [], {}
        for t, k, a, b, ta, tb, s in sorted(set(found), key=lambda x: (x[0], -x[6], x[2], x[1])):
            at = parts[t][1]
            read = self._read(texts[t], k, int(at[a]), int(at[b - 1]) + 1, tb - ta, s)
            if read and all(b <= x or a >= y for x, y in held.setdefault(t, [])):
                held[t].append((a, b))
                name, stop = read
                out.append((t, name, k, int(at[a]), stop, ta, tb, (tb - ta) / int(self.index.lengths[k]), s))
        return sorted(out, key=lambda x: (x[0], x[3]))

    def _read(self, text: str, k: int, start: int, stop: int, used: int, score: int) -> tuple[str, int] | None:
        """(license, stop) of a place, None where the text around it says otherwise: after PROPRIETARY the sentence must
        end, and a TAG names its license by the expression that follows."""
        name, length = self.names[k], int(self.index.lengths[k])
        if length < self.piece and used < NOTICE * length:  # not only how notices begin
            return None
        if name == PROPRIETARY[0]:
            whole = used == length and text[stop - 1] == "."
            return (name, stop) if score == used and (whole or (used >= length - 1 and SENTENCE_ENDS.match(text, stop))) else None
        if name == TAG[0]:
            found = EXPRESSION.match(text, stop) if used == score == length else None
            if not found:
                return None
            words = re.sub(r"[()]", " ", found[1]).split()
            return " ".join(w.upper() if w.lower() in ("or", "and", "with") else w for w in words), found.end(1)
        return name, stop

    def _align(self, codes, starts, lengths, text, item, band):
        m, low, high = self.index.lengths[item], starts[text], starts[text] + lengths[text]
        slack = self.slack[item]
        diagonal, bands, most = band * slack - m, 2 * slack, int(slack.max())
        rows, size = [self.index.codes[i] for i in item.tolist()], int(m.max())
        score, stop_t, end = local(pad(rows, size), windows(codes, low + diagonal, low, high, size + 2 * most), bands)
        good = np.flatnonzero(score >= self.floor[item] / 2)
        if not len(good):
            return []
        text, item, score, stop_t, end = text[good], item[good], score[good], stop_t[good], end[good]
        stop = diagonal[good] + stop_t + end
        back_rows = [rows[g][: int(s)][::-1] for g, s in zip(good, stop_t)]
        # the same band backwards from the end that was found
        anchor, size = bands[good] - 1 - end, max(map(len, back_rows)) + 2 * most
        last = starts[text] + stop
        back = windows(codes, last - size + anchor, starts[text], last, size)[:, ::-1]
        _, used_t, end = local(pad(back_rows, size - 2 * most), back, bands[good], anchor)
        used = used_t + end - anchor
        found = []
        for t, k, b, n, tb, tn, s in zip(text.tolist(), item.tolist(), stop.tolist(), used.tolist(), stop_t.tolist(), used_t.tolist(), score.tolist()):
            if tn and n and tn >= self.floor[k] and s >= 0.7 * tn:
                found.append((t, k, b - n, b, tb - tn, tb, s))
        return found


def license_spans(docs: DataFrame, templates=TEMPLATES, q: int = 6, window: int = 5, drift: float = 0.1, least: float = 0.6, piece: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, template, start, stop, template_start, template_stop, coverage, score) for each place.

    Templates are winnowed over q-grams, so any q + window - 1 characters in common meet. Places with
    enough fingerprints in a band of diagonals are aligned locally (match 1, edit -1); the band is wide
    enough for drift * length characters more or fewer (16 at least). coverage is the aligned part of the
    template; places below the share `least` of it and below `piece` characters, or with a score under 0.7
    of the aligned part, are dropped, as are those below the share NOTICE of a template shorter than `piece`; `Proprietary` needs a sentence that ends there, and an SPDX tag counts whole and
    gives the expression after it as the license; of overlapping places the best score stays, then the first place, then
    the first template. Case and runs of white space don't count; start and stop are code points of the
    original text. Null and empty texts have none; repeated rows repeat. The templates are a fixed, small
    list. No shuffle.
    """
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches):
        scan = Licenses(templates, q, window, drift, least, piece)
        for batch in text_batches(batches, limit=2 << 20):
            found = scan.find([t or "" for t in batch.column(1).to_pylist()])
            types = (pa.string(), *[pa.int32()] * 5, pa.float64(), pa.int32())
            cols = [pa.array([f[c + 1] for f in found], kind) for c, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *cols], ["id", *(c.split()[0] for c in OUT.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
