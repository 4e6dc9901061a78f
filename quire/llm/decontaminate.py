"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs with at most k edits shares at least m - q + 1 - k*q of its q-grams
with that place, on at most k + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands
of diagonals, bands that reach the bound are kept, and each is verified by banded alignment. A q-gram that
many passages have is not counted for a passage as long as the bound allows it: the bound falls by one for
each q-gram left out, so no occurrence is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_batches
from quire.llm.textmatch import Patterns, fit, full_bands, gram_hashes, like_lengths, normalize, normalize_pattern, pad, windows

OUT = "item_id bigint, start int, stop int, edits int, similarity double"
#: Postings above which a q-gram counts as common.
COMMON = 32


class Passages:
    def __init__(self, texts: list[str], q: int, rate: float):
        codes = [normalize_pattern(t) for t in texts]
        m = np.array([len(c) for c in codes], dtype=np.int64)
        # a short passage gets the largest budget for which the bound is at least one shared q-gram
        self.budget = np.maximum(0, np.minimum((rate * m).astype(np.int64), (m - q) // q))
        bound = np.maximum(1, m - q + 1 - self.budget * q)
        hashes = [gram_hashes(c, q) for c in codes]
        known, times = np.unique(np.concatenate([*hashes, np.empty(0, dtype=np.uint64)]), return_counts=True)
        chosen = []
        for i, h in enumerate(hashes):
            times_here = times[np.searchsorted(known, h)]
            spare = min(int((times_here > COMMON).sum()), int(bound[i] - max(1, bound[i] // 4)))
            chosen.append(np.sort(np.argsort(times_here, kind="stable")[: len(h) - spare]))
            bound[i] -= spare
        self.bound, self.index = bound, Patterns(codes, q, chosen)
        self.short = [(i, c) for i, c in enumerate(self.index.codes) if 0 < len(c) < q]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, start, stop, edits) of occurrences, not overlapping for one passage."""
        parts = [normalize(t) for t in texts]
        lengths = np.array([len(c) for c, _ in parts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.concatenate([c for c, _ in parts]) if parts else np.empty(0, dtype=np.uint32)
        index = self.index
        found = self._short(parts)
        hits = index.probe(codes, starts, lengths)
        text, item, band = full_bands(hits, self.budget + 1, index.lengths, self.bound, int(lengths.max(initial=0)))
        for part in like_lengths(index.lengths[item], index.lengths[item] + 2 * (self.budget[item] + 1)):
            found += self._verify(codes, starts, lengths, text[part], item[part], band[part])
        out, ends = [], {}
        for t, p, a, b, e in sorted(found, key=lambda x: (x[0], x[1], x[4], x[2])):
            held = ends.setdefault((t, p), [])
            if all(b <= x or a >= y for x, y in held):
                held.append((a, b))
                at = parts[t][1]
                out.append((t, p, int(at[a]), int(at[b - 1]) + 1 if b > a else int(at[a]), e))
        return out

    def _verify(self, codes, starts, lengths, text, item, band):
        k, m = self.budget[item], self.index.lengths[item]
        diagonal, bands = band * (k + 1) - m, 2 * (k + 1)
        low, high = starts[text], starts[text] + lengths[text]
        rows, size = [self.index.codes[i] for i in item.tolist()], int(m.max())
        edits, end = fit(pad(rows, size), m, windows(codes, low + diagonal, low, high, size + int(bands.max())), bands)
        stop = np.minimum(diagonal + m + end, lengths[text])
        good = np.flatnonzero(edits <= k)
        if not len(good):
            return []
        # the same alignment backwards from its end gives its start
        text, item, k, m, stop, edits = text[good], item[good], k[good], m[good], stop[good], edits[good]
        start = stop - m
        size = int((m + k).max()) + 1
        last = starts[text] + stop
        back = windows(codes, last - size, starts[text], last, size)[:, ::-1]
        for r in np.flatnonzero(edits > 0).tolist():
            start[r] = stop[r] - _reach(rows[good[r]][::-1], back[r], int(edits[r]))
        return list(zip(text.tolist(), item.tolist(), np.maximum(start, 0).tolist(), stop.tolist(), edits.tolist()))

    def _short(self, parts):
        found = []
        for t, (codes, _) in enumerate(parts) if self.short else ():
            line = codes.tobytes().decode("utf-32-le", "surrogatepass")
            for i, pattern in self.short:
                at = line.find(word := pattern.tobytes().decode("utf-32-le", "surrogatepass"))
                while at >= 0:
                    found.append((t, i, at, at + len(word), 0))
                    at = line.find(word, at + len(word))
        return found


def _reach(pattern: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Characters of text that an alignment of the whole pattern with `edits` edits uses, from its start."""
    d = 2 * edits + 1
    lead = np.full(edits, -1, dtype=np.int64)
    padded = np.concatenate([lead, text, lead])[None, :]
    step = np.arange(d, dtype=np.int32)
    cost = np.where(step < edits, 1 << 28, step - edits).astype(np.int32)
    for i in range(len(pattern)):
        new = cost + (padded[0, i : i + d] != pattern[i])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new[step + i + 1 < edits] = 1 << 28
        cost = np.minimum.accumulate(new - step) + step
    return len(pattern) + int(cost.argmin()) - edits


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id, start, stop, edits, similarity): places where a passage occurs with few edits.

    The edit budget of a passage is floor(rate * length) characters, less only where the bound would fall
    below one shared q-gram (passages under about q / (1 - rate * q) characters; under q they must occur
    exactly). Case and runs of white space don't count. start and stop are code points of the original
    text. Of overlapping places for one passage the one with the fewest edits stays. Null and empty texts
    and passages match nothing. Repeated rows of docs repeat; of equal passages with one item_id one counts.

    Documents are never shuffled. The passages, a stated query set, go to the tasks in blocks of at most
    block_chars characters (a longer passage alone); more of them means more passes, not more memory.
    """
    kind = docs.select(id_col).dtypes[0][1]
    out = None
    for shared in _blocks(docs, benchmark, block_chars):

        def run(batches, shared=shared):
            ids, texts = shared.value
            passages = Passages(texts, q, rate)
            for batch in text_batches(batches, limit=2 << 20):
                found = passages.find([t or "" for t in batch.column(1).to_pylist()])
                m = passages.index.lengths
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [pa.array([ids[f[1]] for f in found], pa.int64()), *(pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)), pa.array([1 - f[4] / int(m[f[1]]) for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols], ["id", "item_id", "start", "stop", "edits", "similarity"])

        part = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> list:
    """The passages as broadcasts of (ids, texts), at least one, each of at most about block_chars characters."""
    items = benchmark.where("item_id is not null and length(trim(text)) > 0").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        out.append(docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs in whose text no passage occurs (see contaminated_spans). Rows are judged where they stand,
    whatever their ids; nothing is joined or shuffled."""
    place = docs.columns.index(text_col)
    for shared in _blocks(docs, benchmark, block_chars):

        def run(batches, shared=shared):
            passages = Passages(shared.value[1], q, rate)
            for batch in text_batches(batches, text=place, limit=2 << 20):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[f[0] for f in passages.find([t or "" for t in batch.column(place).to_pylist()])]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
