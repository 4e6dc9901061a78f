"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree gives each byte a code length: where the context has
seen the byte, -log2(n / (N + d)); where it hasn't, the escape -log2(d / (N + d)) and the code length in
the next shorter context, with the bytes of the longer one excluded (d distinct bytes in N). Below the
empty context all bytes not yet seen are equally likely. Statistics are frozen after training, so the code
length of a byte is a function of its context: it is worked out once for each distinct gram of a window of
text, from sorted tables of all grams and contexts seen. The language with the fewest bits wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quire.llm.common import Scratch, kept, text_batches

ORDER = 3
#: What stands before the first byte of a text.
LEAD = b"\n" * ORDER
UNKNOWN = "und"


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): how often each byte follows each context of three bytes, over all rows given.

    A task sums its own grams before anything is shuffled, so the shuffle carries at most one row for
    each language, gram and task.
    """

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in text_batches(batches, limit=2 << 20):
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
            for lang, texts in held.items():
                data = np.frombuffer(LEAD + LEAD.join(texts), dtype=np.uint8).astype(np.uint32)
                gram = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
                ends = np.cumsum([len(t) + ORDER for t in texts])[:-1]
                real = np.ones(len(gram), dtype=bool)
                for k in range(1, ORDER + 1):  # what predicts the lead of the next text
                    real[ends - k] = False
                keys, counts = np.unique(gram[real], return_counts=True)
                old = sums.get(lang)
                sums[lang] = (keys, counts) if old is None else _merge(np.concatenate([old[0], keys]), np.concatenate([old[1], counts]))
        for lang, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Statistics:
    """The frozen counts: for each language the numbers of its grams."""

    langs: list[str]
    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Statistics:
    """Counts over all rows of docs with a language and a text. All of them are the model, so every language
    learned can be predicted; its size is the number of distinct grams of each language."""
    rows = Scratch(docs.sparkSession).save(gram_counts(docs, lang_col, text_col), "grams").toArrow()
    names = rows.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    lang, gram = place[names.indices.to_numpy()], rows.column("gram").to_numpy()
    order = np.lexsort((gram, lang))
    return Statistics(langs, lang[order], gram[order], rows.column("n").to_numpy()[order].astype(np.float64))


@dataclass
class Level:
    """All grams and contexts of one order, sorted; the language stands above the bytes in each key."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: log2 of counts, and for each context of total + distinct; cost of its escape
    log: np.ndarray
    norm: np.ndarray
    escape: np.ndarray
    #: the same of the next shorter context without what this one has seen
    rest_norm: np.ndarray
    rest_escape: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _suffix(keys: np.ndarray, size: int) -> np.ndarray:
    """Keys of `size` bytes without their first byte."""
    return keys >> 8 * size << 8 * (size - 1) | keys & (1 << 8 * (size - 1)) - 1


class ContextTrees:
    """Code lengths in all languages, with every context seen as a node.

    tabulated: of so many of the most frequent grams the code lengths are kept at hand; those of others are
    worked out when they occur, with the same result.
    """

    def __init__(self, stats: Statistics, tabulated: int = 1 << 18):
        self.langs = stats.langs
        self.alphabet = len(np.unique(np.append([stats.gram >> s & 255 for s in (24, 16, 8, 0)], 10))) + 1
        self.levels: list[Level] = []
        for order in range(ORDER + 1):
            size = order + 1
            grams, counts = _merge(stats.lang.astype(np.int64) << 8 * size | stats.gram & (1 << 8 * size) - 1, stats.n)
            contexts, first = np.unique(grams >> 8, return_index=True)
            total, distinct = np.add.reduceat(counts, first), np.diff(np.append(first, len(grams)))
            norm = np.log2(total + distinct)
            rest_norm = rest_escape = np.zeros(len(contexts))
            if order:
                up = self.levels[-1]
                at, _ = _find(up.contexts, _suffix(contexts, order))
                left = up.total[at] - np.add.reduceat(up.counts[_find(up.grams, _suffix(grams, size))[0]], first)
                fresh = up.distinct[at] - distinct
                rest_norm = np.log2(np.maximum(left + fresh, 1))
                rest_escape = np.where(fresh > 0, rest_norm - np.log2(np.maximum(fresh, 1)), 0.0)
            self.levels.append(Level(grams, counts, contexts, total, distinct, np.log2(counts), norm, norm - np.log2(distinct), rest_norm, rest_escape))
        known, weight = _merge(stats.gram, stats.n)
        if len(known) > tabulated:
            known = np.sort(known[np.argpartition(-weight, tabulated)[:tabulated]])
        self.known, self.cost = known, self.codes(known)

    def codes(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it, in each language."""
        out = np.empty((len(grams), len(self.langs)), dtype=np.float32)
        for lang in range(len(self.langs)):
            before = cost = below = None
            for order, level in enumerate(self.levels):
                key = lang << 8 * (order + 1) | grams & (1 << 8 * (order + 1)) - 1
                at, hit = _find(level.grams, key)
                node, there = _find(level.contexts, key >> 8)
                log = level.log[at]
                if order:
                    below = np.where(before[1], level.rest_norm[node] - before[0], level.rest_escape[node] + below)
                else:
                    below = cost = np.log2(np.maximum(self.alphabet - np.where(there, level.distinct[node], 0), 1.0))
                # a context not seen in the language codes as its suffix does
                cost = np.where(there, np.where(hit, level.norm[node] - log, level.escape[node] + below), cost)
                before = log, hit
            out[:, lang] = cost
        return out

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        at, hit = _find(self.known, grams)
        out = self.cost[at]
        out[~hit] = self.codes(grams[~hit])
        return out

    def bits(self, texts: list[bytes], window: int = 1 << 19) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(LEAD + LEAD.join(texts), dtype=np.uint8).astype(np.uint32)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        owner_starts = ends - np.array([len(t) for t in texts])
        for begin in range(ORDER, len(data), window):
            s = data[begin - ORDER : begin + window]
            grams, which = np.unique(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:], return_inverse=True)
            cost = self._costs(grams.astype(np.int64))[which]
            stop = begin + len(cost)
            first, last = np.searchsorted(ends, begin, side="right"), np.searchsorted(owner_starts, stop, side="left")
            low = np.clip(owner_starts[first:last], begin, stop) - begin
            high = np.clip(ends[first:last], begin, stop) - begin
            full = np.flatnonzero(high > low)
            if len(full):
                cuts = np.stack([low[full], np.minimum(high[full], len(cost))], axis=1).ravel()
                padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), dtype=np.float32)])
                out[first + full] += np.add.reduceat(padded, cuts, axis=0, dtype=np.float64)[::2]
        return out


def _predicted(docs: DataFrame, stats: Statistics, carried: list[str], text_col: str, names: tuple[str, str, str]) -> DataFrame:
    spark, width = docs.sparkSession, len(carried)
    shared = spark.sparkContext.broadcast(stats) if len(stats.n) else None
    key = uuid.uuid4().hex

    def run(batches):
        for batch in text_batches(batches, text=width, limit=2 << 20):
            letters = np.array([bool(x) for x in batch.column(width + 1).to_pylist()])
            pred, score, rate = np.full(len(letters), UNKNOWN, dtype=object), np.zeros(len(letters)), np.full(len(letters), np.nan)
            if shared is not None and letters.any():
                trees, at = kept(key, lambda: ContextTrees(shared.value)), np.flatnonzero(letters)
                texts = [t for t, ok in zip(batch.column(width).cast(pa.binary()).to_pylist(), letters) if ok]
                bits = trees.bits(texts)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                pred[at] = np.array(trees.langs, dtype=object)[best]
                score[at] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                rate[at] = least / np.array([len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(pred, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], [*carried, *names])

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    kinds = zip(names, (StringType(), DoubleType(), DoubleType()))
    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in carried), *(StructField(n, k) for n, k in kinds)]))


def identify(docs: DataFrame, stats: Statistics, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) for each row of docs.

    score is the posterior probability of the language that codes the text in the fewest bits, all
    languages being as likely beforehand; of equal ones the first name wins. lang_pred is `und`, score 0
    and bits_per_byte null where the text is null or has no letter, or where nothing was learned. Whole
    texts are scored, in windows. Repeated rows repeat. No shuffle; the frozen counts are broadcast.
    """
    return _predicted(docs, stats, [id_col], text_col, ("lang_pred", "score", "bits_per_byte"))


def annotate(docs: DataFrame, stats: Statistics, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs with what identify finds, as further columns under `names`, none of which docs may have."""
    if set(names) & set(docs.columns):
        raise ValueError(f"docs has a column of {names}")
    return _predicted(docs, stats, docs.columns, text_col, names)
