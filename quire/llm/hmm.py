"""Hidden Markov language model: Baum-Welch across partitions, scaled forward recursion for scoring.

Symbols are the most frequent words, classes of rarer words by a hash, and the end of the text. Every word
has so emissions that depend on the state; one of a class is weighted by its own smoothed share of the
class, so the model is a distribution over texts.

Texts are cut into segments that run side by side. The transfer matrices of a long text's segments give
the exact state distribution at each cut, forwards and backwards, so cutting changes no result.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, kept, most_frequent, text_batches

SEGMENT = 512
#: Products of forward and backward values below which both are scaled anew.
LEAST = 1e-30
#: Tokens that one step of a task runs through the model.
STEP = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


class Segments:
    """The sequences of one step, cut; longest segments first."""

    def __init__(self, sequences: list[np.ndarray]):
        size = np.array([len(s) for s in sequences], dtype=np.int64)
        parts = -(-size // SEGMENT)
        self.flat = np.concatenate(sequences)
        doc = np.repeat(np.arange(len(sequences)), parts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(size) - size, parts) + number * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(size, parts) - number * SEGMENT)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(doc), dtype=np.int64)
        place[order] = np.arange(len(doc))
        self.doc, self.start, self.length = doc[order], start[order], length[order]
        self.first = (number == 0)[order]
        self.last = (number == np.repeat(parts, parts) - 1)[order]
        self.following = np.where(self.last, -1, place[np.minimum(order + 1, len(doc) - 1)])
        #: rows of the n-th segments that have a next one
        self.chain = [place[np.flatnonzero((number == n) & (number < np.repeat(parts, parts) - 1))] for n in range(int(parts.max()) - 1)]
        steps = np.arange(int(self.length[0]) + 1)
        #: rows that are still going at each step
        self.alive = np.searchsorted(-self.length, -steps, side="left").tolist()
        #: the symbols, step by step, of the rows that are still going; at[t] is where those of step t begin
        self.at = np.concatenate([[0], np.cumsum(self.alive)]).tolist()
        width = np.array(self.alive[:-1], dtype=np.int64)
        row = np.arange(self.at[-1]) - np.repeat(np.array(self.at[: len(width)], dtype=np.int64), width)
        self.symbols = self.flat[self.start[row] + np.repeat(steps[:-1], width)].astype(np.int64)
        #: where in symbols the last symbol of each row stands
        self.ending = np.array(self.at, dtype=np.int64)[self.length - 1] + np.arange(len(doc))

    def take(self, shares: np.ndarray, t: int, rows: int) -> np.ndarray:
        """What shares (states x symbols) holds for the symbols of the first rows at step t."""
        return np.take(shares, self.symbols[self.at[t] : self.at[t] + rows], axis=1)


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def initial(cls, share: np.ndarray, states: int) -> Hmm:
        """From the symbols' shares, tilted differently for each state."""
        tilt = np.random.default_rng(42).uniform(0.5, 1.5, size=(len(share), states))
        emit = share[:, None] * tilt
        move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def single(self) -> Hmm:
        """In single precision, which is enough for expected counts."""
        return Hmm(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))

    def smoothed(self, added: np.ndarray, total: int) -> Hmm:
        """With `added` counts of each symbol besides the `total` tokens that emissions were learned from."""
        mixed = (total * self.emit + added[:, None]) / (total + added.sum())
        return Hmm(self.start, self.move, mixed / mixed.sum(axis=0))

    def _shares(self) -> np.ndarray:
        """The emissions (states x symbols), each symbol's largest as 1: rare words in a row would leave nothing
        between two rescalings, least of all in single precision."""
        return np.ascontiguousarray((self.emit / self.emit.max(axis=1, keepdims=True)).T)

    def _rescale(self) -> int:
        """Steps after which values are scaled anew; the least move of a large corpus, as often in a row, stays above zero."""
        return 4 if self.move.dtype == np.float32 else 16

    def _transfers(self, seg: Segments, shares: np.ndarray) -> np.ndarray:
        """For each segment with a next one (those are the longest) its matrix, up to a factor; rows come last."""
        rows = int((seg.length == SEGMENT).sum()) if seg.chain else 0
        s, turn, every = len(self.start), np.ascontiguousarray(self.move.T), self._rescale()
        x = np.broadcast_to(np.eye(s, dtype=self.move.dtype)[:, :, None], (s, s, rows)).copy()
        if rows:
            y = np.empty_like(x)
            for t in range(SEGMENT):
                np.multiply(x, seg.take(shares, t, rows), out=y)
                np.matmul(turn, y, out=x)
                if t % every == every - 1:
                    x /= x.max(axis=(0, 1))
            x /= x.max(axis=(0, 1))
        return x

    def _entries(self, seg: Segments, transfer: np.ndarray) -> np.ndarray:
        entry = np.repeat(self.start[:, None], len(seg.doc), axis=1)
        for rows in seg.chain:
            out = np.einsum("in,ijn->jn", entry[:, rows], transfer[:, :, rows])
            entry[:, seg.following[rows]] = out / out.sum(axis=0)
        return entry

    def forward(self, seg: Segments, shares: np.ndarray, transfer: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """log10 likelihood of each segment given what stands before it. keep: takes the state after each symbol, up to
        a factor."""
        state, turn, every = self._entries(seg, transfer), np.ascontiguousarray(self.move.T), self._rescale()
        log = np.zeros(len(seg.doc))
        held = np.empty_like(state)
        for t, (n, going) in enumerate(zip(seg.alive, seg.alive[1:])):
            a = held[:, :n] if keep is None else keep[:, seg.at[t] : seg.at[t] + n]
            np.multiply(state[:, :n], seg.take(shares, t, n), out=a)
            if going < n:
                log[going:n] += np.log10(a[:, going:].sum(axis=0), dtype=np.float64)
            if going:
                state = np.matmul(turn, a[:, :going], out=state[:, :going])
                if t % every == every - 1:
                    c = state.sum(axis=0)
                    state /= c
                    log[:going] += np.log10(c, dtype=np.float64)
        largest = np.log10(self.emit.max(axis=1), dtype=np.float64)
        row = np.arange(len(seg.symbols)) - np.repeat(seg.at[: len(seg.alive) - 1], seg.alive[:-1])
        return log + np.bincount(row, weights=largest[seg.symbols], minlength=len(log))

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        seg = Segments(sequences)
        shares = self._shares()
        return np.bincount(seg.doc, weights=self.forward(seg, shares, self._transfers(seg, shares)), minlength=len(sequences))

    def _backward(self, seg: Segments, shares: np.ndarray, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The value of each state before the first symbol of the segments `rows`, up to a factor."""
        length, every = seg.length[rows], self._rescale()
        value = np.ones((len(self.start), len(rows)), dtype=self.move.dtype)
        alive = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left").tolist()
        for t in range(len(alive) - 2, -1, -1):
            n, going = alive[t], alive[t + 1]
            post = np.ones((len(value), n), dtype=value.dtype)  # rows from going on have their last symbol here
            np.matmul(self.move, value[:, :going], out=post[:, :going])
            final = going + np.flatnonzero(~seg.last[rows[going:n]])
            if len(final):
                post[:, final] = self.move @ after[:, rows[final]]
            value = np.multiply(post, shares[:, seg.symbols[seg.at[t] + rows[:n]]], out=post)
            if t % every == 0:
                value /= value.sum(axis=0)
        return value / value.sum(axis=0)

    def expect(self, sequences: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Adds the expected starts, moves and emissions to counts; returns the log10 likelihood."""
        starts, moves, emissions = counts
        seg, s, every = Segments(sequences), len(self.start), self._rescale()
        shares, state = self._shares(), np.empty((s, len(seg.symbols)), dtype=self.move.dtype)
        transfer = self._transfers(seg, shares)
        likelihood = self.forward(seg, shares, transfer, state).sum()
        after = np.ones((s, len(seg.doc)), dtype=self.move.dtype)  # value of each state before the next segment's first symbol
        if seg.chain:
            ends = np.flatnonzero(seg.last & ~seg.first)
            value = np.ones((s, len(seg.doc)), dtype=self.move.dtype)
            value[:, ends] = self._backward(seg, shares, ends, after)
            for rows in reversed(seg.chain):
                after[:, rows] = value[:, seg.following[rows]]
                out = np.einsum("ijn,jn->in", transfer[:, :, rows], after[:, rows])
                value[:, rows] = out / out.sum(axis=0)
        # following: value of each state before the next symbol; post: of each state at a symbol, for what comes after it
        following, post = np.empty_like(state), np.empty_like(state)
        for t in range(len(seg.alive) - 2, -1, -1):
            n, going, at, then = seg.alive[t], seg.alive[t + 1], seg.at[t], seg.at[t + 1]
            x = following[:, at : at + n]
            if going:
                np.multiply(post[:, then : then + going], seg.take(shares, t + 1, going), out=x[:, :going])
                if t % every == 0:
                    x[:, :going] /= x[:, :going].sum(axis=0)
            x[:, going:] = after[:, going:n]
            np.matmul(self.move, x, out=post[:, at : at + n])
            if going < n:
                post[:, at + going + np.flatnonzero(seg.last[going:n])] = 1
        joint = np.multiply(state, post, out=post)
        norm = joint.sum(axis=0)
        weak = np.flatnonzero(~(norm > LEAST))
        if len(weak):  # both sides are small between two rescalings
            final = np.isin(weak, seg.ending[seg.last])
            state[:, weak] /= state[:, weak].max(axis=0)
            following[:, weak] /= following[:, weak].max(axis=0)
            joint[:, weak] = state[:, weak] * np.where(final, 1, self.move @ following[:, weak])
            norm[weak] = joint[:, weak].sum(axis=0)
        joint /= norm
        state /= norm
        state[:, seg.ending[seg.last]] = 0
        moves += self.move * (state @ following.T)
        starts += joint[:, : seg.alive[0]][:, seg.first].sum(axis=1)
        for k in range(s):
            emissions[:, k] += np.bincount(seg.symbols, weights=joint[k], minlength=len(emissions))
        return float(likelihood)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place in them of each word of the texts, number of words of each text) as tokens() finds
    them; a null text has none."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = pieces.flatten().dictionary_encode()
    codes, lengths = found.indices.to_numpy(), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy().astype(np.int64)
    empty = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    if empty < 0:
        return found.dictionary, codes, lengths
    # white space at either end of a text leaves an empty piece there
    word = codes != empty
    ends = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(lengths)])]
    codes = codes[word]
    words = pa.concat_arrays([found.dictionary[:empty], found.dictionary[empty + 1 :]])
    return words, codes - (codes > empty), np.diff(ends)


def listed_bytes(words: pa.Array) -> list[bytes]:
    """By way of NumPy, as to_pylist() makes a scalar for each word first."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows; words are counted within tasks before the shuffle."""

    def run(batches):
        held, size = [], 0
        for batch in text_batches(batches, text=0):
            words, codes, _ = coded(batch.column(0))
            held.append(pa.table([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], ["word", "c"]))
            size += len(words)
            if size > 2 * HELD:
                held = [_added(held)]
                size = held[0].num_rows
                if size > HELD:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    rows = docs.select(text_col).mapInArrow(run, "word string, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def _added(counts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("c", "sum")])
    return pa.table([found.column("word"), found.column("c_sum")], ["word", "c"])


@dataclass
class Lexicon:
    """words: the most frequent, most frequent first, with their counts. The first `symbols` of them are
    symbols of the model; the counts of the others are kept only to spare the join. class_total and
    class_distinct: tokens and words of each class of words that are no symbols."""

    words: list[bytes]
    counts: np.ndarray
    symbols: int
    total: int  # tokens, ends included
    distinct: int  # end included
    texts: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        self.listed_class = np.array([word_class(w, self.classes) for w in self.words[self.symbols :]], dtype=np.int64)

    @property
    def classes(self) -> int:
        return len(self.class_total)

    @property
    def end(self) -> int:
        return self.symbols + self.classes

    def share(self) -> np.ndarray:
        seen = np.concatenate([self.counts[: self.symbols], self.class_total, [self.texts]]) + 1.0
        return seen / seen.sum()

    def added(self) -> np.ndarray:
        """What add-one smoothing adds to each symbol: one for each of its words, one for the unknown words of a class."""
        return np.concatenate([np.ones(self.symbols), self.class_distinct + 1.0, [1.0]])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word, -1 for those not listed; the symbols of the words and of the end)."""
        get = self.index.get
        index = np.array([get(w, -1) for w in words], dtype=np.int64)
        out = np.append(index, self.end)
        listed = np.flatnonzero(index >= self.symbols)
        out[listed] = self.symbols + self.listed_class[index[listed] - self.symbols]
        for i in np.flatnonzero(index < 0).tolist():
            out[i] = self.symbols + word_class(words[i], self.classes)
        return index, out


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word) % classes


def _lexicon(shared) -> Lexicon:
    """The lexicon of a broadcast (key, fields)."""
    key, fields = shared.value
    return kept(key, lambda: Lexicon(*fields))


class Model:
    """A trained model: lexicon, parameters, the table of all word counts for rarer words, and the log10
    likelihood of the training texts before each round."""

    def __init__(self, key: str, lexicon: tuple, hmm: Hmm, counts: DataFrame, scratch: Scratch, likelihoods: list[float]):
        self.key, self.fields, self.hmm, self.counts, self.scratch, self.likelihoods = key, lexicon, hmm, counts, scratch, likelihoods
        self.lexicon = Lexicon(*lexicon)
        #: how the symbols of a text are written
        self.kind = "<u2" if self.lexicon.end < 1 << 16 else "<u4"


def learn_lexicon(counts: DataFrame, texts: int, symbols: int, cached: int, classes: int) -> tuple:
    """The fields of the Lexicon from all word counts. Only the `cached` most frequent words and the sums of the
    classes reach the driver. There are no more classes than rarer words, one at least: each sets aside a share for
    unknown words."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "word", "c", cached).toArrow()
    words, sizes = top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-sizes[i], words[i]))
    words, sizes = [words[i] for i in order], sizes[order].astype(np.int64) if order else np.empty(0, dtype=np.int64)
    symbols = min(symbols, len(words))
    classes = min(classes, max(1, distinct - symbols))
    class_total, class_distinct = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
    for r in counts.groupBy((F.crc32(F.col("word").cast("binary")) % classes).alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_total[r["class"]], class_distinct[r["class"]] = r["c"], r["n"]
    own = np.array([word_class(w, classes) for w in words[:symbols]], dtype=np.int64)
    np.subtract.at(class_total, own, sizes[:symbols])
    np.subtract.at(class_distinct, own, 1)
    return words, sizes, symbols, total + texts, distinct + bool(texts), texts, class_total, class_distinct


def _begin(docs: DataFrame, states: int, symbols: int, cached: int, classes: int, text_col: str) -> Model:
    """A model of the words of docs before its first round."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(word_counts(docs, text_col), "counts")
    fields = learn_lexicon(counts, docs.count(), symbols, cached, classes)
    return Model(uuid.uuid4().hex, fields, Hmm.initial(Lexicon(*fields).share(), states), counts, scratch, [])


def _encode(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The other columns of docs with the symbols of each text, its counts, its base score and what its listed rare
    words add to the score of their classes, both without the words in `others`, which the lexicon doesn't list."""
    shared, kind = docs.sparkSession.sparkContext.broadcast((model.key, model.fields)), np.dtype(model.kind)
    rest = [(c, t) for c, t in docs.dtypes if c != text_col]

    def run(batches):
        lex = _lexicon(shared)
        known_log, class_log = np.log10(lex.counts + 1.0), np.log10(lex.class_total + lex.class_distinct + 1.0)
        all_log, end_log = np.log10(lex.total + lex.distinct + 1.0), np.log10(lex.texts + 1.0)
        for batch in text_batches(batches, text=0):
            words, codes, lengths = coded(batch.column(0))
            index, symbols = lex.encode(listed_bytes(words))
            symbols, listed, n = symbols[:-1], index >= 0, batch.num_rows
            known, rare = np.zeros(len(words)), np.zeros(len(words))
            known[listed] = known_log[index[listed]]
            rare[symbols >= lex.symbols] = -class_log[symbols[symbols >= lex.symbols] - lex.symbols]
            rare[index >= lex.symbols] += known_log[index[index >= lex.symbols]]
            text = np.repeat(np.arange(n), lengths)
            base = np.bincount(text, weights=known[codes], minlength=n) + end_log - (lengths + 1.0) * all_log
            n_known = np.bincount(text[listed[codes]], minlength=n) + (lex.texts > 0)
            written = np.full(len(codes) + n, lex.end, dtype=kind)
            written[np.arange(len(codes)) + text] = symbols[codes]
            ends = np.concatenate([[0], np.cumsum(lengths + 1)]) * kind.itemsize
            other = ~listed[codes]
            pairs, times = np.unique(text[other] * np.int64(len(words)) + codes[other], return_counts=True)
            at, word = np.divmod(pairs, max(len(words), 1))
            others = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:], pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(written)]),
                    pa.array(lengths + 1), pa.array(n_known), pa.array(base), pa.array(np.bincount(text, weights=rare[codes], minlength=n).astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), others),
                ],
                [*[c for c, _ in rest], "symbols", "n_tokens", "n_known", "base_score", "rare", "others"],
            )

    schema = "".join(f"`{c}` {t}, " for c, t in rest) + "symbols binary, n_tokens bigint, n_known bigint, base_score double, rare double, others array<struct<word string, n bigint>>"
    return docs.select(text_col, *[c for c, _ in rest]).mapInArrow(run, schema)


def _sequences(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=kind) for v in column.to_pylist()]


def _fit(encoded: DataFrame, model: Model, rounds: int, least_gain: float, prior: float) -> None:
    """Rounds of Baum-Welch over the symbols in encoded."""
    spark, lexicon, kind, (size, states) = encoded.sparkSession, model.lexicon, model.kind, model.hmm.emit.shape
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds if lexicon.texts else 0):
        now = spark.sparkContext.broadcast(model.hmm.single())

        def run(batches, now=now):
            hmm, likelihood = now.value, 0.0
            sums = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            for batch in text_batches(batches, text=0, limit=np.dtype(kind).itemsize * STEP):
                likelihood += hmm.expect(_sequences(batch.column(0), kind), sums)
            # rows below the symbols hold starts, moves and the likelihood
            rows = np.concatenate([sums[2], sums[0][None], sums[1], np.full((1, states), likelihood)])
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[at, k]) for k in range(states))], ["row", *names])

        parts = encoded.select("symbols").mapInArrow(run, "row bigint, " + ", ".join(f"{n} double" for n in names))
        found = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        rows = np.zeros((size + 2 + states, states))
        rows[found["row"].to_numpy()] = found[names].to_numpy()
        emit = rows[:size] + prior * states * lexicon.share()[:, None]
        start, move = rows[size] + prior, rows[size + 1 : -1] + prior
        model.hmm = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        model.likelihoods.append(float(rows[-1, 0]))
        if len(model.likelihoods) > 1 and model.likelihoods[-1] - model.likelihoods[-2] < least_gain * lexicon.total:
            break


def train(docs: DataFrame, states: int = 6, symbols: int = 1 << 15, cached: int = 1 << 17, classes: int = 1 << 12, rounds: int = 3, least_gain: float = 1e-4, prior: float = 0.5, text_col: str = "text") -> Model:
    """Baum-Welch over every row of docs; a null text counts as empty.

    Word counts of the whole corpus stay a table. The `cached` most frequent words go to the tasks, the
    first `symbols` of them as symbols of the model; all other words, however many, fall into `classes`
    classes by their hash. So every word takes part in training, and model and broadcast don't grow with the
    corpus. Texts are encoded once, into a table. In each round every task sums its expected counts; they are
    added up by a group-by over symbols, and only the sums (symbols x states) reach the driver. Training ends
    after `rounds`, or before if the last round raised the log10 likelihood of all training texts by less
    than least_gain for each token. prior: weight of a symbol's share, in counts.
    """
    model = _begin(docs, states, symbols, cached, classes, text_col)
    _fit(model.scratch.save(_encode(docs.select(text_col), model, text_col).select("symbols"), "encoded"), model, rounds, least_gain, prior)
    return model


def train_and_score(docs: DataFrame, learn: Column, states: int = 6, symbols: int = 1 << 15, cached: int = 1 << 17, classes: int = 1 << 12, rounds: int = 3, least_gain: float = 1e-4, prior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score(docs, train(docs.where(learn))), but each text is encoded once for both."""
    model = _begin(docs.where(learn), states, symbols, cached, classes, text_col)
    marked = _mark(docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text")), model)
    _fit(marked.where("learn"), model, rounds, least_gain, prior)
    return _score(marked, model, id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    score: log10 probability of the whole text by the forward recursion. Emissions are smoothed as the base is, by one
    for each word: what training never saw in a state, or at all, keeps about the base's share. base_score: the add-one unigram
    score. Counts of words outside the broadcast lexicon come from a join on the word with the table of
    all counts; a hot word's rows may be split by Spark. Null and empty texts score their end alone.
    Repeated rows repeat. If nothing was learned, every word has count 0.
    """
    return _score(_mark(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model), model, id_col)


def _mark(rows: DataFrame, model: Model) -> DataFrame:
    return model.scratch.save(_encode(rows, model, "text").withColumn("row", F.monotonically_increasing_id()), "marked")


def _score(marked: DataFrame, model: Model, id_col: str) -> DataFrame:
    lexicon, symbols = model.lexicon, model.kind
    hmm = marked.sparkSession.sparkContext.broadcast(model.hmm.smoothed(lexicon.added(), lexicon.total))
    kind = marked.select("id").dtypes[0][1]

    def run(batches):
        for batch in text_batches(batches, text=0, limit=np.dtype(symbols).itemsize * STEP):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hmm.value.log10_likelihood(_sequences(batch.column(0), symbols)))], names)

    words = marked.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n").join(model.counts, "word")
    found = words.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
    names = ["row", "id", "n_tokens", "n_known", "base_score", "rare", "log"]
    scored = marked.select("symbols", *names[:-1]).mapInArrow(run, f"row bigint, id {kind}, n_tokens bigint, n_known bigint, base_score double, rare double, log double")
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("bigint").alias("train_tokens"), (F.col("base_score") + gain).alias("base_score"), (F.col("log") + F.col("rare") + gain).alias("score"),
    )
