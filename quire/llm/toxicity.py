"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings. Features are screened by how differently
they occur in the two classes. For every training text that mentions identity groups, the mentions are
swapped twice: for another group of the same kind, and for a word that names nobody in particular, which is
no feature. The squared changes of the model's logit under the swaps are added to the loss. The first makes
groups alike; it alone would let all of them carry a score together. With the second, a group's name as such
cannot carry one, whatever company it keeps in the labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, text_batches

#: Identity terms; those of one tuple stand for each other.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "buddhist", "hindu", "atheist"), ("muslims", "christians", "jews", "buddhists", "hindus", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american"), ("immigrants", "natives"), ("disabled", "able"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("schwul", "hetero"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "citoyens"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "ciudadanos"), ("negros", "blancos"),
)
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: Texts that a feature must be in to be looked at.
FEW = 5
#: Words whose features a task remembers.
MEMO = 200_000


def features_of(word: str) -> tuple[str, ...]:
    return (f"={word}", *(word[:n] for n in STEMS if len(word) >= n))


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(words: set[str], groups=IDENTITIES) -> list[set[str]]:
    """The words with each identity term replaced by the next of its group, and with none in its place; nothing if
    there is no such term."""
    to = {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}
    return [{to.get(w, w) for w in words}, words - to.keys()] if words & to.keys() else []


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, words: set[str], memo: dict[str, tuple[str, ...]]) -> float:
        found = set()
        weights = self.weights
        for word in words:
            hit = memo.get(word)
            if hit is None:
                if len(memo) >= MEMO:
                    memo.clear()
                hit = memo[word] = tuple(f for f in features_of(word) if f in weights)
            if hit:
                found.update(hit)
        return self.bias + sum(weights[f] for f in sorted(found))


def fit(rows: list[tuple[int, list[int], list[list[int]]]], size: int, prior: float, penalty: float, ridge: float = 1e-3, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression on sparse rows (label, features, features after each swap).

    Classes are weighted back to `prior`, the share of label 1 among all training labels.
    """

    def sparse(lists):
        return np.concatenate([np.array(x, dtype=np.int64) for x in lists] or [np.empty(0, dtype=np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    y = np.array([r[0] for r in rows], dtype=np.float64)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    col, row = sparse([r[1] for r in rows])
    pairs = [(r[1], other) for r in rows for other in r[2]]
    plus, minus = sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.append(np.bincount(col, weights=g[row], minlength=size) + ridge * w, g.sum())
        if pairs:
            change = (np.bincount(plus[1], weights=w[plus[0]], minlength=len(pairs)) - np.bincount(minus[1], weights=w[minus[0]], minlength=len(pairs))) * (2 * penalty / len(pairs))
            grad[:size] += np.bincount(plus[0], weights=change[plus[1]], minlength=size) - np.bincount(minus[0], weights=change[minus[1]], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * min(1.0, 2 * (1 - step / (steps + 1)))
        w, b = w - move[:size], b - move[size]
    return b, w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, least_z: float = 4.0, least_lift: float = 2.0, penalty: float = 1.0, groups=IDENTITIES) -> Model:
    """A model from the documents of `labels` (doc_id, toxic).

    At most max_rows documents of each class are used, those with the smallest hash of their id; the share
    of the classes in all given labels sets the prior. Features are counted on the executors; all of at least
    FEW texts whose class shares differ by least_z standard errors and the factor least_lift are kept. Only
    kept features and index lists of the bounded sample reach the driver. A document labelled
    twice counts as toxic if any label says so; labels other than 0 and 1 are ignored. Without both
    classes the model is a constant.
    """
    scratch = Scratch(docs.sparkSession)
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = marks.agg(F.sum("toxic"), F.count("*")).first()
    ones, total = int(share[0] or 0), int(share[1])
    if not 0 < ones < total:
        return Model(30.0 if ones else -30.0)
    picked = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    sample = scratch.save(sample, "sample")

    def count(batches):
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in text_batches(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[label].update({f for w in words_of(text) for f in features_of(w)})
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in sums)], ["feature", "n0", "n1"])

    sizes = dict(sample.groupBy("toxic").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(float(np.log(ones / (total - ones))))
    counts = sample.mapInArrow(count, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    share0, share1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    lift = F.greatest(share1 / share0, share0 / share1)
    kept = counts.where(F.col("n0") + F.col("n1") >= FEW).where((lift >= least_lift) & (F.abs(z) >= least_z))
    names = sorted(r[0] for r in kept.select("feature").collect())
    terms = {f for group in groups for term in group for f in features_of(term)}
    index = {f: i for i, f in enumerate([*names, *sorted(terms - set(names))])}

    def rows(batches):
        for batch in text_batches(batches):
            own, other = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                known = lambda some: sorted({index[f] for w in some for f in features_of(w) if f in index})
                own.append(known(words))
                other.append([known(some) for some in swapped(words, groups)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "other"])

    data = [(r[0], r[1], r[2]) for r in sample.mapInArrow(rows, "toxic int, own array<int>, other array<array<int>>").collect()]
    data.sort()
    bias, weights = fit(data, len(index), ones / total, penalty)
    return Model(float(bias), {f: float(weights[i]) for f, i in index.items() if weights[i]})


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row: the probability of label 1, and 1 where it reaches threshold.

    Whole texts are scored; a null or empty text has the score of a text without features. Repeated rows
    repeat. No shuffle; the model, whose features all come from the bounded sample, goes with the function.
    """
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches):
        memo: dict[str, tuple[str, ...]] = {}
        for batch in text_batches(batches):
            z = np.array([model.logit(words_of(t or ""), memo) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
