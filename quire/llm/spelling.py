"""Spelling variants: words one edit apart by blocked Gram matrices of letter counts.

Words of one length whose letters fall into GROUPS groups equally often make a block. One edit moves at most one
letter from a group to another, or adds or removes one, so all near words of a block are in it and in a few
neighbouring blocks of the same and of adjacent lengths. For two blocks a product of their letter-count matrices
gives all squared distances; pairs of at most two are verified letter by letter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, settle, small_batches

#: Letters of words: A to Z in lower case, and U+00C0 to U+00FF as they are. All are single bytes in Latin-1.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Code points of the shortest word, occurrences of the rarest, and how many times as frequent a word's form is.
SHORTEST, RAREST, RATIO = 6, 5, 5
#: One in so many runs of letters loses a letter.
TYPO = 199
#: Groups of letters (by code point) that make a block's key.
GROUPS = 4
#: Characters of a part of a block, counting OVERHEAD more for each word, and cells of a step of verification.
PART, OVERHEAD, CELLS = 32_768, 16, 1 << 22
#: Length up to which squared distances are exact in single precision: 4096**2 = 2**24.
SINGLE = 4096

KEY = [f"g{k}" for k in range(GROUPS)]
#: From a block to those that hold near words, each unordered pair of blocks once.
STEPS = [tuple(0 for _ in KEY)]
STEPS += [tuple((k == a) - (k == b) for k in range(GROUPS)) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
STEPS += [tuple(int(k == a) for k in range(GROUPS)) for a in range(GROUPS)]


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; other letters stay."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, UPPER, LOWER))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of at least SHORTEST code points that occurs RAREST times or more.

    Words are the maximal runs of letters of whole texts; where TYPO divides the crc32 of `id:run`, the run's code
    point at crc32 mod length is left out. Null and empty texts have none; a null id counts as an empty one.
    """
    # a run that is too short can't give a word that is long enough
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{SHORTEST},}}"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", lower_ascii(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % TYPO == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def _keyed(words: DataFrame) -> DataFrame:
    """The words with how many of their letters are of each group."""
    held = ["".join(c for c in LETTERS if ord(c) % GROUPS == k) for k in range(GROUPS)]
    return words.select("*", *[(F.length("word") - F.length(F.translate("word", h, ""))).alias(k) for k, h in zip(KEY, held)])


_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[np.frombuffer(LETTERS.encode("latin-1"), dtype=np.uint8)] = np.arange(len(LETTERS))


class Part:
    """Words of one length with their counts, as letters and as letter counts."""

    def __init__(self, words: str, ns: np.ndarray):
        self.n = ns
        self.letters = np.frombuffer(words.encode("latin-1"), dtype=np.uint8).reshape(len(ns), -1)
        size, length = self.letters.shape
        cells = _COLUMN[self.letters] + len(LETTERS) * np.arange(size)[:, None]
        self.counts = np.bincount(cells.ravel(), minlength=size * len(LETTERS)).reshape(size, -1).astype(np.float32 if length <= SINGLE else np.float64)
        self.square = (self.counts**2).sum(axis=1)

    def word(self, k: int) -> str:
        return self.letters[k].tobytes().decode("latin-1")


def near_pairs(x: Part, y: Part, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of words of x and y that differ by one edit; i < j only if both are the same part. y's words are as
    long as those of x or one longer."""
    distance = x.square[:, None] + y.square[None, :] - 2 * (x.counts @ y.counts.T)
    i, j = np.nonzero(distance <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    length, longer = x.letters.shape[1], y.letters.shape[1] - x.letters.shape[1]
    keep = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), step := max(1, CELLS // length)):
        a, b = x.letters[i[k : k + step]], y.letters[j[k : k + step]]
        if longer:  # a and b agree up to the letter that b has more, and from there on
            begin = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            end = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            keep[k : k + step] = begin + end >= length
        else:
            keep[k : k + step] = (a != b).sum(axis=1) == 1
    return i[keep], j[keep]


def _best(of: Part, other: Part, i: np.ndarray, j: np.ndarray):
    """(word, near words, the most frequent of them, its count) for each word i of `of` that has near words j."""
    at = np.lexsort((j, -other.n[j], i))  # words of a part are sorted, so the smaller j is the smaller word
    word, first, count = np.unique(i[at], return_index=True, return_counts=True)
    for w, f, c in zip(word.tolist(), at[first].tolist(), count.tolist()):
        yield of.word(w), c, other.word(j[f]), int(other.n[j[f]])


LINKS = "word string, n_near bigint, near string, near_n bigint"


def _compare(batches):
    """Links of each pair of parts, added up for each word."""
    for batch in batches:
        columns = [batch.column(c) for c in ("words", "ns", "other_words", "other_ns", "same")]
        found: list[tuple] = []
        for row in range(batch.num_rows):
            words, ns, others, other_ns, same = (c[row] for c in columns)
            x = Part(words.as_py(), ns.values.to_numpy())
            y = x if same.as_py() else Part(others.as_py(), other_ns.values.to_numpy())
            i, j = near_pairs(x, y, same.as_py())
            if same.as_py():
                found += _best(x, x, np.concatenate([i, j]), np.concatenate([j, i]))
            elif len(i):
                found += [*_best(x, y, i, j), *_best(y, x, j, i)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "near", "near_n"])
        settle()


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, near, near_n): for each of the distinct words that has near ones how many, and the most
    frequent of them (of equal ones the smallest). Words consist of LETTERS.

    A block is dealt by hash into parts of about PART characters, so a task never holds more than two of them; a
    pair of parts is one row, and gives one row for each word with near ones, never the pairs.
    """
    small_batches(words.sparkSession, 500)  # a row holds two parts
    keyed = scratch.save(_keyed(words), "words")
    blocks = keyed.groupBy(*KEY).agg(F.ceil(F.sum(F.length("word") + OVERHEAD) / PART).alias("parts"))
    blocks = scratch.save(blocks, "blocks")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).alias("part")
    dealt = keyed.join(blocks, KEY).select(*KEY, part, "word", "n")
    packed = dealt.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
    packed = scratch.save(packed.select(*KEY, "part", F.array_join("w.word", "").alias("words"), F.col("w.n").alias("ns")), "parts")
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), *[(F.col(c) + d).alias(f"t{c}") for c, d in zip(KEY, step)]) for k, step in enumerate(STEPS)]))
    pairs = packed.select("words", "ns", "part", steps.alias("to")).select("words", "ns", "part", "to.*")
    pairs = pairs.join(blocks.select(*[F.col(c).alias(f"t{c}") for c in KEY], "parts"), [f"t{c}" for c in KEY])
    first = F.when(F.col("step") == 0, F.col("part")).otherwise(F.lit(0).cast("bigint"))
    pairs = pairs.select("*", F.explode(F.sequence(first, F.col("parts") - 1)).alias("tpart"))
    others = packed.select(*[F.col(c).alias(f"t{c}") for c in KEY], F.col("part").alias("tpart"), F.col("words").alias("other_words"), F.col("ns").alias("other_ns"))
    pairs = pairs.join(others, [*[f"t{c}" for c in KEY], "tpart"]).select("words", "ns", "other_words", "other_ns", ((F.col("step") == 0) & (F.col("part") == F.col("tpart"))).alias("same"))
    links = pairs.mapInArrow(_compare, LINKS).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    return links.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of word_counts.

    form is the most frequent near word (ties: the smallest) if it is at least RATIO times as frequent as the word,
    else null, form_n its count; root is the last form on the way from the word over its form, and the word itself
    where it has none. Counts rise by RATIO at each step, so ways are short, and no way comes back; they are climbed
    by doubling. Empty input, or one without words, gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.save(word_counts(docs, id_col, text_col), "counts")
    links = near_words(words, scratch)
    formed = F.col("near_n") >= RATIO * F.col("n")
    found = words.join(links, "word", "left").select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"))
    found = scratch.save(found, "found")
    most = found.agg(F.max("n")).first()[0] or 1
    steps, longest = found.where("form is not null").select("word", F.col("form").alias("root")), math.log(most, RATIO) + 1
    for k in range(math.ceil(math.log2(longest + 1))):
        steps = scratch.save(steps, f"steps-{k}")
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("then"))
        steps = steps.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"))
    out = found.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
