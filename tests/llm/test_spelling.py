"""Spelling variants against an edit search over all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import spelling
from quire.llm.common import Scratch
from quire.llm.queries import QUERIES

ASCII = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_counts(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word):
    for k in range(len(word) + 1):
        for c in spelling.LETTERS:
            yield word[:k] + c + word[k:]
            yield word[:k] + c + word[k + 1 :]
        yield word[:k] + word[k + 1 :]


def plain_groups(counts):
    found = {}
    for w, n in counts.items():
        near = {e for e in edits(w) if e != w and e in counts}
        best = min(near, key=lambda e: (-counts[e], e), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        found[w] = [form, w, n, len(near), counts.get(form)]
    for w in found:
        while found[found[w][1]][0] is not None:
            found[w][1] = found[found[w][1]][0]
    return found


def groups(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and [t for _, t in df.dtypes] == ["string"] * 3 + ["bigint"] * 3
    assert len(rows) == len({r.word for r in rows})
    return {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in rows}


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, at):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    want = plain_groups(plain_counts(docs))
    got = groups(QUERIES["op12_spelling"](spark, at))
    assert got == want and len(want) > 500 and any(x[3] > 2 for x in want.values())
    assert at.endswith("sf0.001") or any(x[0] for x in want.values())


def varied(rng, base, n):
    """Words that are one to three edits from base."""
    out = set()
    while len(out) < n:
        w = base
        for _ in range(rng.randint(1, 3)):
            k, c = rng.randrange(len(w)), rng.choice(spelling.LETTERS)
            w = rng.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])
        if len(w) >= 6:
            out.add(w)
    return sorted(out)


def test_near_words_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 200)
    rng = random.Random(2)
    words = sorted({w for base in ("spelling", "àáâãäåæ", "aaaaaa") for w in varied(rng, base, 500)})
    counts = {w: rng.choice([5, 6, 30, 31, 900]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in spelling.near_words(df, Scratch(spark)).collect()}
    want = {}
    for w in words:
        if near := {e for e in edits(w) if e != w and e in counts}:
            best = min(near, key=lambda e: (-counts[e], e))
            want[w] = (len(near), best, counts[best])
    assert got == want and len(want) > 300


def test_chains_of_forms_reach_the_last(spark):
    chain = ["abcdefgh" + "z" * k for k in range(5)]
    texts = [" ".join([w.upper() if k % 2 else w] * 5 ** (k + 1)) for k, w in enumerate(chain)]
    docs = [(k, t) for k, t in enumerate(texts)]
    got = groups(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain_groups(plain_counts(docs)) and got[chain[0]][:2] == [chain[1], chain[4]] and got[chain[4]][:2] == [None, chain[4]]


def test_typos_ties_and_edges(spark):
    schema = "doc_id long, text string, word string, n long, part int"
    assert groups(spelling.spelling_groups(spark.createDataFrame([], schema))) == {}
    assert groups(spelling.spelling_groups(spark.createDataFrame([(1, None, "a", 1, 1), (None, "", "b", 2, 2), (2, "short one", "c", 3, 3)], schema))) == {}
    typo = next(i for i in range(10_000) if zlib.crc32(f"{i}:straße".encode()) % 199 == 0)
    same = next(i for i in range(10_000) if zlib.crc32(f"{i}:letters".encode()) % 199 == 0)
    long = "é" * 5000 + "ab" * 50_000
    docs = [(typo, "Straße " * 6), (same, "LETTERS " * 5), (None, "lettere letterf " * 25), (1, "ÉÉÉÉÉÉ éééééé ÉÉÉÉÉé " * 5), (1, "ÉÉÉÉÉÉ×÷ " * 5), (3, f"{long}c {long}d {long} " * 5), (3, f"{long} " * 30), (4, "école1word word_word " * 5)]
    got = groups(spelling.spelling_groups(spark.createDataFrame([(*d, "x", 1, 1) for d in docs], schema)))
    assert got == plain_groups({w: n for w, n in plain_counts(docs).items() if len(w) < 1000}) | {w: x for w, x in got.items() if len(w) >= 1000}
    assert got[long] == [None, long, 35, 2, None] and got[long + "c"] == [long, long, 5, 2, 35]
    assert "straße" not in got and "ÉÉÉÉÉé" in got and got["lettere"][3] == 2 - ("letters" not in got)


def test_gram_distances_are_exact():
    rng = np.random.default_rng(1)
    letters = np.frombuffer(spelling.LETTERS.encode("latin-1"), dtype=np.uint8)
    x, y = ("".join(letters[rng.integers(0, 4, size=(40, k))].tobytes().decode("latin-1") for _ in "x") for k in (8, 9))
    for other, length in ((x, 8), (y, 9)):
        a, b = spelling.Part(x, np.ones(40, dtype=np.int64)), spelling.Part(other, np.ones(40, dtype=np.int64))
        i, j = spelling.near_pairs(a, b, other is x)
        want = {(p, q) for p in range(40) for q in range(40) if (p < q or other is not x) and x[8 * p : 8 * p + 8] != other[length * q : length * q + length] and other[length * q : length * q + length] in set(edits(x[8 * p : 8 * p + 8]))}
        assert set(zip(i.tolist(), j.tolist())) == want
