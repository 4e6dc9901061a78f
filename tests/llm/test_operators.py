"""The training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, hmm, langid, license_texts, licenses, linededup, queries, secrets, simhash, textmatch, toxicity, vectors
from quire.llm.common import Scratch, connected_components, held_out, most_frequent
from quire.llm.queries import QUERIES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = "doc_id long, text string, lang string, score string"
EDGE_ROWS = [(1, None, None, "x"), (2, "", "en", None), (3, "  \n\t ", "en", None), (4, "hello world again", "en", "x"), (4, "hello world again", "en", "x"), (5, "é" * 50_000, "fr", None), (None, "no id", "en", None), (6, "a\nb\n\nhello world again", "en", None)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


# --- shared ---


def test_components_match_union_find(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 400), (30, 0)):
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 140)] if m else [])
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()}
        assert got == {x: find(x) for x in parent}


def test_most_frequent_fills_its_limit_with_ties(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1) + 1) for i in range(500)], "word string, c long")
    for limit in (50, 200, 499):
        got, all_ = most_frequent(counts, "word", "c", limit).collect(), sorted((1000 // (i + 1) + 1 for i in range(500)), reverse=True)
        assert limit - 6 <= len(got) <= limit and sorted((r.c for r in got), reverse=True) == all_[: len(got)]
    assert most_frequent(counts, "word", "c", 1000).count() == 500
    ties = spark.createDataFrame([(f"w{i}", 1) for i in range(100)], "word string, c long")
    assert 45 <= most_frequent(ties, "word", "c", 50).count() <= 50
    assert most_frequent(ties.limit(0), "word", "c", 50).count() == 0


# --- 1 ---


def test_language_codes_are_exact(texts):
    rows = [(("ab"[i % 2]), t.encode()[:3000]) for i, t in enumerate(list(texts.values())[:30])]
    grams = Counter()
    for lang, t in rows:
        b = langid.LEAD + t
        for i in range(3, len(b)):
            grams[(lang, b[i - 3 : i + 1])] += 1
    keys = sorted(grams)
    stats = langid.Statistics(["a", "b"], np.array(["ab".index(k[0]) for k in keys]), np.array([int.from_bytes(k[1], "big") for k in keys]), np.array([grams[k] for k in keys], dtype=float))
    trees = langid.ContextTrees(stats, 10**9)
    used = {10} | {x for _, g in keys for x in g}

    def cost(lang, text):
        total, b = 0.0, langid.LEAD + text
        for i in range(3, len(b)):
            excluded = set()
            for order in (3, 2, 1, 0):
                seen = Counter()
                for (who, g), n in grams.items():
                    if who == lang and g[3 - order : 3] == b[i - order : i]:
                        seen[g[3]] += n
                live = {s: n for s, n in seen.items() if s not in excluded}
                bottom = sum(live.values()) + len(live)
                if b[i] in live:
                    total -= np.log2(live[b[i]] / bottom)
                    break
                if live:
                    total -= np.log2(len(live) / bottom)
                excluded |= set(live)
            else:
                total += np.log2(max(1, len(used) + 1 - len(excluded)))
        return total

    for text in (rows[0][1][:12], b"\xff\x00q!"):
        got = trees.bits([b"xyz", text, b""])
        assert np.allclose(got[1], [cost("a", text), cost("b", text)], atol=1e-3) and not got[2].any()


def test_language_nodes_of_all_contexts():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(97, 123, size=(60_000, 4)) @ (1 << np.array([24, 16, 8, 0])))
    lang = np.repeat([0, 1], len(grams))
    stats = langid.Statistics(["a", "b"], lang, np.tile(grams, 2), rng.integers(1, 9, size=len(lang)).astype(float))
    assert len(np.unique(grams >> 8)) > 8192
    some = [bytes(rng.integers(96, 124, size=500).astype(np.uint8)) for _ in range(20)]
    want = langid.ContextTrees(stats, 10**9).bits(some)
    for trees in (langid.ContextTrees(stats), langid.ContextTrees(stats, 1)):
        assert np.allclose(trees.bits(some), want)


def test_small_language_stays_beside_a_large_one(spark):
    noise = bytes(np.random.default_rng(4).integers(48, 112, size=1_300_000).astype(np.uint8)).decode()
    stats = langid.train(spark.createDataFrame([("large", noise), ("small", "tvrtko zna put")], "lang string, text string"))
    assert stats.langs == ["large", "small"] and (stats.lang == 0).sum() > 1_000_000 and (stats.lang == 1).sum() == 14


def test_language_held_out_accuracy(docs):
    stats = langid.train(docs.where(~held_out(F.col("doc_id"), 4)))
    got = docs.where(held_out(F.col("doc_id"), 4)).select("doc_id", "lang", "text")
    found = langid.identify(got, stats).join(got.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_language_ties_take_the_first_name(spark):
    rows = [("zz", "same words in both"), ("aa", "same words in both")]
    stats = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    got = langid.identify(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), stats).first()
    assert got.lang_pred == "aa" and abs(got.score - 0.5) < 1e-9


def test_language_edges(edge, empty, docs):
    stats = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edge, stats).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert langid.identify(empty, stats).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, langid.train(empty)).collect()} == {"und"}


# --- 2 ---


def fit_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark, sf, texts):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    passages, rng, norm = decontaminate.Passages(items, 8, 0.1), random.Random(3), lambda t: " ".join(t.lower().split())
    pool = list(texts.values())
    for _ in range(40):
        k = rng.randrange(len(items))
        s = list(items[k])
        for _ in range(rng.randint(0, int(len(s) * 0.14))):
            at = rng.randrange(len(s))
            rng.choice([lambda: s.__setitem__(at, rng.choice("abcé")), lambda: s.insert(at, "x"), lambda: s.pop(at)])()
        text = rng.choice(pool)[:200] + " " + "".join(s).upper() + "\n " + rng.choice(pool)[:150]
        edits = fit_edits(norm(items[k]), norm(text))
        found = {x[1]: x for x in passages.find([text])}
        assert (found[k][4] if k in found else None) == (edits if edits <= passages.budget[k] else None)
        if k in found:
            part = norm(text[found[k][2] : found[k][3]])
            assert fit_edits(norm(items[k]), part) == edits


def test_leaks_of_whole_corpus(spark, sf, docs, texts):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_spans(docs, bench).where("edits = 0").collect()}
    norm = lambda t: " ".join(t.lower().split())
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    assert got == {(d, i) for d, t in texts.items() for i, x in items if x in norm(t)}
    blocks = decontaminate.contaminated_spans(docs, bench, block_chars=500)
    assert {(r.doc_id, r.item_id) for r in blocks.where("edits = 0").collect()} == got


def test_common_grams_lose_no_leak(monkeypatch):
    """Passages that share most of their text, found in pieces that are looked at a few hits at a time."""
    rng = random.Random(6)
    shared = "which of the following statements about the subject is true in every case "
    items = [shared + "".join(rng.choices("abcdefgh ", k=90)) for _ in range(60)]
    text = " ".join([shared] * 30 + [items[5][:80] + "X" + items[5][81:], "noise " * 50, items[40].upper()] + [shared] * 30)
    want = decontaminate.Passages(items, 8, 0.1).find([text, items[7]])
    assert {(t, p) for t, p, *_ in want} == {(0, 5), (0, 40), (1, 7)}
    for common, hits in ((10**6, 1 << 21), (5, 1 << 21), (5, 100), (10**6, 1)):
        monkeypatch.setattr(decontaminate, "COMMON", common)
        monkeypatch.setattr(textmatch, "HITS", hits)
        assert decontaminate.Passages(items, 8, 0.1).find([text, items[7]]) == want


def test_equal_ids_of_passages_are_dealt_apart(spark, texts):
    texts_ = [f"passage number {i} holds some words of its own, as {i * 7919 % 1000} says" for i in range(30)]
    bench = spark.createDataFrame([(1, t) for t in texts_ * 2], "item_id long, text string")
    docs_ = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts_)], "doc_id long, text string")
    for chars in (200, 10**6):
        found = decontaminate.contaminated_spans(docs_, bench, block_chars=chars).where("edits = 0").collect()
        assert sorted(r.doc_id for r in found) == list(range(30))


def test_contaminated_rows_go(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contaminated_spans(docs, bench).collect()}
    for chars in (500, 10**6):
        got = decontaminate.drop_contaminated(docs, bench, block_chars=chars)
        assert got.columns == docs.columns and hit and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - hit


def test_leak_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "hello world again"), (2, None), (3, ""), (4, "b"), (None, "hello")], "item_id long, text string")
    got = decontaminate.contaminated_spans(edge, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.stop) for r in got) == [(4, 1, 0, 17), (4, 1, 0, 17), (6, 1, 5, 22), (6, 4, 2, 3)]
    assert decontaminate.contaminated_spans(empty, bench).count() == 0 == decontaminate.contaminated_spans(edge, bench.limit(0)).count()


# --- 3 ---


def plain_line_dedup(rows):
    """rows [(id, text)] without the lines that brute force takes out; rows equal in both count once."""
    at = defaultdict(list)
    keyed = {}
    for d, t in {r for r in rows if None not in r}:
        h = xxhash64(t)
        keyed[(d, t)] = h
        for i, line in enumerate(t.split("\n")):
            if n := linededup.normal(line):
                at[n].append((d, h, i))
    lines = list(at)
    sets, postings, parent = [linededup.shingles(x, 8) for x in lines], defaultdict(list), list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in postings[g]).items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            postings[g].append(i)
    best = {}
    for i, x in enumerate(lines):
        best[find(i)] = min(best.get(find(i), (1 << 60, 0, 0)), min(at[x]))
    keep, out = set(best.values()), []
    for d, t in rows:
        if None not in (d, t):
            parts = t.split("\n")
            kept = [x for i, x in enumerate(parts) if not linededup.normal(x) or (d, keyed[(d, t)], i) in keep]
            t = t if len(kept) == len(parts) else "\n".join(kept) if any(map(str.strip, kept)) else ""
        out.append((d, t))
    return out


def xxhash64(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None))


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_lines_match_brute_force(docs, texts, broadcast_rows):
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(docs, broadcast_rows=broadcast_rows).collect()]
    assert in_order(got) == in_order(plain_line_dedup(list(texts.items())))


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_unique_lines_stay_where_ids_repeat(spark, broadcast_rows):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    pool = [" ".join(rng.choices(words, k=9)) for _ in range(25)]
    rows = [(1, "dup line here abcdef"), (7, "dup line here abcdef"), (7, "totally unique content of its own"), (7, "totally unique content of its own"), (None, pool[0]), (None, pool[0]), (3, None), (3, ""), (3, " \n ")]
    rows += [(rng.randint(1, 9), "\n".join(rng.sample(pool, 3))) for _ in range(40)]
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=broadcast_rows).collect()]
    assert in_order(got) == in_order(plain_line_dedup(rows))
    assert got.count((7, "totally unique content of its own")) == 2


def test_line_edges(spark, edge, empty):
    out = linededup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_removed"] and out.count() == edge.count()
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[1] == (None, 0) and got[6] == ("a\nb\n", 1) and got[None] == ("no id", 0)
    assert linededup.dedup_lines(empty).count() == 0
    odd = spark.createDataFrame([(1, "same line of text", "x", "y", 7), (2, "same line of text", "z", "w", 8)], "doc long, lines string, doc_id string, version string, n_removed long")
    got = {r.doc: r.asDict() for r in linededup.dedup_lines(odd, id_col="doc", text_col="lines").collect()}
    assert got == {1: dict(doc=1, lines="same line of text", doc_id="x", version="y", n_removed=0), 2: dict(doc=2, lines="", doc_id="z", version="w", n_removed=1)}


def test_very_long_lines(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghij ", k=2_000_000))
    rows = [(1, long), (2, long[:1_000_000] + "X" * 500 + long[1_000_000:]), (3, long.upper() + "\nshort one"), (4, long[::-1])]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: long, 2: "", 3: "short one", 4: long[::-1]}


def test_hot_buckets_are_found(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 20)
    rows = spark.createDataFrame([(5, i) for i in range(50)] + [(6 + linededup.KEY_SLOTS * i, i) for i in range(30)] + [(7, 1), (8, 2)], "key long, nid long")
    assert linededup.hot_keys(rows) == [5]


@pytest.mark.parametrize("chars", [10**6, 900])
def test_large_buckets_are_split(spark, monkeypatch, chars):
    monkeypatch.setattr(linededup, "TILE", 8)
    monkeypatch.setattr(linededup, "TILE_CHARS", chars)
    monkeypatch.setattr(linededup, "HOT", 10)
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old farm house "
    # a chain: its ends are not similar, so no pivot connects it all
    chain = [" ".join(f"word{k}" for k in range(i, i + 30)) for i in range(60)]
    rows = list(enumerate([base + f"number {i:03d}" for i in range(60)] + chain + ["something else entirely"]))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").collect()
    assert sorted(r.doc_id for r in got) == [0, 60, 120]


def family_lines(rng, families, n, length=200):
    """n distinct lines, each a few letters away from the line of its family, and their families."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    bases = ["".join(rng.choices(letters, k=length)) for _ in range(families)]
    lines: dict[str, int] = {}
    while len(lines) < n:
        f = rng.randrange(families)
        line = list(bases[f])
        for _ in range(rng.choice([0, 1, 1])):
            line[rng.randrange(length)] = rng.choice(letters)
        lines[linededup.normal("".join(line) + rng.choice(["", " " + "".join(rng.choices(letters, k=2))]))] = f
    return list(lines), list(lines.values())


def hot_bucket(spark, lines):
    members = spark.createDataFrame([(7, i, len(x)) for i, x in enumerate(lines)], "key long, nid long, size int")
    return members, spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "nid long, twin long, content string")


def test_a_hot_bucket_of_families_is_no_square(spark):
    """100,000 lines of 20 families: all pairs of blocks were 4,800 groups."""
    lines, family = family_lines(random.Random(4), 20, 100_000)
    members, texts = hot_bucket(spark, lines)
    scratch = Scratch(spark)
    groups, near = linededup.bucket_groups(members, texts, 8, 0.8, scratch)
    blocks = -(-len(lines) // linededup.TILE)
    n = groups.select("key", "i", "j").distinct().count()
    rounds = sum(1 for k in range(50) if (scratch_exists(scratch, f"touched-{k}")))
    print("groups of a bucket of", len(lines), "lines:", n, "all pairs of blocks:", blocks * (blocks + 1) // 2, "rounds of pivots:", rounds)
    assert n < 3 * blocks and rounds <= 8
    root = {r.node: r.component for r in connected_components(near, scratch).collect()}
    of = defaultdict(set)
    for i, f in enumerate(family):
        of[root.get(i, i)].add(f)
    assert all(len(f) == 1 for f in of.values())


def scratch_exists(scratch, name):
    from quire.functions import files

    return files.exists(scratch.spark, f"{scratch.base}/{name}")


@pytest.mark.parametrize("seed", range(3))
def test_pivots_lose_no_link(spark, monkeypatch, seed):
    """Families that run into each other, chains and strangers in one bucket: components are those of all pairs."""
    monkeypatch.setattr(linededup, "TILE", 16)
    monkeypatch.setattr(linededup, "PIVOTS", 3)
    monkeypatch.setattr(linededup, "WIDE", 4 if seed else 100)
    rng = random.Random(seed)
    lines, _ = family_lines(rng, 4, 120, 50)
    step = list("".join(rng.choices("abcdefgh", k=60)))
    for k in range(60):  # each line changes one letter of the one before
        step[rng.randrange(60)] = rng.choice("abcdefgh")
        lines.append("".join(step))
    lines = list(dict.fromkeys([*lines, *("".join(rng.choices("xyz ", k=30)).strip() + "end" for _ in range(40))]))
    members, texts = hot_bucket(spark, lines)
    scratch = Scratch(spark)
    found = linededup.verified_links(members, texts, 8, 0.8, scratch)
    got = {r.node: r.component for r in connected_components(found, scratch, "all").collect()}
    sets = [linededup.shingles(x, 8) for x in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert [got.get(i, i) for i in range(len(lines))] == root and len(set(root)) < len(lines) - 30


# --- 4 ---


def test_toxicity_separates_held_out(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words, k=60) + (rng.sample(["scum", "idiot", "moron"], 2) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 400").select("doc_id", "toxic"))
    got = toxicity.toxicity(df.where("doc_id >= 400"), model).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return {f"={w}" for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) >= n}


def test_toxicity_screens_and_scores_as_written(spark):
    """All features that differ enough are kept, however many, ties and all; a score is the sum of their weights."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    marks = labels.where(~held_out(F.col("doc_id"), 4))
    model = toxicity.train(docs, marks)
    texts, toxic = {r.doc_id: r.text or "" for r in docs.collect()}, {}
    for r in marks.collect():
        if r.toxic in (0, 1) and r.doc_id is not None:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    rows = [(plain_features(texts[d]), y) for d, y in toxic.items() if d in texts]
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    counts = [Counter(f for own, y in rows if y == k for f in own) for k in (0, 1)]
    kept = set()
    for f in counts[0].keys() | counts[1].keys():
        a, b = counts[0][f], counts[1][f]
        p, low, high = (a + b) / sum(n), (a + 0.5) / (n[0] + 1), (b + 0.5) / (n[1] + 1)
        z = (b / n[1] - a / n[0]) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
        if a + b >= 5 and abs(z) >= 4 and max(high / low, low / high) >= 2:
            kept.add(f)
    terms = {f for group in toxicity.IDENTITIES for term in group for f in toxicity.features_of(term)}
    assert kept and kept <= model.weights.keys() <= kept | terms
    for r in toxicity.toxicity(docs, model).collect():
        z = model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_toxicity_on_the_given_tables(spark):
    """Held-out labels: nearly all toxic texts are found, nearly no other is called so."""
    at = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    found = [r.predicted for r in got if r.toxic == 1]
    wrong = [r.predicted for r in got if r.toxic == 0]
    print("held out: toxic texts found", sum(found) / len(found), "of", len(found), "others called toxic", sum(wrong) / len(wrong), "of", len(wrong))
    assert len(found) > 30 and sum(found) / len(found) > 0.8 and sum(wrong) / len(wrong) < 0.05


def test_no_feature_is_cut_off(spark):
    """More features than any fixed number of the past differ between the classes, all by the same z."""
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}{k}" .translate(str.maketrans("0123456789", "klmnopqrst")) for a in range(10) for b in range(10) for c in range(10) for k in range(7)]
    rows = [(i, " ".join(words) if i % 2 else "plain", i % 2) for i in range(40)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert len(set(words)) == 7000 and {f"={w}" for w in words} <= model.weights.keys()


def test_counterfactual_penalty_takes_weight_from_identity_terms():
    # feature 0: an insult, 1: a group that the labels tie to insults, 2: the group it is swapped for
    rows = [(1, [0, 1], [[0, 2], [0]])] * 40 + [(1, [0], [])] * 20 + [(0, [1], [[2], []])] * 5 + [(0, [2], [[1], []])] * 40 + [(0, [], [])] * 60 + [(1, [1], [[2], []])] * 10
    _, free = toxicity.fit(rows, 3, 0.4, penalty=0.0)
    _, held = toxicity.fit(rows, 3, 0.4, penalty=10.0)
    assert free[1] - free[2] > 1.0 and abs(held[1] - held[2]) < 0.2 * (free[1] - free[2]) and abs(held[1]) < 0.2 * free[1] and held[0] > 1


def plain_loss(w, b, rows, prior, penalty, ridge):
    """The objective of fit, written out row by row."""
    share, total = sum(r[0] for r in rows) / len(rows), 0.0
    for y, own, _ in rows:
        z = b + sum(w[f] for f in own)
        total += (prior / share if y else (1 - prior) / (1 - share)) / len(rows) * (np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z)))
    pairs = [(own, other) for _, own, others in rows for other in others]
    change = sum((sum(w[f] for f in own) - sum(w[f] for f in other)) ** 2 for own, other in pairs)
    return total + penalty * change / max(1, len(pairs)) + ridge / 2 * float(w @ w)


def test_fit_reaches_the_least_loss():
    rng = random.Random(3)
    rows = []
    for _ in range(80):
        own = sorted(rng.sample(range(6), rng.randint(0, 3)))
        rows.append((int(rng.random() < 0.2 + 0.5 * (0 in own)), own, [sorted({5 - f if f in (2, 3) else f for f in own}), sorted(set(own) - {2, 3})] if {2, 3} & set(own) else []))
    b, w = toxicity.fit(rows, 6, 0.3, penalty=1.0)
    best = plain_loss(w, b, rows, 0.3, 1.0, 1e-3)
    x, step = np.zeros(7), 0.5  # plain descent by differences
    for _ in range(1500):
        g = np.array([(plain_loss(*(lambda v: (v[:6], v[6]))(x + e), rows, 0.3, 1.0, 1e-3) - plain_loss(*(lambda v: (v[:6], v[6]))(x - e), rows, 0.3, 1.0, 1e-3)) / 2e-4 for e in np.eye(7) * 1e-4])
        x -= step * g
    assert abs(best - plain_loss(x[:6], x[6], rows, 0.3, 1.0, 1e-3)) < 1e-3


def neutral_false_positives(spark, penalty):
    """Held out shares of (neutral texts that mention a group called toxic, toxic texts called so)."""
    rng, words, insults = random.Random(12), [f"word{i}" for i in range(200)], [f"insult{chr(97 + i)}" for i in range(25)]
    groups = ["muslims", "women", "immigrants", "gay", "black"]
    rows = []
    for i in range(1500):
        toxic = int(i % 3 == 0)
        text = rng.choices(words, k=40)
        if toxic:
            text += rng.sample(insults, 2) if rng.random() < 0.8 else []
        if rng.random() < (0.85 if toxic else 0.03):  # the labels tie the groups to insults
            text += rng.sample(groups, 2)
        rows.append((i, " ".join(text), toxic))
    rows += [(2000 + i, " ".join(rng.choices(words, k=40) + rng.sample(groups, 2)), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 1000").select("doc_id", "toxic"), penalty=penalty)
    got = toxicity.toxicity(df.where("doc_id >= 1000"), model).join(df, "doc_id").collect()
    share = lambda rows: sum(r.predicted for r in rows) / len(rows)
    return share([r for r in got if r.doc_id >= 2000]), share([r for r in got if r.toxic])


def test_penalty_spares_neutral_mentions(spark):
    free, held = neutral_false_positives(spark, 0.0), neutral_false_positives(spark, 1.0)
    print("neutral mentions called toxic, toxic texts caught: without the penalty", free, "with it", held)
    assert free[0] > 0.5 and held[0] < 0.1 and held[1] > 0.7


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1), (3, 7)], "doc_id long, toxic int")
    for data, marks in ((edge, labels), (edge, labels.limit(0)), (edge, labels.where("toxic = 1")), (empty, labels)):
        got = toxicity.toxicity(edge, toxicity.train(data, marks)).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


# --- 5 ---


def test_licenses(spark, edge, empty):
    rows = [(1, "x y. Licensed under the\n Apache License,  Version 2.0. z"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing of that kind"), (4, "Released under the MIT Licence.")]
    got = {r.doc_id: r for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.license for d, r in got.items()} == {1: "Apache-2.0", 2: "GPL-3.0", 4: "MIT"}
    assert rows[0][1][got[1].start : got[1].stop] == "Licensed under the\n Apache License,  Version 2.0." and got[1].coverage == 1.0
    assert licenses.license_spans(edge).count() == 0 == licenses.license_spans(empty).count()


def test_tags_and_reserved_rights():
    scan = scanner()
    names = lambda text: [(f[1], text[f[3] : f[4]]) for f in scan.find([text])]
    assert names("// SPDX-License-Identifier: MIT\ncode") == [("MIT", "SPDX-License-Identifier: MIT")]
    assert names("x SPDX-license-identifier:  (Apache-2.0 or MIT). More") == [("Apache-2.0 OR MIT", "SPDX-license-identifier:  (Apache-2.0 or MIT)")]
    assert [n for n, _ in names("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */")] == ["GPL-2.0-only WITH Classpath-exception-2.0"]
    assert names("The SPDX-License-Identifier is a tag.") == names("SPDX-License-Identifier:\n\n") == names("SPDX-License-Identifer: MIT") == []
    for text in ("Copyright X. All rights reserved.", "(c) X, all rights reserved\nRedistribution", "All Rights  Reserved", "all rights reserved! And"):
        assert [n for n, _ in names(text)] == ["Proprietary"], text
    for text in ("All rights reserved by the committee, and so they said.", "All rights reserved for members were read out.", "Not all rights are reserved.", "The table was reserved. All were right.", "all rights reserved, it seems, for the few"):
        assert names(text) == [], text


NEUTRAL = [
    "The license of the shop was renewed, and the software section of the library reopened.", "Permission to enter is granted to members free of charge.", "This program of concerts is distributed in the hope that it will please, without any warranty of good weather.",
    "You may obtain a copy of the minutes from the office.", "She was licensed under the old law to drive a tram.", "The source of the river is free, and you can follow it on foot or by boat.", "Neither the name of the village nor the names of its mayors appear in the book.",
    "The terms and conditions of the lease were read, and the copyright of the photographs was left to the family.", "He published under the name of his aunt, version after version.", "Conditions for copying the key were agreed with the caretaker.",
]


def test_neutral_sentences_are_no_notices():
    scan = scanner()
    assert not [f for t in NEUTRAL for f in scan.find([t])]


def scanner():
    return licenses.Licenses(licenses.TEMPLATES, 6, 5, 0.1, 0.6, 150)


def test_whole_templates_are_found():
    scan = scanner()
    for name, text in licenses.TEMPLATES[:-1]:  # the last is the SPDX tag, see test_tags_and_reserved_rights
        found = [f for f in scan.find([f"before it {text} after it"]) if f[7] == 1.0]
        assert name in {f[1] for f in found}, text
    assert len({n for n, _ in licenses.TEMPLATES}) >= 25 and sum(len(t) > 1000 for _, t in licenses.TEMPLATES) >= 5


def best_local(a, b):
    """Score of the best local alignment, match 1 and edit -1, over all pairs of characters."""
    b, low = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32), None
    row, best, step = np.zeros(len(b) + 1, dtype=np.int64), 0, np.arange(len(b) + 1)
    for c in a:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == ord(c), 1, -1))
        row = np.maximum(np.maximum.accumulate(new + step) - step, 0)
        best = max(best, int(row.max()))
    return best


def altered(text, rate, rng):
    out = list(text)
    for _ in range(int(rate * len(out))):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, rng.choice("abcxyz")), lambda: out.insert(at, rng.choice("abc ")), lambda: out.pop(at)])()
    return "".join(out)


def test_license_recall_on_altered_copies(texts):
    rng, scan, pool, found, same, total = random.Random(7), scanner(), list(texts.values()), 0, 0, 0
    for name, text in license_texts.TEXTS * 2:
        extra = " Copyright holder, see the file for all the names of those who wrote it. " if len(text) > 1200 and rng.random() < 0.5 else " "
        copy = altered(text[: len(text) // 2] + extra + text[len(text) // 2 :], rng.choice([0.0, 0.03, 0.06]), rng)
        places = [f for f in scan.find([f"{rng.choice(pool)[:300]} {copy} {rng.choice(pool)[:300]}"]) if f[7] >= 0.8]
        total += 1
        found += bool(places)
        same += any(f[1] == name for f in places)
    assert found >= 0.95 * total and same >= 0.9 * total


def test_license_scores_equal_unbanded_alignment(texts):
    rng, scan, norm = random.Random(9), scanner(), lambda t: " ".join(t.lower().split())
    for name, text in license_texts.TEXTS[-9:]:
        copy = altered(text, 0.04, rng)
        doc = f"{list(texts.values())[3][:100]} {copy} {list(texts.values())[5][:100]}"
        best = max((f for f in scan.find([doc])), key=lambda f: f[8])
        assert best[8] == best_local(norm(licenses.TEMPLATES[best[2]][1]), norm(doc))


def test_relatives_are_told_apart():
    scan = scanner()
    for name, text in license_texts.TEXTS:
        found = scan.find([text])
        assert [f[1] for f in found] == [name] and found[0][7] == 1.0
    assert not scan.find(["Permission is hereby given to read this report. The software section follows. All parts are reserved for members."])


# --- 6 ---


@pytest.fixture(scope="module")
def vocabulary():
    data = open(RANKS, "rb").read()
    return bpe.Vocabulary.load(data, P.PATTERN)


@pytest.fixture(scope="module")
def encoding(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_equals_the_library_on_any_text(vocabulary, encoding, some):
    for text, ids in zip(some, vocabulary.encode(some)):
        assert ids.tolist() == encoding.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def test_bpe_long_pieces(vocabulary, encoding):
    for text in ("a" * 5001, "ab" * 3000, "=" * 9999, " " * 3000, "tion" * 2000, "aaab" * 2000, "\n" * 777 + "x"):
        ids = next(vocabulary.encode([text]))
        assert ids.tolist() == encoding.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def test_bpe_round_trip(docs, texts, encoding, edge, empty):
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs, RANKS, P.PATTERN).collect()}
    for d, t in texts.items():
        ids = encoding.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    again = bpe.bpe_decode(bpe.bpe_encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((r.content or b"").decode() for r in again.collect()) == sorted(t or "" for _, t, *_ in EDGE_ROWS)
    assert bpe.bpe_round_trip(edge, RANKS, P.PATTERN).where("n_tokens = 0").count() == 2
    assert bpe.bpe_round_trip(empty, RANKS, P.PATTERN).count() == 0


# --- 7 ---

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_trigram_queries():
    query = {r.kind: secrets.trigram_query(r) for r in secrets.BASE_RULES}
    assert query["access"] == {frozenset({"aki", "kia"})} and query["hex"] is None
    assert frozenset({"tok", "oke", "ken"}) in query["assign"] and len(query["assign"]) == 18


def test_secrets_match_brute_force(spark, docs, texts, edge, empty):
    odd = ["PASSWORD = 'abcdef' token:x secret=12345", "api_key: ABCDEF1234 apikey=ſecret1", "ſecret=abcdefg Token=abcdefg", "AKIA" * 6 + "é" + "0" * 24, "passwd=short password password=long_enough"]
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs.select("doc_id", "text").union(rows)).collect()}
    kinds = [r.kind for r in secrets.BASE_RULES]
    for d, t in {**texts, **{10**6 + i: t for i, t in enumerate(odd)}}.items():
        base = [(s, k, e) for k, s, e in zip(got[d].kinds, got[d].starts, got[d].ends) if k in kinds]
        assert base == [(s, kinds[k], e) for s, k, e in secret_spans(t)], t
    assert secrets.find_secrets(edge).where("size(kinds) > 0").count() == 0 == secrets.find_secrets(empty).count()


@pytest.mark.parametrize("kind, pieces", [("url_login", ["http", "://", "a", "B", "9", "+", ".", ":", "@", "/", " ", "x"]), ("jwt", ["eyJ", ".", "abcdefgh", "A", "_-", ".eyJ", " ", "12345678"])])
def test_anchored_rules_equal_their_expressions(kind, pieces):
    rule, rng, hits = next(r for r in secrets.MORE_RULES if r.kind == kind), random.Random(2), 0
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 22)))
        want = [m.span() for m in rule.regex.finditer(text)]
        hits += len(want)
        assert list(rule.spans(text)) == want, text
    assert hits


def test_secret_rules_are_linear_in_long_tokens(spark):
    tokens = ["a" * 1_000_000, "eyJ" * 350_000, "eyJabcdefgh." * 90_000, "http://" * 150_000, "password" + " " * 1_000_000, "xoxb-" * 200_000, "-----BEGIN " + "A " * 500_000, "a.b+" * 250_000 + "://u:p@h", "://a:b@" * 140_000]
    began = time.time()
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")).collect()
    assert len(got) == len(tokens) and time.time() - began < 60


# --- 8 ---


@pytest.mark.parametrize("segment", [512, 4, 1])
def test_forward_and_expectations_are_exact(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng, states, symbols = np.random.default_rng(0), 3, 7
    model = hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), size=states), rng.dirichlet(np.ones(symbols), size=states).T.copy())
    sequences = [rng.integers(0, symbols, size=n) for n in (1, 2, 3, 4, 5, 8, 9, 17, 30, 1)]
    start, move, emit, likelihoods = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), []
    for q in sequences:
        alpha, beta = np.zeros((len(q), states)), np.ones((len(q), states))
        alpha[0] = model.start * model.emit[q[0]]
        for t in range(1, len(q)):
            alpha[t] = (alpha[t - 1] @ model.move) * model.emit[q[t]]
        for t in range(len(q) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[q[t + 1]] * beta[t + 1])
        total = alpha[-1].sum()
        likelihoods.append(np.log10(total))
        gamma = alpha * beta / total
        start += gamma[0]
        for t, x in enumerate(q):
            emit[x] += gamma[t]
            if t:
                move += np.outer(alpha[t - 1], model.emit[x] * beta[t]) * model.move / total
    counts = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    model.expect(sequences, counts)
    assert np.allclose(model.log10_likelihood(sequences), likelihoods)
    assert np.allclose(counts[0], start) and np.allclose(counts[1], move) and np.allclose(counts[2], emit)


def test_scores_match_brute_force(docs, texts):
    train = docs.where(~held_out(F.col("doc_id"), 7))
    model = hmm.train(train, symbols=200, cached=600, classes=50)
    tok = lambda t: [w.lower() if w.isascii() else w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0d]+", t)] + [None]
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in tok(t))
    total, distinct, base, score, n = sum(counts.values()), len(counts), 0, 0, 0
    for r in hmm.score(docs, model).collect():
        words = tok(texts[r.doc_id])
        want = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(r.base_score - want) < 1e-6 * abs(want)
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            base, score, n = base + r.base_score, score + r.score, n + r.n_tokens
    assert score > base  # on held-out texts the model codes better than the unigram base


def test_hmm_is_a_distribution(spark):
    """The probabilities of all texts of at most two words of the lexicon sum to at most one, near the share of short texts."""
    rows = [(i, t) for i, t in enumerate(["a", "b", "a b", "b a", "a a", "b", "a"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = hmm.train(df, states=2, symbols=2, cached=2, classes=1, rounds=4)
    every = [""] + ["a", "b"] + [f"{x} {y}" for x in "ab" for y in "ab"]
    got = hmm.score(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), model).agg(F.sum(F.expr("power(10, score)"))).first()[0]
    assert 0.5 < got <= 1.0


def test_hmm_trains_three_rounds_of_six_states(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "a dog ran far", "the dog sat", "", "a cat ran"] * 4)]
    model = hmm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    lexicon = hmm.Lexicon(*model.fields)
    sequences = [lexicon.encode(hmm.tokens(t.encode()))[1] for _, t in rows]
    plain = hmm.Hmm.initial(lexicon.share(), 6)
    for _ in range(3):
        start, move, emit = sums = np.zeros(6), np.zeros((6, 6)), np.zeros((lexicon.end + 1, 6))
        plain.expect(sequences, sums)
        start, move, emit = start + 0.5, move + 0.5, emit + 0.5 * 6 * lexicon.share()[:, None]
        plain = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert model.hmm.emit.shape == plain.emit.shape
    assert len(model.likelihoods) == 3 and model.likelihoods == sorted(model.likelihoods)
    assert len(hmm.train(spark.createDataFrame(rows, "doc_id long, text string"), least_gain=3.0).likelihoods) == 2
    for got, want in ((model.hmm.start, plain.start), (model.hmm.move, plain.move), (model.hmm.emit, plain.emit)):
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_texts_of_a_small_table_score_about_the_base(docs, texts):
    """Fewer words than symbols: unknown words fall into classes that training never saw."""
    for keep in (7, 70):
        train = docs.where(~held_out(F.col("doc_id"), 7)).where(F.col("doc_id") % keep < 7)
        rows = [r for r in hmm.score(docs, hmm.train(train)).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        assert sum(r.n_known < r.n_tokens for r in rows) > 5
        assert all(np.isfinite(r.score) and r.score > r.base_score - 0.15 * r.n_tokens for r in rows)
        assert sum(r.score - r.base_score for r in rows) > -0.02 * sum(r.n_tokens for r in rows)


def test_rare_words_in_a_row_keep_single_precision_finite():
    share = np.full(1000, 1e-7)
    share[0] = 1 - 999e-7
    model, counts = hmm.Hmm.initial(share, 6).single(), (np.zeros(6), np.zeros((6, 6)), np.zeros((1000, 6)))
    likelihood = model.expect([np.arange(1, 1000).repeat(2)], counts)
    assert np.isfinite(likelihood) and all(np.isfinite(c).all() for c in counts) and np.isclose(counts[2].sum(), 1998)


def test_moves_that_hardly_occur_keep_single_precision_exact():
    """Every step needs a move of 1e-9, so products of forward and backward values leave single precision."""
    move, emit = np.full((2, 2), 1e-9), np.array([[1.0, 1e-12], [1e-12, 1.0]])
    np.fill_diagonal(move, 1 - 1e-9)
    model = hmm.Hmm(np.full(2, 0.5), move, emit / emit.sum(axis=0))
    sequences = [np.arange(n) % 2 for n in (2, 3, 9, 40, 600, 1300)]
    got, want = ((np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2))) for _ in range(2))
    likelihood = model.single().expect(sequences, got)
    assert np.isclose(likelihood, model.expect(sequences, want), rtol=1e-5) and np.isclose(model.log10_likelihood(sequences).sum(), likelihood, rtol=1e-5)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(got, want)) and np.isclose(got[2].sum(), sum(map(len, sequences)))


def test_words_of_a_column_are_those_of_each_text():
    column = pa.array(["", None, " a B\t\x0bc ", "x", "\n", "\u00c9 \u00e9 \u00e9\x1c\x85\u00a0b", "a\x00b a", "a  a\r\na\f"])
    for texts in (column, column[2:], column[:2], column[3:4], column[:0], pa.array([None], pa.string())):
        words, codes, lengths = hmm.coded(texts)
        plain = [hmm.tokens((t or "").encode()) for t in texts.to_pylist()]
        assert lengths.tolist() == [len(p) for p in plain]
        assert [hmm.listed_bytes(words)[c] for c in codes] == [w for p in plain for w in p] and len(words) == len({w for p in plain for w in p})


def test_word_counts_of_tasks_that_hold_few(spark, docs, monkeypatch):
    want = {r.word: r.c for r in hmm.word_counts(docs).collect()}
    monkeypatch.setattr(hmm, "HELD", 50)
    assert {r.word: r.c for r in hmm.word_counts(docs.repartition(7)).collect()} == want


def test_op8_reads_a_text_once_to_count_and_once_to_encode(spark, docs, monkeypatch):
    """Before, texts were split into words three times, and a training text encoded twice."""
    seen, table = spark.sparkContext.accumulator(0), docs.select("doc_id", "text")

    def look(text):
        seen.add(1)
        return text

    monkeypatch.setattr(queries, "documents", lambda *_: table.withColumn("text", F.udf(look, "string")("text")))
    got = sorted(map(tuple, queries.op8_hmm(spark, "").collect()))
    learned = table.where(~held_out(F.col("doc_id"), 7))
    assert 0 < seen.value <= table.count() + learned.count()
    apart = hmm.score(table, hmm.train(learned)).withColumn("held_out", held_out(F.col("doc_id"), 7))
    want = sorted(map(tuple, apart.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6)


def test_rare_words_share_out_their_classes(spark, docs, texts):
    train = docs.where(~held_out(F.col("doc_id"), 7))
    scratch = Scratch(spark)
    counts = scratch.save(hmm.word_counts(train), "counts")
    lexicon = hmm.Lexicon(*hmm.learn_lexicon(counts, train.count(), 100, 300, 20))
    plain = {r.word.encode(): r.c for r in counts.collect()}
    rare = {w: c for w, c in plain.items() if w not in lexicon.words[:100]}
    for k in range(20):
        own = [c for w, c in rare.items() if zlib.crc32(w) % 20 == k]
        assert (lexicon.class_total[k], lexicon.class_distinct[k]) == (sum(own), len(own))
    some = [*lexicon.words[95:105], b"never seen before", *list(rare)[:5]]
    want = [lexicon.words.index(w) if w in lexicon.words[:100] else 100 + zlib.crc32(w) % 20 for w in some]
    assert lexicon.encode(some)[1].tolist() == [*want, 120]


def test_hmm_edges(edge, empty):
    for train in (edge, empty):
        got = hmm.score(edge, hmm.train(train)).collect()
        assert len(got) == edge.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert hmm.score(empty, hmm.train(edge)).count() == 0


# --- 9 ---


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids, parent = sorted(prints), {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for r in simhash.near_duplicate_groups(docs).collect():
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == find(r.doc_id)


def test_index_meets_every_near_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for p in list(prints) for _ in range(6)}
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    got = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"))
    joined = {r.node: r.component for r in connected_components(got, Scratch(spark)).collect()}
    near = [(a, b) for a, (p, _) in enumerate(rows) for b, (q, _) in enumerate(rows[:a]) if ((p ^ q) % (1 << 64)).bit_count() <= 3]
    assert near and all(joined.get(a, -1) == joined.get(b, -2) for a, b in near)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_dropped_near_duplicates_match_groups(docs, broadcast_rows):
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    got = simhash.drop_near_duplicates(docs, broadcast_rows=broadcast_rows)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(groups.values()))


def test_simhash_edges(edge, empty):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicate_groups(edge).collect()}
    assert got[1] == got[2] == got[3] == (0, 1) and got[4][1] == 4 and got[None][1] is None
    assert simhash.near_duplicate_groups(empty).count() == 0


# --- 10 ---


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "STRIP", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 48))
    x = np.concatenate([c + rng.normal(scale=s, size=(15, 48)) for c in centres for s in (0.15, 0.33)]).astype(np.float32)
    x = np.concatenate([x, x[:20], 3 * x[20:30]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    y = x.astype(np.float64)
    norm = np.sqrt((y**2).sum(axis=1))
    link = (y @ y.T) / norm[:, None] / norm[None, :] >= 0.95
    np.fill_diagonal(link, False)
    component = np.arange(len(x))
    while True:
        new = np.minimum(component, np.where(link, component[None, :], len(x)).min(axis=1))
        if (new == component).all():
            break
        component = new
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert link.sum() > 100 and len(set(component)) > 5
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), component[i], component[i] == i)


def test_int8_bounds_are_never_wrong():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 64))
    b = a + rng.normal(scale=0.33, size=a.shape)
    exact = (a @ b.T) / np.sqrt((a**2).sum(axis=1)[:, None] * (b**2).sum(axis=1)[None, :])
    possible, sure = np.zeros(exact.shape, dtype=bool), np.zeros(exact.shape, dtype=bool)
    for i, j, certain in vectors.judged_pairs(vectors.Quantised.of(a), vectors.Quantised.of(b), 0.95, same=False):
        possible[i, j] = True
        sure[i[certain], j[certain]] = True
    assert (exact[sure] >= 0.95).all() and not (exact >= 0.95)[~possible].any() and (possible & ~sure).sum() > 20 < sure.sum()


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (10, [1e30, 2e30]), (11, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 11))
    assert all(got[i] == (3, 7, i == 7) for i in (7, 8, 9, 10)) and got[None] == (0, None, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# --- all ---


def every_operator(spark, docs, bench, id_col="doc_id", text_col="text"):
    """Each operator on docs, by the name of its column of ids."""
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit("en").alias("lang"))
    labels = train.groupBy("doc_id").count().select("doc_id", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int").alias("toxic"))
    names = {"id_col": id_col, "text_col": text_col}
    return {
        1: langid.identify(docs, langid.train(train), **names), 2: decontaminate.contaminated_spans(docs, bench, **names), 3: linededup.dedup_lines(docs, **names), 4: toxicity.toxicity(docs, toxicity.train(train, labels), **names),
        5: licenses.license_spans(docs, **names), 6: bpe.bpe_round_trip(docs, RANKS, P.PATTERN, **names), 7: secrets.find_secrets(docs, **names), 8: hmm.score(docs, hmm.train(train), **names), 9: simhash.near_duplicate_groups(docs, **names), 99: simhash.drop_near_duplicates(docs, **names),
    }


EXTRA = ("doc", "line", "version", "id", "fp", "node", "component", "row", "rep", "sig", "n", "score", "lang_pred", "others", "lines", "gone", "spans", "kinds")


def test_columns_of_clashing_names_are_no_matter(spark, sf):
    rows = [(*r[:2], *["x"] * len(EXTRA)) for r in EDGE_ROWS]
    docs = spark.createDataFrame(rows, "key long, body string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    bench = spark.createDataFrame([(1, "hello world again", "x")], "item_id long, text string, doc_id string")
    for n, out in every_operator(spark, docs, bench, "key", "body").items():
        assert "key" in out.columns and out.count() == {2: 3, 5: 0, 99: 6}.get(n, len(rows)), n
        if n in (3, 99):
            assert out.columns[: len(docs.columns)] == docs.columns and out.where("sig = 'x'").count() == out.count()


def test_very_long_texts_in_every_operator(spark):
    rng = random.Random(5)
    words = " ".join(rng.choices(["the", "of", "and", "that", "a longer word", "Öl"], k=60_000))
    texts = [words, "".join(rng.choices("abcdefgh0123", k=100_000)), "ab" * 100_000, "\n" * 200_000 + words[:100_000].replace("and", "and\n"), words[:1000] + " hello world again " + words[1000:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "hello world again"), (2, words[5000:8000])], "item_id long, text string")
    for n, out in every_operator(spark, docs, bench).items():
        got = out.collect()
        assert {r.doc_id for r in got} == {2: {0, 3, 4}, 5: set()}.get(n, set(range(5)) if n < 99 else {r.doc_id for r in got}), n
        if n == 2:
            assert {(r.doc_id, r.item_id) for r in got} == {(0, 2), (3, 2), (4, 1), (4, 2)}
        if n == 6:
            assert {r.decoded_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in texts}
