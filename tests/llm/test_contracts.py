"""Each registered query gives the columns, types and digests that its contract names, over all rows of its table."""

import hashlib
import math
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from quire.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_hmm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def split(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus == 2


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def found(spark, sf):
    held = {}

    def get(name):
        if name not in held:
            df = QUERIES[name](spark, sf)
            kinds = dict(df.dtypes)
            assert {c: kinds[c] for c in COLUMNS[name]} == COLUMNS[name] and list(kinds)[: len(COLUMNS[name])] == list(COLUMNS[name])
            held[name] = df.collect()
        return held[name]

    return get


def test_every_contract_is_here():
    assert set(QUERIES) == {*COLUMNS, "op2_decontaminate", "op3_lines", "op5_licenses"} and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name, modulus", [("op1_langid", 4), ("op4_toxicity", 4), ("op8_hmm", 7)])
def test_held_out_rows(found, texts, name, modulus):
    rows = found(name)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == split(r.doc_id, modulus) for r in rows) and {r.held_out for r in rows} == {True, False}


def test_languages(found, texts, spark, sf):
    learned = {r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").collect()}
    for r in found("op1_langid"):
        letters = any(c.isalpha() for c in texts[r.doc_id])
        assert 0 <= r.score <= 1 and (r.lang_pred in learned if letters else r.lang_pred == "und")


def test_toxicity(found):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found("op4_toxicity"))


def test_token_digests(found, texts):
    ranks = load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in found("op6_bpe"):
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


KINDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def test_secret_digests(spark):
    at, some = "/root/testdata/sf0.01", 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    for r in QUERIES["op7_secrets"](spark, at).collect():
        base = [(m.start(), list(KINDS).index(k), k, m.end()) for k, rule in KINDS.items() for m in re.finditer(rule, texts[r.doc_id], re.ASCII) if len(m[m.lastindex or 0]) >= LEAST[k]]
        line = [f"{k}:{start}:{end}" for start, _, k, end in sorted(base)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[2] == k for b in base) for k in KINDS)
        assert r.base_sha256 == sha(",".join(line)) and set(line) <= set(r.spans.split(","))
        some += len(line)
    assert some > 5


def test_likelihoods(found, texts):
    words = {d: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for d, t in texts.items()}
    counts: dict = {}
    for d, some in words.items():
        if not split(d, 7):
            for w in (*some, None):  # None: the end
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in found("op8_hmm"):
        tokens = [*words[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        want = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        assert r.score < 0 and math.isclose(r.base_score, want, rel_tol=1e-9)


def test_fingerprints(found, texts):
    rows = found("op9_simhash")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    least: dict = {}
    for r in rows:
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id
        least[r.component_id] = min(least.get(r.component_id, r.doc_id), r.doc_id)
        if not re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]):
            assert r.fingerprint == "0" * 16
    assert all(c == d for c, d in least.items())


def test_vectors(found, spark, sf):
    rows = found("op10_vectors")
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id and r.n_links >= 0 for r in rows)


@pytest.mark.parametrize("name", ["op11_whitening", "op12_spelling", "op13_chat"])
def test_columns_of_the_others(found, name):
    assert len(found(name)) > 20
