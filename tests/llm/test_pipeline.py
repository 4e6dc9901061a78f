"""Every stage of the pipeline on its own input, against what its operator says of it."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.common import documents


def test_stages_keep_columns_and_clean_documents(spark, sf, tmp_path):
    docs = documents(spark, sf)
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(str(tmp_path / str(k)))
        before, kept = kept.count(), spark.read.parquet(str(tmp_path / str(k)))
        assert 0.5 * before < kept.count() <= before, name
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert not kept.where("n_tokens < 0").count()


def by_stages(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    return docs


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_run_equals_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = by_stages(spark, documents(spark, sf), sf)
    assert got.count() > 100 and plain(got.collect()) == plain(want.collect())


def test_language_stage_fills_and_rejects(spark, sf):
    docs = documents(spark, sf)
    odd = [(10**6, "Dieser Text ist von hier und die anderen sind auch von dort.", None, "s", 0), (10**6 + 1, "12 34 -- !!", "en", "s", 0), (10**6 + 2, None, "en", "s", 0), (None, "", "en", "s", 0), (10**6 + 3, "ЖЩЪЫЭЮЯ жщъыэюя " * 20, None, "s", 0)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), sf).collect()}
    assert 10**6 in got and got[10**6] is not None and not {10**6 + 1, 10**6 + 2, 10**6 + 3, None} & set(got)
    stated = {r.doc_id: r.lang for r in docs.collect()}
    assert set(stated) <= set(got) and sum(stated[d] == got[d] for d in stated) >= 0.98 * len(stated)
    more = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert corpus_pipeline.language(spark, more, sf).columns == more.columns


ODD_IDS = [(7, "dup line here abcdef and the rest of it", "en", "s", 0), (7, "totally unique content of its own for this row", "en", "s", 0), (1, "dup line here abcdef and the rest of it", "en", "s", 0), (None, "no id stands with this one at all", "en", "s", 0), (None, "no id stands with this one at all", "en", "s", 0), (9, None, "en", "s", None), (9, "", "en", "s", 0)]


def test_stages_keep_rows_of_null_and_repeated_ids(spark, sf):
    docs = spark.createDataFrame(ODD_IDS, documents(spark, sf).schema)
    want = {
        "lines": [(1, "dup line here abcdef and the rest of it"), (7, ""), (7, ODD_IDS[1][1]), (9, ""), (9, None), (None, ODD_IDS[3][1]), (None, ODD_IDS[3][1])],
        "near_duplicates": [(1, ODD_IDS[2][1]), (7, ODD_IDS[1][1]), (9, None), (9, ""), (None, ODD_IDS[3][1]), (None, ODD_IDS[3][1])],
        "benchmark_leaks": [r[:2] for r in ODD_IDS],
    }
    for name, rows in want.items():
        got = getattr(corpus_pipeline, name)(spark, docs, sf)
        assert got.columns == docs.columns
        assert plain(r[:2] for r in got.collect()) == plain(rows), name
    assert corpus_pipeline.encoding(spark, docs, sf).count() == len(ODD_IDS)


def test_very_long_texts_pass_every_stage(spark, sf):
    rng = random.Random(4)
    docs = documents(spark, sf)
    long = [(10**6, "".join(rng.choices("thequick brown", k=1_500_000)), "en", "s", 0), (10**6 + 1, " ".join(rng.choices(["the", "of", "and", "that"], k=300_000)), "en", "s", 0), (10**6 + 2, "\n".join(f"line {rng.random()} of the text and that" for _ in range(30_000)), "en", "s", 0)]
    out = by_stages(spark, docs.limit(50).union(spark.createDataFrame(long, docs.schema)), sf)
    assert {r.doc_id for r in out.where("doc_id >= 1000000").collect()} == {10**6, 10**6 + 1, 10**6 + 2}


def test_empty_and_odd_documents_pass(spark, sf):
    docs = documents(spark, sf)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5)], docs.schema)
    for frame in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        assert frame.count() == 0
