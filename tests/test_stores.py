"""The record store by partitions and versions, upserts as a stream, and jobs that rebuild only what changed."""

import shutil

import pytest
from pyspark.sql import functions as F

from quire import relations as R
from quire.operators import records
from quire.plans.records import _placed
from quire.sources.incremental import plan_rebuild, rebuild
from quire.sources.tables import Conflict, Store
from quire.streaming import jobs


@pytest.fixture(scope="module")
def rows(spark, sf):
    return _placed(R.store(spark, sf)).persist()


@pytest.fixture(scope="module")
def incoming(spark, sf):
    return _placed(R.incoming(spark, sf)).persist()


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_store_keeps_the_old_table_until_the_new_one_stands(spark, rows, incoming, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.write(rows, records.record_reason()) == 1
    assert plain(store.read()) == plain(rows) and store.read().columns == rows.columns
    with pytest.raises(Exception, match="lost"):
        store.write(incoming.withColumn("zoom", F.raise_error(F.lit("lost")).cast("double")), records.record_reason())
    assert store.version() == 1 and plain(store.read()) == plain(rows)
    assert store.write(incoming, records.record_reason()) == 2
    bad = rows.where(records.record_reason().isNotNull()).join(incoming, ["namespace", "kind", "id"], "left_semi")
    assert store.retained().count() == bad.count() > 0
    kept = rows.join(incoming, ["namespace", "kind", "id"], "left_anti").select(*rows.columns).unionByName(incoming)
    assert plain(store.read()) == plain(kept)


def test_reads_prune_partitions(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write(rows, records.record_reason())
    one = rows.where("namespace = 'office' and kind = 'draft'").first()
    found = store.read(one.id, namespace="office", kind="draft")
    assert plain(found) == plain(rows.where(f"id = {one.id}")) and store.read(-1).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(c in filters for c in ("namespace", "kind", "slot"))
    scanned = found.select(F.input_file_name().alias("f")).distinct().count()
    assert scanned == 1 < len(found.inputFiles())


def test_a_write_replaces_only_the_partitions_it_touches(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write(rows, records.record_reason())
    before = set(store._state()["parts"])
    some = rows.where("namespace = 'office' and kind = 'draft'").limit(1).withColumn("zoom", F.lit(9.0))
    store.write(some, records.record_reason())
    after = set(store._state()["parts"])
    assert len(before - after) == len(after - before) == 1 and store.read().where("zoom = 9").count() == 1
    assert store.read().count() == rows.count()
    gone = store.vacuum()
    assert "versions/000000000001.json" in gone and store.read().count() == rows.count() and store.vacuum() == []


def test_the_second_of_two_writers_fails(spark, rows, incoming, tmp_path):
    one, two = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    one.write(rows, records.record_reason())

    def late(stored, new):  # while this writer works, another one finishes
        two.write(incoming, records.record_reason())
        return stored, None

    with pytest.raises(Conflict):
        one.change(rows, late)
    assert one.version() == 2 and one.read().where("id >= 1000000000").count() > 0
    held = {f.split("/")[0] for f in one._state()["parts"]}
    assert {p.name for p in (tmp_path / "store/data").iterdir() if p.name.startswith("write=")} >= held
    assert one.change(rows, lambda stored, new: (stored, None)) == 3


def test_odd_partition_names_are_refused(spark, rows, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "store")).write(rows.withColumn("kind", F.lit("../x")), records.record_reason())
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "store")).write(rows.withColumn("kind", F.lit(None).cast("string")), records.record_reason())


def versions(spark, sf):
    """A customer's orders as versions of one record, in order of arrival."""
    o = R.store(spark, sf).withColumn("namespace", F.lit("office")).withColumn("kind", F.expr("if(custkey % 3 = 0, 'draft', 'archive')"))
    ord_ = F.row_number().over(R.Window.partitionBy("custkey").orderBy("saved_at", "id")).cast("bigint")
    fixed = {"sequence": F.col("id"), "id": F.col("custkey"), "format": F.lit("docx"), "source_hash": F.expr("sha2(string(custkey), 256)"), "source_name": F.expr("concat('src-', custkey % 97)")}
    return o.withColumn("ord", ord_).withColumns(fixed)


def test_upserts_arrive_as_a_stream(spark, sf, tmp_path):
    log = versions(spark, sf).persist()
    store = Store(spark, str(tmp_path / "store"))
    for k in range(3):
        log.where(f"(ord - 1) div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.where("ord > 12").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.upsert_stream(source, store, "updates", str(tmp_path / "c"))
    query.awaitTermination()
    want = records.fold_upserts(log.where("ord = 1").drop("ord"), log.where("ord > 1"))
    fields = ("id", "sequence", "revision", "modified")
    got = store.read()
    assert plain(got.select(*fields)) == plain(want.select(*fields)) and got.count() > 50
    assert set(plain(got)) <= set(plain(log))  # whole rows, as they came
    at = store.version()
    assert at >= 3
    # batches that run again change nothing
    for batch_id in range(3):
        store.change(log.where("ord = 1"), lambda stored, new: (new, None), ("updates", batch_id))
    assert store.version() == at and plain(store.read().select(*fields)) == plain(want.select(*fields))
    store.change(log.where("ord = 1"), lambda stored, new: (records.fold_records(stored, new, ("namespace", "kind", "id")), None), ("others", 0))
    assert store.version() == at + 1 and plain(store.read().select(*fields)) == plain(want.select(*fields))


def test_folded_records_of_odd_rows(spark):
    schema = "id string, sequence long, revision long, modified boolean, format string, source_hash string, source_name string, note string"
    stored = spark.createDataFrame([("a", 1, 1, False, "f", "h", "s", "old")], schema)
    new = spark.createDataFrame(
        [("a", 2, 1, False, "f", "h", "s", "two", 1), ("a", 3, 0, False, "f", "h", "s", "less", 2), ("a", 4, 1, True, "f", "h", "s", "four", 3), ("a", 4, 1, True, "f", "h", "s", "four", 3), ("a", 5, 1, False, "f", "h", "s", "undone", 4), (None, 1, 1, True, "f", "h", "s", "none", 1), ("b", None, 1, True, "f", "h", "s", "first", 1), ("b", 2, 1, True, "f", "h", "s", "second", 2)],
        schema + ", ord long",
    )
    assert sorted(r.note for r in records.fold_records(stored, new).collect()) == ["first", "four"]
    assert records.fold_records(stored.limit(0), new.limit(0)).count() == 0


FILES = "source string, path string, size long, modified long"


def test_only_stale_groups_are_read(spark, tmp_path):
    folder, read = str(tmp_path / "out"), spark.sparkContext.accumulator(0)
    rows = [("a", "1", 5, 1), ("a", "2", 6, 1), ("b b/=%", "1", 7, 1), ("c", "1", 8, 1), ("none", "1", 0, 1)]

    def build(files):
        seen = F.udf(lambda x: read.add(1) or x, "long")  # counts the rows that a build reads
        return files.where("size > 0").select("source", "path", seen("size").alias("size"))

    def run(rows, version="v1"):
        before = read.value
        plan = {r.source: r.state for r in rebuild(spark.createDataFrame(rows, FILES), folder, version, build).collect()}
        data = sorted((r.source, r.path, r.size) for r in spark.read.schema("path string, size long, source string").parquet(f"{folder}/data").collect())
        return plan, data, read.value - before

    sources = ("a", "b b/=%", "c", "none")
    plan, data, n = run(rows)
    assert plan == dict.fromkeys(sources, "new") and len(data) == 4 and n == 4
    plan, data, n = run(rows)
    assert plan == dict.fromkeys(sources, "kept") and len(data) == 4 and n == 0
    (lost,) = [p for p in (tmp_path / "out/data").iterdir() if p.name.startswith("source=b")]
    shutil.rmtree(lost)
    plan, data, n = run([*rows[:3], ("c", "1", 9, 2), rows[4]])  # one lost, one changed
    assert plan == {"a": "kept", "b b/=%": "lost", "c": "changed", "none": "kept"} and ("c", "1", 9) in data and len(data) == 4 and n == 2
    plan, data, n = run([("a", "1", 0, 3), ("c", "1", 9, 2), rows[4]])  # one without rows now, one gone
    assert plan == {"a": "changed", "b b/=%": "gone", "c": "kept", "none": "kept"} and data == [("c", "1", 9)] and n == 0
    plan, data, n = run([("a", "1", 0, 3), ("c", "1", 9, 2), rows[4]])
    assert plan == {"a": "kept", "c": "kept", "none": "kept"} and n == 0
    assert run([("c", "1", 9, 2)], "v2")[0] == {"a": "gone", "c": "changed", "none": "gone"}


def test_a_build_that_fails_is_made_again(spark, tmp_path):
    files = spark.createDataFrame([("a", "1", 5, 1)], FILES)
    with pytest.raises(Exception, match="stop"):
        rebuild(files, str(tmp_path / "out"), "v1", lambda f: f.select("source", F.raise_error(F.lit("stop")).cast("long").alias("x")))
    assert [r.state for r in plan_rebuild(files, str(tmp_path / "out"), "v1").collect()] == ["new"]
