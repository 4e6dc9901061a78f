"""Stream forms give the rows of their batch forms."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import relations as R
from quire.operators import edits
from quire.streaming import jobs


def staged(spark, df, folder, parts=4, order="ts"):
    """df as a stream: files by time, one for each trigger."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withColumn("slice", F.ntile(parts).over(Window.orderBy(order, "event_id"))).persist()
    for k in range(1, parts + 1):
        df.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_debounce_stream(spark, sf, tmp_path):
    batch = R.actions(spark, sf)
    got = drained(jobs.debounce_saves(staged(spark, batch, tmp_path / "in", 1), "1 hour", "400 days"), "bursts")
    assert got.count() == 0  # nothing is given out before the watermark passes
    want = edits.debounce(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    source = staged(spark, batch.select("doc", "event_id", "ts").unionByName(batch.agg(F.max("doc").alias("doc"), F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("interval 500 days")).alias("ts"))), tmp_path / "in2", 2)
    got = drained(jobs.debounce_saves(source, "1 hour", "1 hour"), "bursts2")
    assert {(r.doc, r.event_id) for r in want.collect()} == {(r.doc, r.event_id) for r in got.collect()}


def test_monotonic_stream(spark, sf, tmp_path):
    batch = R.requests(spark, sf)
    got = drained(jobs.monotonic_dedupe(staged(spark, batch, tmp_path / "in")), "rising")
    assert {(r.session, r.event_id) for r in got.collect()} == {(r.session, r.event_id) for r in edits.monotonic_dedupe(batch).collect()}


def test_latest_stream(spark, sf, tmp_path):
    batch = R.requests(spark, sf)
    got = drained(jobs.latest_render(staged(spark, batch, tmp_path / "in")), "latest", "update")
    newest = got.groupBy("session", "page").agg(F.max("event_id").alias("event_id"))
    assert {tuple(r) for r in newest.collect()} == {tuple(r) for r in edits.latest_render(batch).select("session", "page", "event_id").collect()}


def test_coalesce_stream(spark, sf, tmp_path):
    batch = R.requests(spark, sf)
    got = drained(jobs.inflight_coalesce(staged(spark, batch, tmp_path / "in"), ["session", "page", "revision"], "400 days"), "waiting")
    assert got.count() == edits.inflight_coalesce(batch, ["session", "page", "revision"]).count()


def ended(spark, batch, key, days=4000):
    """batch and an event of another key long after, which lets the watermark pass everything."""
    far = batch.agg(F.max("ts").alias("m")).select(F.expr(f"m + interval {days} days").alias("ts"))
    row = far.select(*[F.col("ts") if c == "ts" else F.lit(-1).cast(t).alias(c) if c in (key, "event_id") else F.lit(None).cast(t).alias(c) for c, t in batch.dtypes])
    return batch.unionByName(row)


def shuffled(spark, batch, folder, parts=4):
    """A stream whose files hold events out of order by up to an hour."""
    rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 59, 0)")
    return staged(spark, rows, folder, parts, late)


def test_stalled_stream(spark, sf, tmp_path):
    """Timers, order within the delay and restarts give the rows of the batch form."""
    batch = R.request_events(spark, sf)
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = jobs.stalled_requests(shuffled(spark, ended(spark, batch, "session"), tmp_path / "in"), 86400.5, "2 hours")
    got = {tuple(r) for r in drained(stream, "stalled").collect()}
    want = {tuple(r) for r in edits.stalled_requests(batch, 86400.5).collect()}
    assert got == want and len(want) > 20


def test_clocks_of_requests(spark, tmp_path):
    """Fractions of a second count, what was never started has no clock, and a clock that ran out needs a new start."""
    log = [
        (1, 0.0, "started"), (1, 20.0, "progress"), (1, 40.1, "done"),  # 20.1 s of silence
        (2, 0.0, "started"), (2, 20.0, "progress"), (2, 40.0, "done"),  # never over 20 s
        (3, 0.0, "queued"), (3, 90.0, "progress"),  # not started
        (4, 0.0, "started"), (4, 50.0, "progress"), (4, 60.0, "started"), (4, 61.0, "queued"),  # out, still out, started again, out at the end
        (5, 5.0, "done"), (5, 6.0, "started"), (5, 7.0, "done"),
        (6, 0.0, "started"), (6, 0.0, "progress"),
    ]
    rows = spark.createDataFrame([(1, r, n, t, p) for n, (r, t, p) in enumerate(log)], "session long, request long, event_id long, t double, phase string")
    rows = rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1000000).cast("long") + 10**15)).drop("t")
    want = {(1, 1), (4, 8), (4, 11), (6, 16)}
    assert {(r.request, r.event_id) for r in edits.stalled_requests(rows, 20).collect()} == want
    stream = jobs.stalled_requests(staged(spark, ended(spark, rows, "session"), tmp_path / "in", 3), 20, "1 second")
    assert {(r.request, r.event_id) for r in drained(stream, "clocks").collect()} == want


def test_gated_stream(spark, sf, tmp_path):
    a = R.actions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("composing", F.expr("case type when 'add' then true when 'undo' then false end"))
    a = a.select("doc", "event_id", "ts", "composing")
    # changes exactly the gap apart are of one burst
    tie = spark.createDataFrame([(-5, 10**9, 0), (-5, 10**9 + 1, 3600), (-5, 10**9 + 2, 7201)], "doc long, event_id long, t long").select("doc", "event_id", F.timestamp_seconds(F.col("t") + 1704067200).alias("ts"), F.lit(None).cast("boolean").alias("composing"))
    batch = a.unionByName(tie)
    stream = jobs.gated_saves(shuffled(spark, ended(spark, batch, "doc"), tmp_path / "in"), 3600, "2 hours")
    got = {(r.doc, r.event_id) for r in drained(stream, "gated").collect()}
    want = {(r.doc, r.event_id) for r in edits.gated_saves(batch, "1 hour").collect()}
    assert got == want and {r for r in want if r[0] == -5} == {(-5, 10**9 + 1), (-5, 10**9 + 2)} and len(want) > 50


def test_stale_responses_stream(spark, sf, tmp_path):
    batch = R.requests(spark, sf)
    got = {tuple(r) for r in drained(jobs.stale_responses(staged(spark, batch, tmp_path / "in")), "fresh").collect()}
    want = {tuple(r) for r in edits.stale_responses(batch).select("session", "event_id", "revision").collect()}
    assert got == want and 0 < len(want) < batch.count()


def test_intake_stream(spark, tmp_path):
    """Three ways, in any case of the suffix; a batch that runs again is written once."""
    folder, sinks = tmp_path / "landing", tmp_path / "sinks"
    folder.mkdir()
    compound = bytes.fromhex("D0CF11E0A1B11AE1")
    files = {"a.pdf": b"%PDF-1.7", "b.DocX": b"PK\3\4", "c.pdf": b"hello", "d.txt": b"%PDF-", "e.Pdf": b"PK\3\4", "f.doc": compound, "g.ppt": compound + b"x", "h.hwp": compound, "i.docx": b"PK", "j.hwp": compound}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    parts = spark.createDataFrame([(p, "word/document.xml", 9) for p in ("b.DocX", "e.Pdf")], "package string, part_name string, size long")
    manifest = spark.createDataFrame([("b.DocX", "Override", "/word/document.xml", word), ("e.Pdf", "Default", "/word/document.xml", word)], "package string, kind string, part string, content_type string")
    mimetypes = spark.createDataFrame([], "package string, mimetype string")
    streams = spark.createDataFrame([("f.doc", "WordDocument", 5), ("g.ppt", "PowerPoint Document", 5), ("h.hwp", "FileHeader", 5), ("j.hwp", "EncryptionInfo", 1)], "package string, part_name string, size long")
    tables = (parts, manifest, mimetypes, streams)
    jobs.intake_stream(spark, str(folder), str(sinks), str(tmp_path / "checkpoint"), *tables).awaitTermination()

    def landed(kind):
        return sorted((r.file_name, r.format, r.mismatch, r.reason) for r in spark.read.parquet(str(sinks / kind)).collect())

    want = {
        "supported": [("a.pdf", "pdf", False, None), ("b.DocX", "docx", False, None), ("h.hwp", "hwp", False, None)],
        "legacy": [("f.doc", "doc", False, None), ("g.ppt", "ppt", False, None)],
        "rejected": [("c.pdf", None, None, "unknown"), ("e.Pdf", None, None, "invalid"), ("i.docx", None, None, "unread"), ("j.hwp", None, None, "encrypted")],
    }
    assert {k: landed(k) for k in jobs.SINKS} == want
    batch = spark.createDataFrame([(n, n, n, len(d), bytearray(d[:8])) for n, d in files.items() if n != "d.txt"], "package string, file_name string, path string, size long, content binary")
    jobs.route(batch, 0, str(sinks), *tables)
    assert {k: landed(k) for k in jobs.SINKS} == want
    (folder / "k.PDF").write_bytes(b"%PDF-2.0")
    jobs.intake_stream(spark, str(folder), str(sinks), str(tmp_path / "checkpoint"), *tables).awaitTermination()
    assert landed("supported") == sorted([*want["supported"], ("k.PDF", "pdf", False, None)]) and landed("legacy") == want["legacy"]
