"""Queries over record-store operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import relations as R
from quire.functions.scratch import Scratch
from quire.operators import records as op
from quire.plans.intake import query
from quire.sources.tables import Store, delete_by_key, table

_REASON = """CASE WHEN version <> 1 THEN 'version' WHEN format NOT IN ('docx', 'hwp', 'hwpx', 'pptx') THEN 'format' WHEN engine_id <> format || '-engine' OR engine_version <> '1' THEN 'engine' WHEN zoom <= 0 THEN 'zoom' WHEN format = 'pptx' AND NOT consent THEN 'consent'
WHEN NOT modified AND revision <> 0 THEN 'revision' WHEN modified AND checkpoint_kind IS NULL THEN 'checkpoint'
WHEN checkpoint_kind IS NOT NULL AND coalesce(CASE WHEN format = 'pptx' THEN checkpoint_kind <> 'slides' ELSE checkpoint_kind <> 'native' OR checkpoint_format <> format END, true) THEN 'checkpoint kind'
WHEN checkpoint_kind IS NOT NULL AND format = 'pptx' AND len(list_distinct(asset_ids)) < len(asset_ids) THEN 'assets' WHEN checkpoint_kind IS NOT NULL AND format = 'pptx' AND len(list_distinct(slide_ids)) < len(slide_ids) THEN 'slides' END"""
R.RELATIONS["r_full"] = f"SELECT *, {_REASON} AS reason FROM r_store"


@query("SELECT id, sequence, revision, saved_at FROM r_store WHERE format <> 'pdf' AND custkey % 3 = 0")
def s2_read_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of one namespace of a store in a folder."""
    store = Store(spark, Scratch(spark).base)
    store.write(_placed(R.store(spark, sf_dir)), op.record_reason())
    return store.read(namespace="office", kind="draft").select("id", "sequence", "revision", "saved_at")


@query("SELECT id, sequence, 'incoming' AS origin FROM r_incoming UNION ALL SELECT id, sequence, 'stored' FROM r_store WHERE id NOT IN (SELECT id FROM r_incoming) UNION ALL SELECT id, sequence, 'quarantined' FROM r_full WHERE reason IS NOT NULL AND id IN (SELECT id FROM r_incoming)")
def s3_write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a store in a folder: what it holds after a second write, and what it quarantined."""
    store = Store(spark, Scratch(spark).base)
    store.write(_placed(R.store(spark, sf_dir)).withColumn("origin", F.lit("stored")), op.record_reason())
    store.write(_placed(R.incoming(spark, sf_dir)).withColumn("origin", F.lit("incoming")), op.record_reason())
    return store.read().select("id", "sequence", "origin").unionByName(store.retained().select("id", "sequence", F.lit("quarantined").alias("origin")))


def _placed(rows: DataFrame) -> DataFrame:
    """Records with the namespace and kind that a store is laid out by."""
    return rows.withColumn("namespace", F.expr("if(format = 'pdf', 'pdf', 'office')")).withColumn("kind", F.expr("if(custkey % 3 = 0, 'draft', 'archive')"))


@query("SELECT id, CASE WHEN sequence % 3 = 0 THEN 'draft' ELSE 'archive' END AS kind FROM r_store WHERE sequence % 3 = 0 OR id NOT IN (SELECT id FROM r_incoming)")
def s4_delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = R.store(spark, sf_dir).select("id", F.expr("if(sequence % 3 = 0, 'draft', 'archive')").alias("kind"))
    return delete_by_key(store, R.incoming(spark, sf_dir))


@query("SELECT id, reason FROM r_full")
def p4_validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.validate_records(R.store(spark, sf_dir)).select("id", "reason")


@query("""WITH d AS (SELECT DISTINCT doc_id FROM r_pages), e AS (SELECT doc_id, ord, CASE WHEN doc_id % 41 = 0 AND ord = 1 THEN [] WHEN doc_id % 37 = 0 THEN [1, 1] WHEN ord % 2 = 0 THEN [ord, ord + 10] ELSE [ord] END AS l, doc_id % 43 = 0 AND ord = 2 AS bare FROM r_pages),
v AS (SELECT doc_id, 2 AS r FROM r_pages WHERE doc_id % 23 = 0 AND ord = 2 UNION ALL SELECT doc_id, 3 FROM r_pages WHERE doc_id % 31 = 0 UNION ALL SELECT doc_id, 4 FROM r_pages WHERE kind = 'pdf' AND original GROUP BY doc_id, source_page HAVING count(*) > 1
UNION ALL SELECT doc_id, 5 FROM e WHERE len(l) = 0 UNION ALL SELECT doc_id, 6 FROM e WHERE doc_id % 37 = 0 AND len(l) > 0 UNION ALL SELECT doc_id, 7 FROM e WHERE bare AND len(l) > 1 UNION ALL SELECT doc_id, 8 FROM e WHERE len(l) > 1 AND NOT bare AND doc_id % 13 = 0
UNION ALL SELECT doc_id, 9 FROM r_pages WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 10 FROM r_pages WHERE doc_id % 19 = 0 UNION ALL SELECT doc_id, 11 FROM d WHERE doc_id % 11 = 0)
SELECT doc_id, ['pages', 'page id', 'rotation', 'original', 'edit lines', 'line owner', 'layout', 'indent', 'run size', 'colour', 'active page'][min(r)] AS reason FROM v GROUP BY 1""")
def p4_page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from order lines, with faults of every kind in some documents; each page has one edit with one run."""
    p = R.doc_pages(spark, sf_dir)
    pages = p.withColumn("page_id", F.expr("if(doc_id % 23 = 0 and ord = 2, 1, ord)")).withColumn("rotation", F.expr("if(doc_id % 31 = 0, 45, rotation)"))
    lines = F.expr("case when doc_id % 41 = 0 and ord = 1 then cast(array() as array<bigint>) when doc_id % 37 = 0 then array(1L, 1L) when ord % 2 = 0 then array(ord, ord + 10) else array(ord) end")
    edits = p.select("doc_id", F.col("ord").alias("page_id"), F.lit(1).alias("edit_id"), lines.alias("line_nos"), F.lit(100.0).alias("width")).withColumn("laid", F.expr("size(line_nos) > 1 and not (doc_id % 43 = 0 and page_id = 2)"))
    layout = {"line_height": "14D", "size": "12D", "first_indent": "if(doc_id % 13 = 0, 100D, 0D)", "rest_indent": "0D"}
    edits = edits.withColumns({k: F.expr(f"if(laid, {v}, null)") for k, v in layout.items()})
    runs = p.select("doc_id", F.col("ord").alias("page_id"), F.lit(1).alias("edit_id"), F.expr("if(doc_id % 17 = 0, 97D, 12D)").alias("size_pt"), F.expr("if(doc_id % 19 = 0, 1.5D, 0D)").alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))
    documents = p.select("doc_id").distinct().withColumn("active_page", F.expr("if(doc_id % 11 = 0, 99L, 1L)"))
    return op.page_violations(documents, pages, edits, runs)


@query("""SELECT id, CASE WHEN reason IS NULL THEN 5 ELSE v END::BIGINT AS version, CASE WHEN v = 2 AND reason IS NULL THEN 'l' || id WHEN v = 2 AND id % 17 <> 0 THEN NULL ELSE 'l' || id || '+' END AS lines, reason FROM (SELECT id, v, CASE WHEN v NOT IN (2, 3, 4, 5) THEN 'version' WHEN v < 5 AND id % 7 = 0 THEN 'obsolete' WHEN v < 5 AND id % 11 = 0 THEN 'highlight' WHEN v = 2 AND id % 17 = 0 THEN 'line ids' WHEN zoom <= 0 THEN 'zoom' END AS reason
FROM (SELECT id, id % 6 AS v, zoom FROM r_store))""")
def p5_migrate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of all versions; the rules of the new form are its zoom and that it has lines."""
    s = R.store(spark, sf_dir).select("id", "zoom", F.expr("id % 6").alias("version"), F.expr("if(id % 7 = 0, array('x'), array())").alias("images"), F.expr("if(id % 2 = 0, cast(array() as array<string>), null)").alias("signature_fields"), F.expr("cast(null as array<string>)").alias("text_boxes"), F.expr("cast(array() as array<string>)").alias("shapes"),
        F.expr("if(id % 11 = 0, 'y', null)").alias("highlight"), F.expr("if(id % 6 = 2, concat('l', id), null)").alias("line_id"), F.expr("if(id % 6 <> 2 or id % 17 = 0, array(concat('l', id, '+')), null)").alias("line_ids"))
    found = op.migrate_records(s, op.first_reason([("zoom", ~(F.col("zoom") > 0)), ("line ids", F.size("line_ids") < 1)]))
    return found.select("id", "version", F.array_join("line_ids", ",").alias("lines"), "reason")


@query("SELECT id, CASE WHEN v IS NULL OR v = 1 THEN 'legacy' ELSE 'invalid' END AS kind, CASE WHEN v IS NULL OR v = 1 THEN 'no original kept' ELSE reason END AS reason FROM (SELECT id, reason, CASE WHEN id % 9 = 0 THEN NULL ELSE version END AS v FROM r_full WHERE reason IS NOT NULL)")
def p6_classify_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = op.validate_records(R.store(spark, sf_dir)).where("reason is not null")
    return op.classify_rejects(bad.withColumn("version", F.expr("if(id % 9 = 0, null, version)")))


@query("SELECT s.id, source_hash AS stored, a AS actual FROM r_store s LEFT JOIN (SELECT o_orderkey AS id, sha256('s' || o_orderkey) AS a FROM orders WHERE o_orderkey % 50 <> 0) b ON s.id = b.id WHERE a IS DISTINCT FROM source_hash")
def j1_verify_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth source is lost."""
    sources = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("id"), F.expr("encode(concat('s', o_orderkey), 'utf-8')").alias("content"))
    return op.verify_hash(R.store(spark, sf_dir), sources)


R.RELATIONS["r_info"] = "SELECT o_orderkey AS doc_id, 3 + o_orderkey % 5 AS page_count FROM orders"


@query("""SELECT doc_id, ord, reason FROM (SELECT p.doc_id, ord, CASE WHEN (p.doc_id + ord) % 6 >= coalesce(page_count, 0) AND (p.doc_id + ord) % 9 < 2 THEN 'font' WHEN kind = 'pdf' AND source_page >= coalesce(page_count, 0) THEN 'range' WHEN kind = 'pdf' AND original AND n > 1 THEN 'original'
WHEN kind = 'pdf' AND NOT original AND (p.doc_id % 4 = 0 OR source_page % 2 = 1) THEN 'copy' END AS reason
FROM (SELECT *, count(*) FILTER (kind = 'pdf' AND original) OVER (PARTITION BY doc_id, source_page) AS n FROM r_pages) p LEFT JOIN r_info i ON p.doc_id = i.doc_id) WHERE reason IS NOT NULL""")
def j2_source_page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages in nine use a font of some page; even pages of documents that are no multiple of four may be copied."""
    info = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("3 + o_orderkey % 5").alias("page_count"))
    pages = R.doc_pages(spark, sf_dir)
    copyable = info.where("doc_id % 4 <> 0").select("doc_id", F.explode(F.expr("sequence(0L, 8L, 2L)")).alias("page_no"))
    used = pages.where("(doc_id + ord) % 9 < 2").select("doc_id", "ord", F.explode(F.expr("array(0L, (doc_id + ord) % 6)")).alias("font_page"))
    return op.source_page_refs(pages, info, copyable, used)


@query("SELECT DISTINCT doc_id, ref, CASE WHEN starts_with(ref, 'blob:') THEN 'blob' ELSE 'missing' END AS reason FROM r_refs WHERE starts_with(ref, 'blob:') OR (starts_with(ref, 'asset:') AND substring(ref, 7) NOT IN (SELECT asset_id FROM r_assets))")
def j3_asset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.asset_integrity(R.asset_refs(spark, sf_dir), R.assets(spark, sf_dir))


@query("""SELECT asset_id, CASE WHEN asset_id IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 10) THEN 'added' ELSE 'missing' END AS status FROM (SELECT DISTINCT l_partkey::VARCHAR AS asset_id FROM lineitem) WHERE asset_id NOT IN (SELECT asset_id FROM r_assets WHERE p_partkey % 2 = 0)""")
def j4_merge_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.expr("string(l_partkey)").alias("asset_id"))
    incoming = table(spark, sf_dir, "part").where("p_size > 10").select(F.expr("string(p_partkey)").alias("asset_id"))
    return op.merge_referenced(refs, R.assets(spark, sf_dir).where("p_partkey % 2 = 0"), incoming)


_LOCAL = "sha256(p_name) || CASE p_partkey % 14 WHEN 0 THEN '' WHEN 7 THEN ':x' ELSE ':' || (p_size % 4) END"


@query(f"""SELECT DISTINCT id, CASE WHEN n > 1 THEN 'repeated' WHEN local THEN 'local id' WHEN NOT known THEN 'unknown' ELSE 'differs' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM
(SELECT CASE WHEN p_size % 3 = 0 THEN {_LOCAL} ELSE p_name || '/' || (p_partkey % 700) END AS id, p_size % 3 = 0 AS local, p_partkey % 14 IN (0, 7) OR p_size % 4 <> p_size % 5 AS wrong, p_partkey % 9 <> 0 AS known, p_partkey % 10 = 0 AS differs FROM part))
WHERE n > 1 OR (local AND wrong) OR (NOT local AND (NOT known OR differs))""")
def j22_verify_asset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the assets are local, some of them under ids of another form or another font of the file."""
    p = table(spark, sf_dir, "part").withColumn("local", F.expr("p_size % 3 = 0"))
    id_ = F.expr("if(local, concat(sha2(p_name, 256), case p_partkey % 14 when 0 then '' when 7 then ':x' else concat(':', p_size % 4) end), concat(p_name, '/', p_partkey % 700))")
    stored = p.select(id_.alias("id"), F.expr("if(local, 'local', null)").alias("origin"), F.expr("if(local, p_size % 5, null)").alias("subfont"), F.expr("if(p_partkey % 10 = 0, 'other', p_brand)").alias("family"), F.expr("bigint(p_size)").alias("weight"))
    catalog = p.where("p_partkey % 9 <> 0 and not local").groupBy(F.expr("concat(p_name, '/', p_partkey % 700)").alias("id")).agg(F.min("p_brand").alias("family"), F.min(F.expr("bigint(p_size)")).alias("weight"))
    return op.verify_asset_catalog(stored, catalog, ["family", "weight"], "id")


@query("""SELECT coalesce(s.id, i.id) AS id, o AS outcome, CASE WHEN o IN ('inserted', 'updated') THEN i.sequence ELSE s.sequence END AS sequence FROM (SELECT s, i, CASE WHEN i.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted'
WHEN s.format <> i.format OR s.source_hash <> i.source_hash OR s.source_name <> i.source_name THEN 'identity' WHEN i.sequence <= s.sequence OR i.revision < s.revision THEN 'stale' WHEN s.modified AND NOT i.modified THEN 'unmodified' ELSE 'updated' END AS o
FROM r_store s FULL JOIN r_incoming i ON s.id = i.id)""")
def m1_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.guarded_upsert(R.store(spark, sf_dir), R.incoming(spark, sf_dir)).select("id", "outcome", "sequence")


@query()
def m1_fold_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as versions of one record: the first is stored, the others come in by date."""
    o = R.store(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("custkey").orderBy("saved_at", "id")).cast("bigint"))
    o = o.select(F.col("custkey").alias("id"), "ord", F.col("id").alias("sequence"), "revision", "modified", F.lit("docx").alias("format"), F.expr("sha2(string(custkey), 256)").alias("source_hash"), F.expr("concat('src-', custkey % 97)").alias("source_name"))
    return op.fold_upserts(o.where("ord = 1").drop("ord"), o.where("ord > 1"))


@query("SELECT id, 'retained' AS route, reason, 20000::BIGINT AS at FROM r_full WHERE reason IS NOT NULL UNION ALL SELECT id, 'store', NULL, 0 FROM r_full WHERE reason IS NULL")
def m2_quarantine_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = op.quarantine_route(R.store(spark, sf_dir), "batch-1", F.lit(20000).cast("bigint"))
    return bad.select("id", F.lit("retained").alias("route"), "reason", F.col("retained_at").alias("at")).unionByName(good.select("id", F.lit("store").alias("route"), F.lit(None).cast("string").alias("reason"), F.lit(0).cast("bigint").alias("at")))


@query("SELECT id, sequence FROM r_full WHERE NOT (reason IS NOT NULL AND id % 4 <> 0)")
def m3_compare_and_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged rows are older versions where the id is a multiple of four."""
    store = R.store(spark, sf_dir)
    judged = op.validate_records(store).where("reason is not null").withColumn("saved_at", F.expr("if(id % 4 = 0, saved_at - 1, saved_at)"))
    return op.compare_and_quarantine(store, judged)[0].select("id", "sequence")


_FORK = "sha256('opened/' || id || '/' || sequence)"


@query(f"SELECT id::VARCHAR AS id, sequence, saved_at FROM r_store UNION ALL SELECT substring({_FORK}, 1, 8) || '-' || substring({_FORK}, 9, 4) || '-' || substring({_FORK}, 13, 4) || '-' || substring({_FORK}, 17, 4) || '-' || substring({_FORK}, 21, 12), 0, 20000 FROM r_store")
def m4_fork_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fork_archive(R.store(spark, sf_dir), "opened", F.lit(20000).cast("bigint")).select("id", "sequence", "saved_at")


@query("SELECT i.id, CASE WHEN s.id IS NOT NULL AND s.revision = i.revision AND s.zoom = i.zoom AND s.file_name = i.file_name THEN 'saved' ELSE 'dirty' END AS state FROM (SELECT id, zoom, file_name, CASE WHEN id % 3 = 0 THEN revision + 1 ELSE revision END AS revision FROM r_incoming) i LEFT JOIN (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN revision - 1 ELSE revision + 1 END AS revision) FROM r_store) s ON i.id = s.id")
def m5_save_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = R.incoming(spark, sf_dir).withColumn("revision", F.expr("if(id % 3 = 0, revision + 1, revision)"))
    return op.save_freshness(live, R.store(spark, sf_dir).withColumn("revision", F.expr("if(id % 5 = 0, revision - 1, revision + 1)")))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE source_hash END AS source, CASE WHEN id % 3 = 2 THEN NULL ELSE file_name END AS file_name FROM r_full WHERE reason IS NOT NULL")
def m6_recover_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = op.validate_records(R.store(spark, sf_dir)).where("reason is not null")
    flat = F.to_json(F.struct(F.col("source_hash").alias("source"), F.col("file_name").alias("fileName")))
    nested = F.to_json(F.struct(F.struct(F.col("source_hash").alias("source"), F.col("file_name").alias("fileName")).alias("workspace")))
    return op.recover_original(bad.select("id", F.when(F.expr("id % 3 = 0"), flat).when(F.expr("id % 3 = 1"), nested).otherwise(F.lit("{}")).alias("raw")))


@query("SELECT CASE WHEN sequence % 3 = 0 THEN 'draft' ELSE 'archive' END AS kind, format, count(*) AS n FROM r_store GROUP BY ALL")
def a7_library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.library_summary(R.store(spark, sf_dir).withColumn("kind", F.expr("if(sequence % 3 = 0, 'draft', 'archive')")))


@query("SELECT id, file_name, saved_at FROM r_full WHERE reason IS NULL ORDER BY saved_at DESC, id")
def o1_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.list_recent(R.store(spark, sf_dir), "listing", F.lit(20000).cast("bigint"))[0]


@query("SELECT id, 'rewritten' AS route, 2::BIGINT AS layout FROM r_full WHERE reason IS NULL AND layout < 2 UNION ALL SELECT id, 'retained', 0 FROM r_full WHERE reason IS NOT NULL")
def o1_list_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listing writes back, and what it quarantines."""
    _, rewrite, retained = op.list_recent(R.store(spark, sf_dir), "listing", F.lit(20000).cast("bigint"))
    return rewrite.select("id", F.lit("rewritten").alias("route"), "layout").unionByName(retained.select("id", F.lit("retained").alias("route"), F.lit(0).cast("bigint").alias("layout")))


@query("SELECT id, reason, saved_at FROM r_full WHERE reason IS NOT NULL ORDER BY saved_at DESC, id")
def o2_list_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.list_retained(R.store(spark, sf_dir))


@query("SELECT doc, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq DESC) AS back FROM r_actions) WHERE back <= 20")
def o3_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.history_window(R.actions(spark, sf_dir)).select("doc", "seq", "type")


@query("SELECT id, saved_at, 'draft' AS kind, sequence FROM r_store UNION ALL SELECT id, saved_at, 'archive', -1 FROM r_incoming")
def u1_recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = R.store(spark, sf_dir).select("id", "saved_at", F.lit("draft").alias("kind"), "sequence")
    return op.recent_documents(drafts, R.incoming(spark, sf_dir).select("id", "saved_at", F.lit("archive").alias("kind"))).fillna(-1, ["sequence"])


@query("SELECT session, event_id AS seq, revision, before FROM (SELECT *, lag(revision) OVER (PARTITION BY session ORDER BY event_id) AS before FROM r_requests) WHERE revision < before")
def w9_monotonic_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.monotonic_revisions(R.requests(spark, sf_dir).withColumn("seq", F.col("event_id")))


@query("SELECT doc, seq, type, k FROM (SELECT *, lag(type) OVER w AS t, lag(k) OVER w AS k0, row_number() OVER w AS n FROM r_actions WINDOW w AS (PARTITION BY doc ORDER BY seq)) WHERE n = 1 OR t <> type OR k0 <> k")
def w10_suppress_noops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.suppress_noops(R.actions(spark, sf_dir), "doc", "seq", ["type", "k"]).select("doc", "seq", "type", "k")
