"""Queries over intake operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import relations as R
from quire.functions import files as fs
from quire.functions.scratch import Scratch
from quire.operators import intake as op
from quire.sources.incremental import rebuild
from quire.sources.tables import export_backup_json, land_files, scan_documents, table

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = R.with_relations(sql)
        return f

    return add


@query("SELECT upload_id || '-' || regexp_replace(file_name, '[^A-Za-z0-9.]', '_', 'g') AS name, octet_length(content) AS size, sha256(content) AS hash FROM r_uploads WHERE regexp_matches(file_name, '\\.(pdf|docx|hwp|hwpx|pptx|doc|ppt)$', 'i') AND octet_length(content) > 0")
def s1_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads, landed as files in a folder that executors share, and scanned there."""
    folder = f"{Scratch(spark).base}/landing"
    name = F.concat("upload_id", F.lit("-"), F.regexp_replace("file_name", "[^A-Za-z0-9.]", "_"))
    land_files(R.uploads(spark, sf_dir).select(name.alias("name"), "content"), folder)
    found = scan_documents(spark, folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", F.sha2("content", 256).alias("hash"))


@query("SELECT upload_id, '{\"upload_id\":' || upload_id || ',\"file_name\":\"' || file_name || '\",\"source\":{\"__blob__\":true,\"type\":\"text/html\",\"base64\":\"' || base64(content) || '\"}}' AS json FROM r_uploads")
def s5_export_backup_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_backup_json(R.uploads(spark, sf_dir).withColumn("type", F.lit("text/html"))).select("upload_id", "json")


@query("SELECT source, sha256('v1' || chr(10) || string_agg(p, chr(10) ORDER BY p)) AS fingerprint FROM (SELECT 'pkg' || (package % 100) AS source, concat_ws('|', package || '/' || part_no || '/' || part_name, size, stop_off) AS p FROM r_parts) GROUP BY 1")
def s6_fingerprint_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = R.parts(spark, sf_dir).select(F.expr("concat('pkg', package % 100)").alias("source"), F.expr("concat(package, '/', part_no, '/', part_name)").alias("path"), "size", F.col("stop_off").alias("modified"))
    return op.fingerprint_partitions(files, "v1")


@query("SELECT DISTINCT 'pkg' || (package % 100) AS source FROM r_parts WHERE package % 100 % 7 = 3")
def s6_stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which a file has changed since they were stamped; the others are skipped."""
    files = R.parts(spark, sf_dir).select(F.expr("concat('pkg', package % 100)").alias("source"), F.expr("concat(package, '/', part_no, '/', part_name)").alias("path"), "size", F.col("stop_off").alias("modified"), "package")
    stamps = op.fingerprint_partitions(files.withColumn("modified", F.expr("if(package % 100 % 7 = 3, modified - 1, modified)")), "v1")
    return op.stale_sources(op.fingerprint_partitions(files, "v1"), stamps).select("source")


@query("""WITH f AS (SELECT 'pkg' || (package % 100) AS source, package % 100 AS g, count(*) AS n_files FROM r_parts GROUP BY ALL) SELECT source, CASE WHEN g % 7 = 3 THEN 'changed' WHEN g % 11 = 5 THEN 'new' WHEN g % 13 = 4 THEN 'lost' ELSE 'kept' END AS state, n_files FROM f
UNION ALL SELECT 'old', 'gone', 0""")
def s6_rebuild_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the files of each source, built once, and built again where files changed, a source came or an output
    was lost; a source that is gone is dropped."""
    files = R.parts(spark, sf_dir).select(F.expr("concat('pkg', package % 100)").alias("source"), F.expr("concat(package, '/', part_no, '/', part_name)").alias("path"), "size", F.col("stop_off").alias("modified"), F.expr("package % 100").alias("g"))
    count = lambda rows: rows.groupBy("source").agg(F.count("*").alias("n_files"))
    folder = f"{Scratch(spark).base}/rebuilt"
    gone = spark.range(1).select(F.lit("old").alias("source"), F.lit("x").alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("modified"), F.lit(0).cast("bigint").alias("g"))
    before = files.where("g % 11 <> 5 or g % 7 = 3").withColumn("modified", F.expr("if(g % 7 = 3, modified - 1, modified)")).unionByName(gone)
    rebuild(before, folder, "v1", count)
    for name in fs.names(spark, f"{folder}/data"):
        if name.startswith("source=pkg") and int(name.removeprefix("source=pkg")) % 13 == 4:
            fs.delete(spark, f"{folder}/data/{name}")
    plan = rebuild(files, folder, "v1", count)
    return plan.join(spark.read.schema("n_files bigint, source string").parquet(f"{folder}/data"), "source", "left").select("source", "state", F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"))


@query("SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 10 = 9 THEN 'missing' WHEN p_partkey % 10 = 8 THEN 'mismatch' ELSE 'ok' END AS status FROM part")
def s7_verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("name", F.col("p_partkey").cast("string"))
    files = p.where("p_partkey % 10 <> 9").select("name", F.encode("p_name", "utf-8").alias("content"))
    pinned = p.select("name", F.sha2(F.expr("concat(p_name, if(p_partkey % 10 = 8, 'x', ''))"), 256).alias("sha256"))
    return op.verify_manifest(files, pinned)


_SNIFF = "CASE WHEN starts_with(hex(content), '255044462D') THEN 'pdf' WHEN starts_with(hex(content), '504B') THEN 'zip' WHEN starts_with(hex(content), 'D0CF11E0A1B11AE1') THEN 'compound' ELSE 'rejected' END"


@query(f"SELECT upload_id, {_SNIFF} AS container FROM r_uploads")
def p1_sniff_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uploads(spark, sf_dir).select("upload_id", op.sniff_container(F.col("content")).alias("container"))


@query(f"SELECT upload_id, lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) <> 'pdf' AS mismatch FROM r_uploads WHERE {_SNIFF} = 'pdf'")
def p2_extension_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = R.uploads(spark, sf_dir).where(op.sniff_container(F.col("content")) == "pdf")
    return pdf.select("upload_id", op.extension_mismatch(F.col("file_name"), F.lit("pdf")).alias("mismatch"))


@query("SELECT upload_id, CASE WHEN s = '' THEN 'document' ELSE s END || '_edited.pdf' AS name FROM (SELECT upload_id, trim(regexp_replace(file_name, '\\.(pdf|docx|hwp|hwpx|pptx|doc|ppt)$', '', 'i')) AS s FROM r_uploads)")
def p3_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.uploads(spark, sf_dir).select("upload_id", op.output_name(F.col("file_name"), F.lit("pdf")).alias("name"))


@query("SELECT package AS doc_id, bool_or(p_size % 3 = 0 AND NOT (p_size % 5 = 0) AND NOT (p_size % 7 = 0)) AS warn FROM r_parts GROUP BY 1")
def p9_external_reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case when p_size % 5 = 0 then 'http://x/hyperlink' when p_size % 7 = 0 then 'http://x/attachedTemplate' when p_size % 11 = 0 then null else 'http://x/image' end"
    return op.external_reference_flags(R.parts(spark, sf_dir).select(F.col("package").alias("doc_id"), F.expr("if(p_size % 3 = 0, 'External', 'Internal')").alias("mode"), F.expr(kind).alias("type")))


@query("""SELECT package AS doc_id, bool_or(CASE WHEN part_no % 2 = 0 THEN p_size % 4 = 0 OR p_size % 3 <> 0 ELSE p_size % 4 <> 0 AND p_size % 3 = 0 AND p_size % 5 NOT IN (0, 1, 2) END) AS protected FROM r_parts GROUP BY 1""")
def p10_protection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = R.parts(spark, sf_dir).select(
        F.col("package").alias("doc_id"), F.col("part_no").alias("element_id"), F.expr("if(part_no % 2 = 0, 'writeProtection', 'documentProtection')").alias("element"),
        F.expr("case when p_size % 4 = 0 then null when part_no % 2 = 0 then if(p_size % 3 = 0, 'recommended', 'hash') else if(p_size % 3 = 0, 'enforcement', 'edit') end").alias("name"),
        F.expr("element_at(array('0', 'FALSE', 'off', '1', 'true'), int(p_size % 5) + 1)").alias("value"), F.expr("part_no % 2 = 0 and p_size % 3 = 0").alias("recommended"),
    )
    return op.protection_flags(attrs)


R.RELATIONS["r_packages"] = f"""WITH own AS (SELECT package, bool_or(part_name = 'word/document.xml' AND size > 0) AS word, bool_or(part_name = 'ppt/presentation.xml' AND size > 0) AS ppt, bool_or(part_name = 'Contents/content.hpf' AND size > 0) AS hpf,
bool_or(part_name = 'Contents/content.hpf') AS hpf_any, count(*) FILTER (regexp_matches(part_name, '^Contents/section[0-9]+\\.xml$')) AS sections, count(*) FILTER (regexp_matches(part_name, '^Contents/section[0-9]+\\.xml$') AND size = 0) AS empties FROM r_parts GROUP BY 1),
lst AS (SELECT package, bool_or((content_type = '{R.WORD_MAIN}' AND NOT (kind = 'Override' AND part = '/word/document.xml')) OR (content_type = '{R.PRESENTATION_MAIN}' AND NOT (kind = 'Override' AND part = '/ppt/presentation.xml'))) AS misplaced,
count(*) > count(DISTINCT (kind, part)) AS dup, bool_or(content_type = '{R.WORD_MAIN}') AS docx, bool_or(content_type = '{R.PRESENTATION_MAIN}') AS pptx, bool_or(content_type LIKE '%macroEnabled.main+xml') AS other FROM r_manifest GROUP BY 1),
p AS (SELECT *, package % 2 = 0 AS mime FROM own JOIN lst USING (package))
SELECT package, CASE WHEN misplaced OR dup OR (docx AND NOT word) OR (pptx AND NOT ppt) OR (mime AND (NOT hpf_any OR sections = 0 OR empties > 0)) THEN 'invalid'
WHEN (word AND (pptx OR mime)) OR (ppt AND (docx OR mime)) OR (hpf AND (docx OR pptx)) OR docx::INT + pptx::INT + mime::INT > 1 THEN 'ambiguous'
WHEN other THEN 'unsupported' WHEN docx THEN 'docx' WHEN pptx THEN 'pptx' WHEN mime THEN 'hwpx' ELSE 'none' END AS status FROM p"""


@query("SELECT package, status FROM r_packages")
def a1_classify_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.classify_packages(R.parts(spark, sf_dir), R.manifest(spark, sf_dir), _mimetypes(spark, sf_dir))


def _mimetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = R.parts(spark, sf_dir).select("package").distinct()
    return packages.select("package", F.expr("if(package % 2 = 0, 'application/hwp+zip', 'application/epub+zip')").alias("mimetype"))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(f"element_at(array({_STREAMS[1:-1]}), int(p_size % 11) + 1)")
    return R.parts(spark, sf_dir).select("package", "size", name.alias("part_name"))


_STREAMS = "['FileHeader', 'WordDocument', 'PowerPoint Document', 'EncryptionInfo', 'Data', 'Data', 'Root', 'Root', 'Pictures', 'Pictures', 'Table']"


R.RELATIONS["r_compound"] = f"""WITH s AS (SELECT package, size, {_STREAMS}[p_size % 11 + 1] AS n FROM r_parts), g AS (SELECT package, bool_or(n = 'EncryptionInfo') AS locked, max(CASE WHEN n = 'FileHeader' AND size > 0 THEN 1 ELSE 0 END) AS hwp,
max(CASE WHEN n = 'WordDocument' AND size > 0 THEN 1 ELSE 0 END) AS doc, max(CASE WHEN n = 'PowerPoint Document' AND size > 0 THEN 1 ELSE 0 END) AS ppt FROM s GROUP BY 1)
SELECT package, CASE WHEN locked THEN 'encrypted' WHEN hwp + doc + ppt > 1 THEN 'ambiguous' WHEN hwp = 1 THEN 'hwp' WHEN doc = 1 THEN 'doc' WHEN ppt = 1 THEN 'ppt' ELSE 'none' END AS status FROM g"""


@query("SELECT package, status FROM r_compound")
def a2_classify_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.classify_compound(_streams(spark, sf_dir))


@query(f"""WITH c AS (SELECT upload_id, file_name, {_SNIFF} AS container FROM r_uploads), s AS (SELECT c.*, CASE container WHEN 'pdf' THEN 'pdf' WHEN 'rejected' THEN 'unknown' WHEN 'zip' THEN coalesce(p.status, 'unread') ELSE coalesce(k.status, 'unread') END AS status
FROM c LEFT JOIN r_packages p ON p.package = upload_id LEFT JOIN r_compound k ON k.package = upload_id), f AS (SELECT *, CASE WHEN status IN ('pdf', 'docx', 'pptx', 'hwpx', 'hwp') THEN 'supported' WHEN status IN ('doc', 'ppt') THEN 'legacy' ELSE 'rejected' END AS kind FROM s)
SELECT upload_id, container, kind, CASE WHEN kind <> 'rejected' THEN status END AS format, CASE WHEN kind <> 'rejected' THEN lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) <> status END AS mismatch, CASE WHEN kind = 'rejected' THEN status END AS reason FROM f""")
def r8_classify_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with parts and streams of the package of their number; those of high numbers have none."""
    files = R.uploads(spark, sf_dir).select(F.col("upload_id").alias("package"), "file_name", "content")
    found = op.classify_landed(files, R.parts(spark, sf_dir), R.manifest(spark, sf_dir), _mimetypes(spark, sf_dir), _streams(spark, sf_dir))
    return found.select(F.col("package").alias("upload_id"), "container", "kind", "format", "mismatch", "reason")


@query("SELECT asset_id, hash, arg_min(asset_id, p_partkey) OVER (PARTITION BY hash) AS stored_id FROM (SELECT p_partkey::VARCHAR AS asset_id, p_partkey, sha256(p_brand || p_type || p_size) AS hash FROM part)")
def a11_dedupe_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "part").select(F.expr("string(p_partkey)").alias("asset_id"), F.col("p_partkey").alias("ord"), F.sha2(F.concat("p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("hash"))
    return op.dedupe_assets(assets)


@query("SELECT package, lower(part_name) AS name, count(*) AS n FROM r_parts GROUP BY ALL HAVING count(*) > 1")
def a12_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_names(R.parts(spark, sf_dir))


@query("SELECT package, part_no, start_off, before FROM (SELECT *, max(stop_off) OVER (PARTITION BY package ORDER BY start_off, stop_off, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r_parts) WHERE before > start_off")
def w8_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.range_overlap(R.parts(spark, sf_dir))
