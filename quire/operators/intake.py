"""Intake: what a file is, by its bytes and its package parts; names, protection, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Main content types and where their parts must be; how main types of other formats end.
MAIN_PARTS = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml": ("docx", "word/document.xml"),
    "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml": ("pptx", "ppt/presentation.xml"),
}
HWPX_ROOT = "Contents/content.hpf"
OTHER_MAIN = ("main+xml", "macroenabled.main+xml")
KNOWN_SUFFIX = r"(?i)\.(pdf|docx|hwp|hwpx|pptx|doc|ppt)$"


def sniff_container(content: Column) -> Column:
    """Pdf, zip, compound or rejected, by the first bytes alone; no bytes are rejected."""
    head = lambda n: F.substring(content, 1, n)
    return F.when(head(5) == F.expr("X'255044462D'"), "pdf").when(head(2) == F.expr("X'504B'"), "zip").when(head(8) == F.expr("X'D0CF11E0A1B11AE1'"), "compound").otherwise("rejected")


def extension_mismatch(name: Column, fmt: Column) -> Column:
    """Whether the lower-cased text after the last dot differs from fmt; no suffix differs."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)) != fmt


def output_name(name: Column, fmt: Column, suffix: str = "_edited", default: str = "document") -> Column:
    """The stem without one known suffix, trimmed, or the default; then the suffix and the format."""
    stem = F.trim(F.regexp_replace(name, KNOWN_SUFFIX, ""))
    return F.concat(F.when(stem == "", default).otherwise(stem), F.lit(suffix + "."), fmt)


def external_reference_flags(relations: DataFrame) -> DataFrame:
    """(doc_id, warn): whether any external target is neither a hyperlink nor an attached template."""
    kind = F.coalesce("type", F.lit(""))
    risky = (F.col("mode") == "External") & ~kind.endswith("/hyperlink") & ~kind.endswith("/attachedTemplate")
    return relations.groupBy("doc_id").agg(F.coalesce(F.bool_or(risky), F.lit(False)).alias("warn"))


def protection_flags(attributes: DataFrame) -> DataFrame:
    """P10: (doc_id, protected) from attribute rows (doc_id, element_id, element, name, value, recommended).

    writeProtection is enforced unless it has attributes and all are `recommended`; documentProtection if
    it has `enforcement` with a value other than 0, false or off. A row with a null name stands for an
    element without attributes.
    """
    named = F.col("name").isNotNull()
    element = attributes.groupBy("doc_id", "element_id", "element").agg(
        F.count_if(named).alias("n"), F.coalesce(F.bool_and(F.when(named, F.col("recommended"))), F.lit(True)).alias("only_recommended"),
        F.max(F.when(F.col("name") == "enforcement", F.lower("value"))).alias("enforcement"),
    )
    write = (F.col("element") == "writeProtection") & ~((F.col("n") > 0) & F.col("only_recommended"))
    document = (F.col("element") == "documentProtection") & F.coalesce(~F.col("enforcement").isin("0", "false", "off"), F.lit(False))
    return element.groupBy("doc_id").agg(F.bool_or(write | document).alias("protected"))


def classify_packages(parts: DataFrame, manifest: DataFrame, mimetypes: DataFrame) -> DataFrame:
    """A1: (package, status): docx, pptx, hwpx, invalid, ambiguous, unsupported or none.

    parts (package, part_name, size), manifest (package, kind, part, content_type), mimetypes (package,
    mimetype). Invalid comes first, then ambiguous, then unsupported. Each side is reduced to one row for
    each package by its own group-by before they meet.
    """
    full = F.col("size") > 0
    section = F.col("part_name").rlike(r"^Contents/section\d+\.xml$")
    has = lambda name: F.bool_or((F.col("part_name") == name) & full)
    own = parts.groupBy("package").agg(
        has("word/document.xml").alias("word"), has("ppt/presentation.xml").alias("ppt"), has(HWPX_ROOT).alias("hpf"),
        F.bool_or(F.col("part_name") == HWPX_ROOT).alias("hpf_any"), F.count_if(section).alias("sections"), F.count_if(section & ~full).alias("empty_sections"),
    )
    main = {fmt: (F.col("content_type") == kind, part) for kind, (fmt, part) in MAIN_PARTS.items()}
    other_main = reduce(lambda a, b: a | b, (F.lower("content_type").endswith(f".{end}") for end in OTHER_MAIN))
    bad_place = F.lit(False)
    for is_main, part in main.values():
        bad_place = bad_place | (is_main & ~((F.col("kind") == "Override") & (F.col("part") == f"/{part}")))
    listed = manifest.groupBy("package", "kind", "part").agg(F.count("*").alias("times"), F.bool_or(F.col("content_type").isNull() | bad_place).alias("bad"), *[F.bool_or(c).alias(f) for f, (c, _) in main.items()],
        F.bool_or(other_main & ~F.col("content_type").isin(*MAIN_PARTS)).alias("other"))
    listed = listed.groupBy("package").agg(F.bool_or(F.coalesce("bad", F.lit(True)) | (F.col("times") > 1)).alias("bad"), *[F.coalesce(F.bool_or(x), F.lit(False)).alias(x) for x in ("docx", "pptx", "other")])
    mime = mimetypes.groupBy("package").agg(F.bool_or(F.col("mimetype") == "application/hwp+zip").alias("mime"))
    p = own.join(listed, "package", "left").join(mime, "package", "left").na.fill(False, ["bad", "docx", "pptx", "other", "mime"])
    invalid = F.col("bad") | (F.col("docx") & ~F.col("word")) | (F.col("pptx") & ~F.col("ppt"))
    invalid = invalid | (F.col("mime") & (~F.col("hpf_any") | (F.col("sections") == 0) | (F.col("empty_sections") > 0)))
    hwpx = F.col("mime")
    clash = (F.col("word") & (F.col("pptx") | hwpx)) | (F.col("ppt") & (F.col("docx") | hwpx)) | (F.col("hpf") & (F.col("docx") | F.col("pptx")))
    clash = clash | (F.col("docx").cast("int") + F.col("pptx").cast("int") + hwpx.cast("int") > 1)
    status = F.when(invalid, "invalid").when(clash, "ambiguous").when(F.col("other"), "unsupported")
    return p.select("package", status.when(F.col("docx"), "docx").when(F.col("pptx"), "pptx").when(hwpx, "hwpx").otherwise("none").alias("status"))


def classify_compound(streams: DataFrame) -> DataFrame:
    """A2: (package, status) from stream rows (package, part_name, size): encrypted, ambiguous, hwp, doc, ppt or none."""
    has = lambda n: F.max(((F.col("part_name") == n) & (F.col("size") > 0)).cast("int"))
    s = streams.groupBy("package").agg(F.bool_or(F.col("part_name").isin("EncryptionInfo", "EncryptedPackage")).alias("locked"), has("FileHeader").alias("hwp"), has("WordDocument").alias("doc"), has("PowerPoint Document").alias("ppt"))
    one = lambda c: F.col(c) == 1
    return s.select("package", F.when(F.col("locked"), "encrypted").when(F.col("hwp") + F.col("doc") + F.col("ppt") > 1, "ambiguous").when(one("hwp"), "hwp").when(one("doc"), "doc").when(one("ppt"), "ppt").otherwise("none").alias("status"))


def classify_landed(files: DataFrame, parts: DataFrame, manifest: DataFrame, mimetypes: DataFrame, streams: DataFrame) -> DataFrame:
    """Files with (container, kind, format, mismatch, reason): supported, legacy or rejected.

    files have (package, file_name, content) and further columns, which stay but for content; the other tables are
    those of A1 and A2 over the same packages. A PDF is taken at its first bytes; a zip is what A1 says of its parts, a
    compound file what A2 says of its streams. `legacy` (doc, ppt) is to be converted first. The reason of a rejected
    file is what A1 or A2 found instead of a format, `unread` where they have no rows of it, or `unknown` bytes.
    """
    rows = files.withColumn("container", sniff_container(F.col("content"))).drop("content")
    zips = classify_packages(parts, manifest, mimetypes).select("package", F.lit("zip").alias("container"), "status")
    compounds = classify_compound(streams).select("package", F.lit("compound").alias("container"), "status")
    rows = rows.join(zips.unionByName(compounds), ["package", "container"], "left")
    status = F.when(F.col("container") == "pdf", "pdf").when(F.col("container") == "rejected", "unknown").otherwise(F.coalesce("status", F.lit("unread")))
    rows = rows.withColumn("status", status)
    kind = F.when(F.col("status").isin("pdf", "docx", "pptx", "hwpx", "hwp"), "supported").when(F.col("status").isin("doc", "ppt"), "legacy").otherwise("rejected")
    rows = rows.withColumn("kind", kind).withColumn("format", F.when(F.col("kind") != "rejected", F.col("status")))
    mismatch = extension_mismatch(F.col("file_name"), F.col("format"))
    return rows.withColumn("mismatch", mismatch).withColumn("reason", F.when(F.col("kind") == "rejected", F.col("status"))).drop("status")


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """(asset_id, hash, stored_id): each asset and the one that is stored for its content, the first by order."""
    first = assets.groupBy("hash").agg(F.min_by("asset_id", "ord").alias("stored_id"))
    return assets.join(first, "hash").select("asset_id", "hash", "stored_id")


def duplicate_names(parts: DataFrame) -> DataFrame:
    """(package, name, n): part names that repeat ignoring case, and empty or NUL names."""
    name = F.lower("part_name")
    return parts.groupBy("package", name.alias("name")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("name") == "") | F.col("name").contains("\0"))


def range_overlap(parts: DataFrame) -> DataFrame:
    """Parts whose byte range begins before an earlier one of the package has ended."""
    order = Window.partitionBy("package").orderBy("start_off", "stop_off", "part_no")
    before = F.max("stop_off").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("before", before).where("before > start_off").select("package", "part_no", "start_off", "before")


def fingerprint_partitions(files: DataFrame, version: str) -> DataFrame:
    """(source, fingerprint): hash of the job version and the sorted listing of path, size and time. The sorted
    rows of a source pass one running hash, so its listing is never held."""
    rows = files.select("source", F.concat_ws("|", "path", "size", "modified").alias("row"))
    kind = rows.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, sources = None, None, None
        for batch in batches:
            done, sources = [], batch.schema.field("source").type
            for source, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if digest is None or source != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = source, hashlib.sha256(f"{version}\n".encode() + row)
                else:
                    digest.update(b"\n" + row)
            if done:
                yield stamped(done, sources)
        if digest is not None:
            yield stamped([(at, digest.hexdigest())], sources)

    def stamped(done: list[tuple], sources: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], sources), pa.array([d[1] for d in done], pa.string())], ["source", "fingerprint"])

    return rows.repartition("source").sortWithinPartitions("source", "row").mapInArrow(run, f"source {kind}, fingerprint string")


def stale_sources(now: DataFrame, stamps: DataFrame) -> DataFrame:
    """The sources whose fingerprint is new or differs from its stamp."""
    return now.join(stamps, ["source", "fingerprint"], "left_anti")


def verify_manifest(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, status) for each pinned name: ok, mismatch or missing. files (name, content), pinned (name, sha256)."""
    got = files.select("name", F.sha2("content", 256).alias("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("mismatch")
    return pinned.join(got, "name", "left").select("name", status.alias("status"))
