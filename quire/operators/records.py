"""Record stores: validation, migration, guarded updates, quarantine, listings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

FORMATS = ("docx", "hwp", "hwpx", "pptx")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The reason of the first rule that is broken (its condition true), or null."""
    return reduce(lambda out, rule: out.when(F.coalesce(rule[1], F.lit(True)), rule[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(True)), rules[0][0]))


#: The engine that each format is pinned to, as id and version; a store passes its own.
ENGINES = {f: (f"{f}-engine", "1") for f in FORMATS}


def record_reason(version: int = 1, engines: dict[str, tuple[str, str]] = ENGINES) -> Column:
    """The first broken rule of a record, in order, or null.

    A record has version, id, format, source_hash, source_name, engine_id, engine_version, sequence, revision,
    saved_at, zoom, consent, modified, checkpoint_kind and checkpoint_format (null without a checkpoint), and
    the arrays asset_ids and slide_ids of its checkpoint. The engine is the pair pinned for the format; the
    checkpoint of a presentation is of kind `slides` with slides, of others `native` and of the record's format.
    """
    c = F.col
    pinned = F.map_from_entries(F.array(*[F.struct(F.lit(f), F.struct(F.lit(i).alias("id"), F.lit(v).alias("version"))) for f, (i, v) in engines.items()]))
    slides, kind = c("format") == "pptx", c("checkpoint_kind")
    unlike = F.when(slides, kind != "slides").otherwise((kind != "native") | (c("checkpoint_format") != c("format")))
    repeats = lambda ids: F.size(F.array_distinct(c(ids))) < F.size(c(ids))
    return first_reason([
        ("version", c("version") != version), ("id", c("id").isNull() | (c("id").cast("string") == "")), ("format", ~c("format").isin(*engines)),
        ("hash", ~c("source_hash").rlike("^[a-f0-9]{64}$")), ("source", c("source_name") == ""),
        ("engine", (c("engine_id") != pinned[c("format")]["id"]) | (c("engine_version") != pinned[c("format")]["version"])),
        ("counter", (c("sequence") < 0) | (c("revision") < 0) | (c("saved_at") < 0)), ("zoom", ~(c("zoom") > 0)),
        ("consent", slides & ~c("consent")), ("revision", ~c("modified") & (c("revision") != 0)), ("checkpoint", c("modified") & kind.isNull()),
        ("checkpoint kind", kind.isNotNull() & F.coalesce(unlike, F.lit(True))), ("assets", kind.isNotNull() & slides & repeats("asset_ids")),
        ("slides", kind.isNotNull() & slides & (repeats("slide_ids") | (F.size("slide_ids") == 0))),
    ])


def validate_records(records: DataFrame) -> DataFrame:
    """Records with the column reason, null where valid."""
    return records.withColumn("reason", record_reason())


def page_violations(documents: DataFrame, pages: DataFrame, edits: DataFrame, runs: DataFrame) -> DataFrame:
    """P4, set rules: (doc_id, reason): the first broken rule of each document; valid ones are left out.

    documents (doc_id, active_page), pages (doc_id, page_id, kind, source_page, original, rotation), edits
    (doc_id, page_id, edit_id, line_nos, width, line_height, size, first_indent, rest_indent; the last four null
    without a layout), runs (doc_id, page_id, edit_id, size_pt, r, g, b). In order: a document has pages;
    their ids are unique; rotations are quarter turns; a source page has at most one original instance; an edit
    has lines, none of them in two edits of its page; several lines have a layout, one has none; the layout's
    measures are positive, its indents in [0, width); run sizes are in 6..96; colours in [0, 1]; the active page
    exists. A null breaks the rule that reads it.
    """
    c, broken = F.col, []

    def rule(n: int, rows: DataFrame, bad: Column) -> None:
        broken.append(rows.where(F.coalesce(bad, F.lit(True))).select("doc_id", F.lit(n).alias("rule")))

    reasons = ["pages", "page id", "rotation", "original", "edit lines", "line owner", "layout", "indent", "run size", "colour", "active page"]
    rule(1, documents.join(pages.select("doc_id"), "doc_id", "left_anti"), F.lit(True))
    rule(2, pages.groupBy("doc_id", "page_id").agg(F.count("*").alias("n")), c("n") > 1)
    rule(3, pages, ~c("rotation").isin(0, 90, 180, 270))
    rule(4, pages.where("kind = 'pdf' and original").groupBy("doc_id", "source_page").agg(F.count("*").alias("n")), c("n") > 1)
    rule(5, edits, F.size("line_nos") < 1)
    rule(6, edits.select("doc_id", "page_id", F.explode("line_nos").alias("line")).groupBy("doc_id", "page_id", "line").agg(F.count("*").alias("n")), c("n") > 1)
    bare = F.coalesce("line_height", "size", "first_indent", "rest_indent").isNull()
    rule(7, edits, ~(c("width") > 0) | ((F.size("line_nos") > 1) == bare))
    within = lambda x: (x >= 0) & (x < c("width"))
    rule(8, edits.where(F.size("line_nos") > 1), ~(c("line_height") > 0) | ~(c("size") > 0) | ~within(c("first_indent")) | ~within(c("rest_indent")))
    rule(9, runs, ~c("size_pt").between(6, 96))
    rule(10, runs, ~c("r").between(0, 1) | ~c("g").between(0, 1) | ~c("b").between(0, 1))
    rule(11, documents.join(pages.select("doc_id", F.col("page_id").alias("active_page")), ["doc_id", "active_page"], "left_anti"), F.lit(True))
    first = reduce(lambda a, b: a.unionByName(b), broken).groupBy("doc_id").agg(F.min("rule").alias("rule"))
    return first.select("doc_id", F.element_at(F.array(*[F.lit(r) for r in reasons]), c("rule")).alias("reason"))


#: Columns of a draft that no longer exist, each a list.
OBSOLETE = ("images", "signature_fields", "text_boxes", "shapes")


def migrate_records(records: DataFrame, valid: Column, current: int = 5) -> DataFrame:
    """P5: records with version, line_ids and the column reason: drafts of versions 2 to 4 brought to the current one.

    records have the OBSOLETE lists, highlight, line_id and line_ids. An old draft is rejected if an obsolete
    list or a highlight holds something, else these columns are emptied; version 2 wraps line_id into line_ids,
    and is rejected if it has line_ids already or no line_id. What was migrated is validated again: `valid` is
    the reason against a record in its new form, as a column of it. A rejected record stays as it came.
    """
    c = F.col
    old, second = c("version") < current, c("version") == 2
    held = reduce(lambda a, b: a | b, [F.coalesce(F.size(c(x)) > 0, F.lit(False)) for x in OBSOLETE])
    reason = first_reason([("version", ~c("version").isin(*range(2, current + 1))), ("obsolete", old & held), ("highlight", old & c("highlight").isNotNull()), ("line ids", second & (c("line_id").isNull() | c("line_ids").isNotNull()))])
    kept = {x: F.col(x) for x in records.columns}
    marked = records.withColumn("reason", reason)
    new = {**kept, **{x: F.lit(None).cast(records.schema[x].dataType) for x in (*OBSOLETE, "highlight")}, "version": F.lit(current).cast(records.schema["version"].dataType), "line_ids": F.when(second, F.array(c("line_id"))).otherwise(c("line_ids"))}
    stored = F.struct(*[v.alias(k) for k, v in kept.items()])
    migrated = marked.where("reason is null").select(stored.alias("stored"), *[v.alias(k) for k, v in new.items()]).withColumn("reason", valid)
    back = migrated.where("reason is not null").select("stored.*", "reason")
    return marked.where("reason is not null").unionByName(back).unionByName(migrated.where("reason is null").drop("stored"))


def classify_rejects(rejected: DataFrame) -> DataFrame:
    """(id, kind, reason): legacy with a fixed reason where the version is missing or 1, else invalid."""
    legacy = F.coalesce(F.col("version") == 1, F.lit(True))
    return rejected.select("id", F.when(legacy, "legacy").otherwise("invalid").alias("kind"), F.when(legacy, "no original kept").otherwise(F.col("reason")).alias("reason"))


def verify_hash(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records whose stored hash isn't that of their bytes (or whose bytes are missing): (id, stored, actual)."""
    actual = sources.select("id", F.sha2("content", 256).alias("actual"))
    return records.join(actual, "id", "left").where(~F.col("source_hash").eqNullSafe(F.col("actual"))).select("id", F.col("source_hash").alias("stored"), "actual")


def source_page_refs(pages: DataFrame, info: DataFrame, copyable: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, ord, reason): the first fault of a page: `font`, a run on it uses a font of a page past the
    document's end; `range`, it refers past that end itself; `original`, another page is an original instance of the
    same source page too; `copy`, it is a copy of one that may not be copied. Blank pages have none but refer to fonts.

    info: (doc_id, page_count), a document without it has no pages; copyable: (doc_id, page_no) of source pages that may
    be copied; fonts: (doc_id, ord, font_page), the pages whose fonts the runs of a page use.
    """
    pdf = F.col("kind") == "pdf"
    n = F.count_if(pdf & F.col("original")).over(Window.partitionBy("doc_id", "source_page"))
    used = fonts.groupBy("doc_id", "ord").agg(F.max("font_page").alias("font_page"))
    may = copyable.select("doc_id", F.col("page_no").alias("source_page"), F.lit(True).alias("may")).distinct()
    rows = pages.withColumn("originals", n).join(info, "doc_id", "left").join(used, ["doc_id", "ord"], "left").join(may, ["doc_id", "source_page"], "left")
    past = lambda c: F.coalesce(F.col(c) >= F.coalesce("page_count", F.lit(0)), F.lit(False))
    reason = F.when(past("font_page"), "font").when(pdf & past("source_page"), "range").when(pdf & F.col("original") & (F.col("originals") > 1), "original").when(pdf & ~F.col("original") & F.col("may").isNull(), "copy")
    return rows.withColumn("reason", reason).where("reason is not null").select("doc_id", "ord", "reason")


def asset_integrity(refs: DataFrame, assets: DataFrame, scheme: str = "asset:") -> DataFrame:
    """(doc_id, ref, reason): blob references, and asset references without an asset; other text is no reference."""
    blob = refs.where(F.col("ref").startswith("blob:")).select("doc_id", "ref", F.lit("blob").alias("reason"))
    wanted = refs.where(F.col("ref").startswith(scheme)).withColumn("asset_id", F.substring("ref", len(scheme) + 1, 1 << 20))
    missing = wanted.join(assets.select("asset_id"), "asset_id", "left_anti").select("doc_id", "ref", F.lit("missing").alias("reason"))
    return blob.unionByName(missing).distinct()


def merge_referenced(refs: DataFrame, present: DataFrame, incoming: DataFrame) -> DataFrame:
    """(asset_id, status): referenced assets that are not present: added if incoming has them, else missing."""
    wanted = refs.select("asset_id").distinct().join(present.select("asset_id"), "asset_id", "left_anti")
    found = incoming.select("asset_id").distinct().withColumn("found", F.lit(True))
    return wanted.join(found, "asset_id", "left").select("asset_id", F.when(F.col("found"), "added").otherwise("missing").alias("status"))


#: The id of an asset that a user brought: hash of the file, and the number of the font in it.
LOCAL_ID = r"^[a-f0-9]{64}:\d+$"


def verify_asset_catalog(stored: DataFrame, catalog: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, reason): stored assets that repeat, are local (`origin`) with an id that is not LOCAL_ID or does not
    end in their `subfont`, or are from the catalogue and unknown there or differ from their row in any column."""
    n = F.count("*").over(Window.partitionBy(key))
    other = catalog.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    local = F.coalesce(F.col("origin") == "local", F.lit(False))
    named = F.coalesce(F.col(key).rlike(LOCAL_ID) & F.col(key).endswith(F.concat(F.lit(":"), F.col("subfont").cast("string"))), F.lit(False))
    rows = stored.withColumn("__n", n).join(other, key, "left")
    reason = F.when(F.col("__n") > 1, "repeated").when(local & ~named, "local id").when(~local & F.col("__known").isNull(), "unknown").when(~local & ~same, "differs")
    return rows.withColumn("reason", reason).where("reason is not null").select(key, "reason").distinct()


def guarded_upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1: one row for each id of either side, with the column outcome: kept, inserted, updated, or the reason
    why the incoming row was refused (identity, stale, unmodified), in which case the stored row stays.

    incoming has one row for each id; see fold_upserts for several.
    """
    s, i = store.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    ident = reduce(lambda a, b: a | b, [~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("format", "source_hash", "source_name")])
    stale = (F.col("i.sequence") <= F.col("s.sequence")) | (F.col("i.revision") < F.col("s.revision"))
    undone = F.col("s.modified") & ~F.col("i.modified")
    outcome = F.when(F.col("i.id").isNull(), "kept").when(F.col("s.id").isNull(), "inserted").when(ident, "identity").when(stale, "stale").when(undone, "unmodified").otherwise("updated")
    both = both.withColumn("outcome", outcome)
    take = F.col("outcome").isin("inserted", "updated")
    return both.select(*[F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in store.columns], "outcome")


_FOLDED = ("sequence", "revision", "modified", "format", "source_hash", "source_name")


def _fold(rows: DataFrame) -> DataFrame:
    """(id, ord, row, sequence, revision, modified, applied): of each id the row that stays when its rows are tried in
    order of ord, each against the one that stays so far, and how many were applied after the first."""
    rows = rows.repartition("id").sortWithinPartitions("id", "ord", *_FOLDED, "row")
    names = ["id", "ord", "row", "sequence", "revision", "modified"]

    def accepts(old: tuple, new: tuple) -> bool:
        if old[3:] != new[3:] or None in (*old[:2], *new[:2]):
            return False
        return new[0] > old[0] and new[1] >= old[1] and (old[2] is False or new[2] is True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, applied, kinds = None, None, 0, None
        for batch in batches:
            done, kinds = [], [batch.schema.field(n).type for n in names]
            for key, ord_, row, *new in zip(*(batch.column(n).to_pylist() for n in ("id", "ord", "row", *_FOLDED))):
                if state is None or key != at:
                    if state is not None:
                        done.append((at, *place, *state[:3], applied))
                    at, place, state, applied = key, (ord_, row), tuple(new), 0
                elif accepts(state, tuple(new)):
                    place, state, applied = (ord_, row), tuple(new), applied + 1
            if done:
                yield folded(done, kinds)
        if state is not None:
            yield folded([(at, *place, *state[:3], applied)], kinds)

    def folded(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*done), [*kinds, pa.int64()])]
        return pa.RecordBatch.from_arrays(columns, [*names, "applied"])

    schema = rows.select(*names, F.lit(0).cast("bigint").alias("applied")).schema
    return rows.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))


def fold_upserts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """M1 for several incoming rows of one id: they are tried in order of arrival (`ord`), a refused row never
    becoming the base of the next try. (id, sequence, revision, modified, applied), one row for each id.

    The log is sorted by Spark and passes by in batches, so an id's rows are never held together; what is held is
    one state. A comparison with a null refuses the row.
    """
    rows = store.select("id", F.lit(-1).cast("bigint").alias("ord"), *_FOLDED).unionByName(incoming.select("id", "ord", *_FOLDED))
    return _fold(rows.withColumn("row", F.lit(0).cast("bigint"))).select("id", "sequence", "revision", "modified", "applied")


def fold_records(store: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("id",), order: str = "ord") -> DataFrame:
    """M1: the store's rows after fold_upserts, whole. Records are told by `key`; incoming has the store's columns, of
    which `order` may be one. Rows with a null id are left out."""
    columns = store.columns
    arrived = F.col(order).cast("bigint")
    if order not in columns:
        store = store.withColumn(order, F.lit(-1).cast("bigint"))
    whole = store.withColumn("arrived", F.lit(-1).cast("bigint")).unionByName(incoming.select(*store.columns).withColumn("arrived", arrived))
    whole = whole.where(F.col("id").isNotNull()).withColumn("row", F.xxhash64(*store.columns))
    tried = whole.select(F.to_json(F.struct(*key)).alias("id"), F.col("arrived").alias("ord"), "row", *_FOLDED)
    stays = _fold(tried).select("id", F.col("ord").alias("arrived"), "row")
    rows = whole.withColumn("told", F.to_json(F.struct(*key))).join(stays.withColumnRenamed("id", "told"), ["told", "arrived", "row"], "left_semi")
    return rows.dropDuplicates(["told"]).select(*columns)


def quarantine_route(records: DataFrame, batch_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """M2: (valid records, retained rows): an invalid row leaves with its raw value, kind, reason, batch and time."""
    marked = records.withColumn("reason", record_reason())
    kind = F.when(F.col("version").isNull() | (F.col("version") == 0), "legacy").otherwise("invalid")
    retained = marked.where("reason is not null").select("id", F.to_json(F.struct(*records.columns)).alias("raw"), kind.alias("kind"), "reason", F.lit(batch_id).alias("batch_id"), now.alias("retained_at"))
    return marked.where("reason is null").drop("reason"), retained


VERSION = ("id", "version", "format", "sequence", "revision", "saved_at", "source_hash")


def compare_and_quarantine(store: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: (kept, removed): stored rows go only if all version columns still equal those that were judged bad."""
    bad = judged.select(*[F.col(c).alias(f"j_{c}") for c in VERSION]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"j_{c}")) for c in VERSION])
    return store.join(bad, same, "left_anti"), store.join(bad, same, "left_semi")


def fork_archive(archives: DataFrame, batch_id: str, saved_at: Column) -> DataFrame:
    """M4: the archives and a fork of each: new id, sequence 0, new time. The new id is a hash of batch, old id and
    sequence in the form of a UUID, so a task that runs again gives the same."""
    h = F.sha2(F.concat_ws("/", F.lit(batch_id), "id", "sequence"), 256)
    new = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fork = archives.withColumn("id", new).withColumn("sequence", F.lit(0).cast("bigint")).withColumn("saved_at", saved_at)
    return archives.withColumn("id", F.col("id").cast("string")).unionByName(fork)


def save_freshness(live: DataFrame, stored: DataFrame, columns: tuple[str, ...] = ("revision", "zoom", "file_name")) -> DataFrame:
    """M5: (id, state): saved if the stored row has the same values, else dirty."""
    other = stored.select("id", *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("there"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in columns]) & F.col("there").isNotNull()
    return live.join(other, "id", "left").select("id", F.when(same, "saved").otherwise("dirty").alias("state"))


def recover_original(retained: DataFrame) -> DataFrame:
    """M6: (id, source, file_name): from whichever layout of the raw JSON holds them; null if none does."""
    get = lambda *paths: F.coalesce(*[F.get_json_object("raw", p) for p in paths])
    return retained.select("id", get("$.source", "$.workspace.source").alias("source"), get("$.fileName", "$.workspace.fileName").alias("file_name"))


def library_summary(records: DataFrame) -> DataFrame:
    """(kind, format, n)."""
    return records.groupBy("kind", "format").agg(F.count("*").alias("n"))


def list_recent(records: DataFrame, batch_id: str, now: Column, current: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O1: (summaries (id, file_name, saved_at) newest first, then by id; rows to rewrite; retained rows).

    Listing quarantines invalid rows (see quarantine_route) and gives valid rows of an older layout (`layout`
    below current) in the current one, to be written back.
    """
    good, retained = quarantine_route(records, batch_id, now)
    rewrite = good.where(F.col("layout") < current).withColumn("layout", F.lit(current).cast(records.schema["layout"].dataType))
    return good.select("id", "file_name", "saved_at").orderBy(F.desc("saved_at"), "id"), rewrite, retained


def list_retained(records: DataFrame) -> DataFrame:
    """O2: (id, reason, saved_at) of quarantined records, newest first, then by id."""
    return validate_records(records).where("reason is not null").select("id", "reason", "saved_at").orderBy(F.desc("saved_at"), "id")


def history_window(snapshots: DataFrame, most: int = 20) -> DataFrame:
    """O3: the last `most` snapshots of each document."""
    return snapshots.withColumn("back", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("seq")))).where(F.col("back") <= most).drop("back")


def recent_documents(*stores: DataFrame) -> DataFrame:
    """All records of the stores, newest first; columns that a store lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stores).orderBy(F.desc("saved_at"), "id", "kind")


def monotonic_revisions(log: DataFrame) -> DataFrame:
    """Rows whose revision is below that of the row before in the session: (session, seq, revision, before)."""
    before = F.lag("revision").over(Window.partitionBy("session").orderBy("seq"))
    return log.withColumn("before", before).where("revision < before").select("session", "seq", "revision", "before")


def suppress_noops(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows that differ from the row before in any of the columns; the first row of a key stays."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    before = F.lag("digest").over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("digest", digest).withColumn("before", before).where("before is null or digest <> before").drop("digest", "before")
