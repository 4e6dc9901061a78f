"""Edit logs and request traffic: the parts of a replay that set operations express, bursts, duplicates, silence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def rotation_totals(actions: DataFrame) -> DataFrame:
    """E2, rotations alone: (doc, page, rotation): the sum of the turns of each page, modulo 360; turns that are no
    multiple of 90 are ignored. actions: (doc, page, delta)."""
    return actions.where("delta % 90 = 0").groupBy("doc", "page").agg(F.pmod(F.sum("delta"), F.lit(360)).alias("rotation"))


def page_sequence(actions: DataFrame, pages: DataFrame) -> DataFrame:
    """E2, added pages alone: (doc, n_pages, active): each add appends the page `target_id` and activates it; one whose
    id the document has or had added before is refused. actions: (doc, seq, target_id), pages: (doc, page_id, ord)
    of each document before, the first of which is active at the start."""
    first = actions.groupBy("doc", F.col("target_id").alias("page_id")).agg(F.min("seq").alias("seq"))
    added = first.join(pages.select("doc", "page_id"), ["doc", "page_id"], "left_anti")
    rows = pages.select("doc", "page_id", F.lit(None).cast("bigint").alias("seq"), "ord").unionByName(added.withColumn("ord", F.lit(None).cast("bigint")))
    last = F.max_by(F.when(F.col("seq").isNotNull(), F.col("page_id")), F.col("seq"))
    return rows.groupBy("doc").agg(F.count("*").alias("n_pages"), F.coalesce(last, F.min_by("page_id", "ord")).alias("active"))


def edit_ownership(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, edit_id, outcome) of each new edit: refused if an old edit shares some but not all of its lines
    with it, or its own line ids are empty or repeat; else replaced or added. Both: (doc, edit_id, line_ids)."""
    o = old.select("doc", F.col("edit_id").alias("old_id"), F.size("line_ids").alias("size"), F.explode("line_ids").alias("line"))
    n = new.select("doc", "edit_id", F.explode("line_ids").alias("line"))
    shared = n.join(o, ["doc", "line"]).groupBy("doc", "edit_id", "old_id", "size").agg(F.count_distinct("line").alias("shared"))
    state = shared.groupBy("doc", "edit_id").agg(F.bool_or(F.col("shared") < F.col("size")).alias("partly"))
    bad = (F.size("line_ids") == 0) | (F.size(F.array_distinct("line_ids")) < F.size("line_ids"))
    rows = new.join(state, ["doc", "edit_id"], "left")
    outcome = F.when(bad | F.coalesce("partly", F.lit(False)), "refused").when(F.col("partly").isNotNull(), "replaced").otherwise("added")
    return rows.select("doc", "edit_id", outcome.alias("outcome"))


def replace_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, edit_id, line_ids, position): the edits of each document after one new edit each, in order from 0. A
    refused edit changes nothing; one that replaces others stands where the first of them stood, one that replaces
    none at the end. old: (doc, edit_id, line_ids, position), new: (doc, edit_id, line_ids), one row for a
    document."""
    state = edit_ownership(old, new)
    good = new.join(state.where("outcome <> 'refused'").select("doc", "edit_id"), ["doc", "edit_id"])
    lines = good.select("doc", F.explode("line_ids").alias("line"))
    covered = old.select("doc", "edit_id", "position", F.explode("line_ids").alias("line")).join(lines, ["doc", "line"], "left_semi").select("doc", "edit_id", "position").distinct()
    first = covered.groupBy("doc").agg(F.min("position").alias("position"))
    kept = old.join(covered.select("doc", "edit_id"), ["doc", "edit_id"], "left_anti").select("doc", "edit_id", "line_ids", "position", F.lit(0).alias("last"))
    rows = kept.unionByName(good.join(first, "doc", "left").select("doc", "edit_id", "line_ids", "position", F.col("position").isNull().cast("int").alias("last")))
    at = Window.partitionBy("doc").orderBy("last", "position", "edit_id")
    return rows.withColumn("position", (F.row_number().over(at) - 1).cast("bigint")).drop("last")


def remove_edit(edits: DataFrame, removals: DataFrame) -> DataFrame:
    """The edits that hold none of the removed lines (doc, line) of their document."""
    hit = edits.select("doc", "edit_id", F.explode("line_ids").alias("line")).join(removals, ["doc", "line"], "left_semi").select("doc", "edit_id").distinct()
    return edits.join(hit, ["doc", "edit_id"], "left_anti")


def revoke_review(actions: DataFrame) -> DataFrame:
    """E5: (doc, reviewed): whether no content edit, undo or redo came after the last review."""
    g = actions.groupBy("doc").agg(F.max(F.when(F.col("type") == "review", F.col("seq"))).alias("review"), F.max(F.when(~F.col("type").isin("review", "activate", "rename"), F.col("seq"))).alias("edit"))
    return g.select("doc", F.coalesce((F.col("review") > F.coalesce("edit", F.lit(-1))), F.lit(False)).alias("reviewed"))


def structural_change(pages: DataFrame, info: DataFrame) -> DataFrame:
    """(doc_id, changed): whether the page count differs or any page is blank, a copy, moved or rotated.

    pages (doc_id, ord from 1, kind, source_page, original, rotation), info (doc_id, page_count).
    """
    odd = (F.col("kind") == "blank") | ~F.col("original") | (F.col("source_page") != F.col("ord") - 1) | (F.col("rotation") != 0)
    g = pages.groupBy("doc_id").agg(F.bool_or(odd).alias("odd"), F.count("*").alias("n"))
    return g.join(info, "doc_id", "left").select("doc_id", (F.col("odd") | ~F.col("n").eqNullSafe(F.col("page_count"))).alias("changed"))


def debounce(changes: DataFrame, gap: str, key: str = "doc", order: str = "event_id") -> DataFrame:
    """R1, batch: (key, ts, order): the last change of each burst, bursts being `gap` of quiet apart."""
    w = F.session_window("ts", gap)
    last = F.max(F.struct("ts", order))
    return changes.groupBy(key, w).agg(last.alias("last")).select(key, "last.*")


def latest_render(requests: DataFrame) -> DataFrame:
    """R2, batch: of each session and page the newest request."""
    at = Window.partitionBy("session", "page").orderBy(F.desc("event_id"))
    return requests.withColumn("n", F.row_number().over(at)).where("n = 1").drop("n")


def monotonic_dedupe(requests: DataFrame) -> DataFrame:
    """R3, batch: requests whose id is above all ids seen before in the session."""
    before = F.max("request_id").over(Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("before", before).where("before is null or request_id > before").drop("before")


def inflight_coalesce(requests: DataFrame, keys: list[str]) -> DataFrame:
    """R4, batch: one of the requests that ask for the same."""
    return requests.groupBy(*keys).agg(F.min("event_id").alias("event_id"), F.count("*").alias("waiting"))


def stalled_requests(events: DataFrame, seconds: float) -> DataFrame:
    """R5, batch: (session, request, event_id): the events after which a started request was silent for over `seconds`,
    to the microsecond.

    events: (session, request, event_id, ts, phase). The phase `started` starts a request's clock, any other event
    starts it anew, `done` stops it; one that was never started has no clock. A request that has timed out must be
    started again. A last event is followed by silence.
    """
    of = Window.partitionBy("session", "request").orderBy("ts", "event_id")
    quiet = F.expr("timestampdiff(MICROSECOND, ts, later)") > F.lit(round(seconds * 1_000_000))
    rows = events.withColumn("later", F.lead("ts").over(of)).withColumn("silent", F.col("later").isNull() | quiet)
    closed = F.coalesce(F.lag(F.col("silent") | (F.col("phase") == "done")).over(of), F.lit(False))
    rows = rows.withColumn("life", F.sum(closed.cast("int")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy("session", "request", "life").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("clock", F.max(F.col("phase") == "started").over(life))
    return rows.where("silent and clock and phase <> 'done'").select("session", "request", "event_id")


def stale_responses(responses: DataFrame) -> DataFrame:
    """Responses whose generation is the newest that their session has seen when they arrive."""
    newest = F.max("revision").over(Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return responses.withColumn("newest", newest).where("revision = newest").drop("newest")


def gated_saves(changes: DataFrame, gap: str) -> DataFrame:
    """R1 on the changes that don't fall into a composition. composing is null where unknown: the last known holds."""
    state = F.last("composing", ignorenulls=True).over(Window.partitionBy("doc").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return debounce(changes.withColumn("state", F.coalesce(state, F.lit(False))).where("not state"), gap)
