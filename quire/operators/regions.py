"""Text anchors and field regions. Offsets are code points.

An anchor is (anchor_id, doc_id, source_id, at, length, tail, before, after, text_hash): a place in a
paragraph with up to CONTEXT characters on either side. paragraphs: (doc_id, source_id, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.scratch import Scratch
from quire.operators.records import first_reason

CONTEXT = 128


def _slice(text: Column, at: Column, length: Column) -> Column:
    return F.substring(text, at + 1, length)


def capture_anchor(places: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Anchors of places (anchor_id, doc_id, source_id, at, length)."""
    rows = places.join(paragraphs, ["doc_id", "source_id"])
    at, n = F.col("at").cast("int"), F.col("length").cast("int")
    low = F.greatest(F.lit(0), at - CONTEXT)
    return rows.select(
        "anchor_id", "doc_id", "source_id", "at", "length", (F.length("text") - at - n).cast("bigint").alias("tail"),
        _slice(F.col("text"), low, at - low).alias("before"), _slice(F.col("text"), at + n, F.lit(CONTEXT)).alias("after"), F.sha2(_slice(F.col("text"), at, n), 256).alias("text_hash"),
    )


def resolve_anchor(anchors: DataFrame, paragraphs: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """(anchor_id, doc_id, reason): null where the anchor resolves in this version, else why not; never guessed.

    The paragraph with its source id must be unique; contexts, length and hash must match. controls:
    (doc_id, source_id, control_id, begin, stop, locked); a locked one that meets the range blocks it. If
    anchors have a column control_id, the control that it names must be unique in the document and contain the
    range; null names none.
    """
    # texts are neither dealt nor sorted to be counted; paragraphs of the anchors alone are
    asked = anchors.select("doc_id", "source_id").distinct()
    held = paragraphs.join(asked, ["doc_id", "source_id"], "left_semi")
    n = F.count("*").over(Window.partitionBy("doc_id", "source_id"))
    rows = anchors.join(held.withColumn("n", n), ["doc_id", "source_id"], "left")
    text, at, length = F.col("text"), F.col("at").cast("int"), F.col("length").cast("int")
    before, after = F.col("before"), F.col("after")
    rules = [
        ("paragraph", F.col("n").isNull() | (F.col("n") != 1)), ("offset", (at < F.length(before)) | (F.col("tail") < F.length(after))), ("length", F.length(text) != at + length + F.col("tail")),
        ("before", _slice(text, at - F.length(before), F.length(before)) != before), ("after", _slice(text, at + length, F.length(after)) != after), ("text", F.sha2(_slice(text, at, length), 256) != F.col("text_hash")),
    ]
    named = "control_id" in anchors.columns
    keys = ["anchor_id", "doc_id", "source_id", "at", "length", *(["control_id"] if named else [])]
    rows = rows.withColumn("reason", first_reason(rules)).groupBy(*keys).agg(F.max("reason").alias("reason"))
    if controls is None:
        return rows.select("anchor_id", "doc_id", "reason")
    own = ["anchor_id", "doc_id"]
    if named:
        times = F.count("*").over(Window.partitionBy("doc_id", "control_id"))
        known = controls.where("control_id is not null").withColumn("times", times).where("times = 1").select("doc_id", "source_id", "control_id", "begin", "stop")
        held = rows.join(known, ["doc_id", "source_id", "control_id"]).where("begin <= at and at + length <= stop").select(*own, F.lit(True).alias("held"))
        rows = rows.join(held, own, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("control_id").isNotNull() & F.col("held").isNull(), "control")))
    locked = controls.where("locked").select("doc_id", "source_id", "begin", "stop")
    hit = rows.join(locked, ["doc_id", "source_id"]).where("begin < at + length and stop > at").select(*own).distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, own, "left").select(*own, F.coalesce("reason", F.when(F.col("hit"), "locked")).alias("reason"))


def rebase_anchors(anchors: DataFrame, paragraphs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebased anchors, refusals (doc_id, reason)) after edits (doc_id, anchor_id, value), one for a document.

    A document is refused as a whole if an anchor is unresolved or two overlap or stand at the same empty
    position. Otherwise the edited paragraph gets the value, later anchors in it shift by the difference in
    length, and all anchors of the document are captured again. Anchors, and the paragraphs that hold one, are written
    first: each of the steps below would else find them again.
    """
    scratch = Scratch(anchors.sparkSession)
    anchors = scratch.save(anchors, "anchors")
    asked = anchors.select("doc_id", "source_id").distinct()
    paragraphs = scratch.save(paragraphs.join(asked, ["doc_id", "source_id"], "left_semi"), "paragraphs")
    state = resolve_anchor(anchors, paragraphs)
    at = Window.partitionBy("doc_id", "source_id").orderBy("at", "length", "anchor_id")
    order = anchors.withColumn("stop", F.col("at") + F.col("length"))
    before = F.max("stop").over(at.rowsBetween(Window.unboundedPreceding, -1))
    same = (F.lag("at").over(at) == F.col("at")) & (F.lag("length").over(at) == 0) & (F.col("length") == 0)
    clash = order.withColumn("bad", F.coalesce((before > F.col("at")) | same, F.lit(False))).where("bad").select("doc_id", F.lit("overlap").alias("reason"))
    refused = state.where("reason is not null").select("doc_id", F.lit("unresolved").alias("reason")).unionByName(clash)
    refused = refused.groupBy("doc_id").agg(F.max("reason").alias("reason")).join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
    good = edits.join(refused, "doc_id", "left_anti").join(anchors.select("doc_id", "anchor_id", F.col("source_id").alias("e_source"), F.col("at").alias("e_at"), F.col("length").alias("e_length")), ["doc_id", "anchor_id"])
    good = good.withColumn("by", F.length("value") - F.col("e_length"))
    changed = paragraphs.join(good.select("doc_id", F.col("e_source").alias("source_id"), "e_at", "e_length", "value"), ["doc_id", "source_id"], "left")
    text = F.when(F.col("value").isNull(), F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, int(e_at))"), F.col("value"), F.expr("substring(text, int(e_at + e_length) + 1)")))
    changed = changed.select("doc_id", "source_id", text.alias("text"))
    moved = anchors.join(good.select("doc_id", F.col("anchor_id").alias("e_anchor"), "e_source", "e_at", "by"), "doc_id")
    later = (F.col("source_id") == F.col("e_source")) & (F.col("at") > F.col("e_at"))
    places = moved.select("anchor_id", "doc_id", "source_id", F.when(later, F.col("at") + F.col("by")).otherwise(F.col("at")).alias("at"), F.when(F.col("anchor_id") == F.col("e_anchor"), F.col("length") + F.col("by")).otherwise(F.col("length")).alias("length"))
    return capture_anchor(places, changed), refused


def resolve_mapping(mappings: DataFrame, lines: DataFrame) -> DataFrame:
    """(mapping_id, matches): page, ordered line list and original text equal the page's own.

    mappings (mapping_id, doc_id, page_no, line_nos ARRAY, original_text), lines (doc_id, page_no, line_no, text).
    """
    own = mappings.select("mapping_id", "doc_id", "page_no", F.posexplode("line_nos").alias("n", "line_no"))
    text = own.join(lines.select("doc_id", "page_no", "line_no", "text"), ["doc_id", "page_no", "line_no"]).groupBy("mapping_id").agg(F.count("*").alias("found"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("now"))
    same = (F.col("found") == F.size("line_nos")) & (F.col("now") == F.col("original_text"))
    return mappings.join(text, "mapping_id", "left").select("mapping_id", F.coalesce(same, F.lit(False)).alias("matches"))


def region_eligibility(mappings: DataFrame, lines: DataFrame, blocking: DataFrame) -> DataFrame:
    """(mapping_id, reason): null if the region may be edited: one owner of each line, not locked, all lines
    editable, its stored text is the actual one (its lines joined by line feeds), and no line that is unmapped or
    locked overlaps it. mappings: (mapping_id, doc_id, page_no, line_nos, role, stored_text), lines: (doc_id,
    page_no, line_no, editable, actual_text), blocking: (mapping_id)."""
    own = mappings.select("mapping_id", "doc_id", "page_no", F.posexplode("line_nos").alias("n", "line_no"))
    own = own.withColumn("owners", F.count("*").over(Window.partitionBy("doc_id", "page_no", "line_no"))).join(lines.select("doc_id", "page_no", "line_no", "editable", "actual_text"), ["doc_id", "page_no", "line_no"], "left")
    actual = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "actual_text"))), lambda x: x["actual_text"]), "\n")
    own = own.groupBy("mapping_id").agg(F.max("owners").alias("owners"), F.bool_and(F.coalesce("editable", F.lit(False))).alias("editable"), actual.alias("actual"))
    hit = blocking.select("mapping_id").distinct().withColumn("hit", F.lit(True))
    rows = mappings.select("mapping_id", "role", "stored_text").join(own, "mapping_id", "left").join(hit, "mapping_id", "left")
    reason = first_reason([("owner", F.col("owners") != 1), ("locked", F.col("role") == "locked"), ("editable", ~F.col("editable")), ("stale", F.col("stored_text") != F.col("actual")), ("overlap", F.coalesce("hit", F.lit(False)))])
    return rows.select("mapping_id", reason.alias("reason"))


def validate_region_config(mappings: DataFrame, selected: DataFrame, roles: list[str], formats: DataFrame) -> DataFrame:
    """(doc_id, reason): the first broken rule of each document that has one: roles known, anchors of the kind of
    the document's format, ids unique, no two mappings with one anchor, each line of a page owned once, selected ids
    unique, and of unlocked mappings.

    mappings: (mapping_id, doc_id, page_no, line_nos, role, kind), selected: (doc_id, mapping_id), formats: (doc_id,
    format). A mapping's anchor is its page and the ordered list of its lines.
    """
    several = lambda rows, *keys: rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).where("n > 1")
    found = [
        mappings.where(~F.coalesce(F.col("role").isin(*roles, "locked"), F.lit(False))),
        mappings.join(formats, "doc_id", "left").where("not (kind <=> format)"),
        several(mappings, "mapping_id"),
        several(mappings, "kind", "page_no", "line_nos"),
        several(mappings.select("doc_id", "page_no", F.explode("line_nos").alias("line_no")), "page_no", "line_no"),
        several(selected, "mapping_id"),
        selected.join(mappings.where("role <> 'locked'").select("doc_id", "mapping_id"), ["doc_id", "mapping_id"], "left_anti"),
    ]
    names = ["role", "kind", "mapping id", "anchor", "line owner", "selected twice", "selected"]
    worst = reduce(lambda a, b: a.unionByName(b), [rows.select("doc_id", F.lit(i + 1).alias("rule")) for i, rows in enumerate(found)]).groupBy("doc_id").agg(F.min("rule").alias("rule"))
    return worst.select("doc_id", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("rule")).alias("reason"))


def field_cards(selected: DataFrame, mappings: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, position, mapping_id, role, page_no, text, reason) of selected unlocked mappings in selection order. If
    any mapping of the document is unresolved, all its cards get that reason. states: (mapping_id, reason)."""
    rows = mappings.join(states, "mapping_id", "left")
    stop = rows.groupBy("doc_id").agg(F.bool_or(F.col("reason") == "unresolved").alias("stop"))
    cards = selected.join(rows.where("role <> 'locked'").select("mapping_id", "role", "page_no", F.col("stored_text").alias("text"), "reason"), "mapping_id").join(stop, "doc_id")
    return cards.select("doc_id", "position", "mapping_id", "role", "page_no", "text", F.when(F.coalesce("stop", F.lit(False)), "unresolved").otherwise(F.col("reason")).alias("reason"))


def apply_field_values(proposals: DataFrame, mappings: DataFrame, blocking: DataFrame) -> DataFrame:
    """(mapping_id, outcome, text): applied, or the first reason against it, and the text afterwards.

    proposals: (mapping_id, value, expected_text, expected_revision), one for a mapping; mappings also have
    reviewed and revision; blocking: mapping ids that a locked box meets.
    """
    hit = blocking.select("mapping_id").distinct().withColumn("hit", F.lit(True))
    rows = proposals.join(mappings, "mapping_id", "left").join(hit, "mapping_id", "left")
    rules = [("unknown", F.col("role").isNull()), ("not reviewed", ~F.col("reviewed")), ("locked", F.col("role") == "locked"), ("text", F.col("stored_text") != F.col("expected_text")), ("revision", F.col("revision") != F.col("expected_revision")), ("overlap", F.coalesce("hit", F.lit(False)))]
    reason = first_reason(rules)
    return rows.select("mapping_id", F.coalesce(reason, F.lit("applied")).alias("outcome"), F.when(reason.isNull(), F.col("value")).otherwise(F.col("stored_text")).alias("text"))


def assign_roles(mappings: DataFrame, new: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, selection): new mappings in place of those that share a line on their page; documents that get
    one lose their review and their selection. mappings and new: (mapping_id, doc_id, page_no, line_nos, role,
    reviewed), selected: (doc_id, mapping_id)."""
    line = lambda rows: rows.select("mapping_id", "doc_id", "page_no", F.explode("line_nos").alias("line_no"))
    taken = line(new).select("doc_id", "page_no", "line_no").distinct()
    lost = line(mappings).join(taken, ["doc_id", "page_no", "line_no"], "left_semi").select("mapping_id").distinct()
    touched = new.select("doc_id").distinct().withColumn("touched", F.lit(True))
    kept = mappings.join(lost, "mapping_id", "left_anti").join(touched, "doc_id", "left")
    kept = kept.withColumn("reviewed", F.col("reviewed") & F.col("touched").isNull()).select(*new.columns)
    return kept.unionByName(new.withColumn("reviewed", F.lit(False))), selected.join(touched, "doc_id", "left_anti")


def selection_eligible(requests: DataFrame, mappings: DataFrame, actual: DataFrame, blocked: DataFrame) -> DataFrame:
    """Requested mapping ids that aren't locked, whose stored text is the actual one, and that no locked box meets."""
    rows = requests.join(mappings.where("role <> 'locked'"), "mapping_id").join(actual, "mapping_id").where("stored_text = actual_text")
    return rows.select("mapping_id").join(blocked.select("mapping_id"), "mapping_id", "left_anti")
