"""Queries over regions, edit logs and request traffic, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import relations as R
from quire.functions.scratch import Scratch
from quire.operators import edits, geometry, regions, replay
from quire.plans.intake import query
from quire.sources.tables import table

#: Where benchmark passages occur: a place in the text of each document that holds one whole.
R.RELATIONS["r_places"] = """SELECT item_id, doc_id, at_off, n FROM (SELECT b.item_id, d.doc_id, position(b.text IN d.text) - 1 AS at_off, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""
R.RELATIONS["r_texts"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Preface. ' || text ELSE text END AS text2, text FROM documents"


#: Passages, and bytes of them, up to which they are broadcast to the documents.
PASSAGES, PASSAGE_BYTES = 100_000, 64 << 20


def places(spark: SparkSession, sf_dir: str, most: int = PASSAGES) -> DataFrame:
    """The passages, a stated query set, against all documents: an equi-join on a passage's first three words and
    every three words in a row of a document, then the whole passage. At most `most` passages of PASSAGE_BYTES are
    broadcast, and documents are read once; with more, documents meet them by their ids and their texts follow. A passage has three
    words at least. What is found is written, so that the documents are searched once, and joined by its own size after: a
    small one goes to the texts."""
    three = r"(?<!\S)\S++\s++\S++\s++\S++"  # without a way back, so linear in tokens of any length
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).withColumn("head", F.regexp_extract("passage", three, 0))
    # the words in threes from the first, the second and the third word on are all three words in a row
    threes = lambda skip: F.regexp_extract_all(F.regexp_replace("text", r"^\s*+" + r"\S++\s++" * skip, ""), F.lit(three), 0)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    d, heads = texts, F.array_distinct(F.concat(threes(0), threes(1), threes(2)))
    n, size = b.agg(F.count("*"), F.sum(F.octet_length("passage"))).first()
    if n <= most and (size or 0) <= PASSAGE_BYTES:
        hits = d.select("doc_id", "text", F.explode(heads).alias("head")).join(F.broadcast(b), "head")
    else:
        hits = d.select("doc_id", F.explode(heads).alias("head")).join(b, "head").join(texts, "doc_id")
    hits = hits.where(F.col("text").contains(F.col("passage")))
    found = hits.select(F.col("item_id").alias("anchor_id"), "doc_id", F.expr("bigint(position(passage, text) - 1)").alias("at"), F.expr("bigint(length(passage))").alias("length")).withColumn("source_id", F.col("doc_id"))
    return Scratch(spark).save(found, "places")


def paragraphs(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    text = F.expr("if(doc_id % 2 = 0, concat('Preface. ', text), text)") if version == 2 else F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("source_id"), text.alias("text"))


@query("SELECT item_id AS anchor_id, p.doc_id, at_off AS \"at\", length(d.text) - at_off - n AS tail, substring(d.text, greatest(0, at_off - 128) + 1, at_off - greatest(0, at_off - 128)) AS before, substring(d.text, at_off + n + 1, 128) AS after, sha256(substring(d.text, at_off + 1, n)) AS text_hash FROM r_places p JOIN documents d ON p.doc_id = d.doc_id")
def t9_capture_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.capture_anchor(places(spark, sf_dir), paragraphs(spark, sf_dir, 1)).select("anchor_id", "doc_id", "at", "tail", "before", "after", "text_hash")


@query("SELECT item_id AS anchor_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'length' WHEN item_id % 3 = 0 AND NOT (at_off >= 5 AND doc_id % 5 <> 1) THEN 'control' WHEN at_off < 40 THEN 'locked' END AS reason FROM r_places")
def j14_resolve_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a second version, in which every other document begins with a preface. Every third anchor stands in
    a control from the sixth character on, whose id is used twice in some documents; the first 40 characters are
    locked."""
    anchors = regions.capture_anchor(places(spark, sf_dir), paragraphs(spark, sf_dir, 1)).withColumn("control_id", F.expr("if(anchor_id % 3 = 0, 'c', null)"))
    second = paragraphs(spark, sf_dir, 2)
    control = lambda name, begin, stop, locked: second.select("doc_id", "source_id", F.lit(name).alias("control_id"), F.expr(begin).alias("begin"), F.expr(stop).alias("stop"), F.lit(locked).alias("locked"))
    controls = control("c", "5L", "bigint(length(text))", False).unionByName(control("lock", "0L", "40L", True)).unionByName(control("c", "0L", "0L", False).where("doc_id % 5 = 1"))
    return regions.resolve_anchor(anchors, second, controls).select("anchor_id", "doc_id", "reason")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_off, item_id) AS k, coalesce(max(at_off + n) OVER (PARTITION BY doc_id ORDER BY at_off, n, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > at_off, false) AS bad FROM r_places),
g AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id) AS refused, first_value(n) OVER (PARTITION BY doc_id ORDER BY k) AS n0, first_value(at_off) OVER (PARTITION BY doc_id ORDER BY k) AS a0 FROM f)
SELECT item_id AS anchor_id, doc_id, CASE WHEN at_off > a0 THEN at_off + 5 - n0 ELSE at_off END AS "at", CASE WHEN k = 1 THEN 5 ELSE n END AS length FROM g WHERE NOT refused""")
def t10_rebase_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first anchor of each document is replaced by five characters."""
    anchors = Scratch(spark).save(regions.capture_anchor(places(spark, sf_dir), paragraphs(spark, sf_dir, 1)), "anchors")
    first = anchors.groupBy("doc_id").agg(F.min(F.struct("at", "anchor_id")).alias("m")).select("doc_id", F.col("m.anchor_id").alias("anchor_id"), F.lit("12345").alias("value"))
    return regions.rebase_anchors(anchors, paragraphs(spark, sf_dir, 1), first)[0].select("anchor_id", "doc_id", "at", "length")


@query("SELECT mapping_id, NOT (doc_id % 13 = 0 AND position('e' IN original_text) > 0) AS matches FROM r_mappings")
def j15_resolve_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.geo_lines(spark, sf_dir).withColumn("text", F.expr("if(doc_id % 13 = 0, replace(text, 'e', 'E'), text)"))
    return regions.resolve_mapping(R.mappings(spark, sf_dir), lines)


_OVER = "a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0"
R.RELATIONS["r_blocked"] = f"""WITH own AS (SELECT mapping_id, doc_id, page_no, unnest(line_nos) AS line_no FROM r_mappings)
SELECT DISTINCT o.mapping_id FROM own o JOIN r_boxes a ON o.doc_id = a.doc_id AND o.line_no = a.line_no JOIN r_boxes b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line_no <> b.line_no AND {_OVER} JOIN own p ON p.doc_id = b.doc_id AND p.line_no = b.line_no WHERE o.mapping_id <> p.mapping_id"""


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of which a line's box meets a line of another mapping."""
    b = R.line_boxes(spark, sf_dir)
    own = R.mappings(spark, sf_dir).select("mapping_id", "doc_id", F.explode("line_nos").alias("line_no"))
    b = b.join(own, ["doc_id", "line_no"])
    hit = geometry.box_join(b, b, lambda x, y: geometry.overlaps(x, y) & (F.col("a_mapping_id") != F.col("b_mapping_id")))
    return hit.select(F.col("a_mapping_id").alias("mapping_id")).distinct()


@query("""SELECT mapping_id, CASE WHEN role = 'locked' THEN 'locked' WHEN len(list_filter(line_nos, lambda n: n % 4 = 3)) > 0 THEN 'editable' WHEN stored_text <> original_text THEN 'stale' WHEN mapping_id IN (SELECT mapping_id FROM r_blocked) THEN 'overlap' END AS reason FROM r_mappings""")
def j16_region_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.geo_lines(spark, sf_dir).select("doc_id", "page_no", "line_no", F.expr("line_no % 4 <> 3").alias("editable"), F.col("text").alias("actual_text"))
    return regions.region_eligibility(R.mappings(spark, sf_dir), lines, blocked(spark, sf_dir))


@query("""SELECT doc_id, ['role', 'kind', 'mapping id', 'anchor', 'line owner', 'selected twice', 'selected'][min(rule)] AS reason FROM (SELECT doc_id, 1 AS rule FROM r_mappings WHERE role = 'phone' AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM r_mappings WHERE doc_id % 29 = 0
UNION ALL SELECT doc_id, 3 FROM r_mappings WHERE doc_id % 19 = 0 AND line_no = 0 UNION ALL SELECT doc_id, 4 FROM r_mappings WHERE doc_id % 17 = 0 AND line_no = 0 UNION ALL SELECT doc_id, 5 FROM r_mappings WHERE doc_id % 23 = 0 AND line_no = 0 AND len(line_nos) > 1
UNION ALL SELECT doc_id, 6 FROM r_mappings WHERE line_no % 2 = 0 AND doc_id % 7 = 0 UNION ALL SELECT doc_id, 7 FROM r_mappings WHERE line_no % 2 = 0 AND role = 'locked') GROUP BY 1""")
def a13_validate_region_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents get unknown roles, another format, repeated ids, anchors or lines, or a selection made twice."""
    m = R.mappings(spark, sf_dir).withColumn("role", F.expr("if(role = 'phone' and doc_id % 3 = 0, 'fax', role)")).withColumn("kind", F.lit("pdf"))
    chosen = m.where("line_no % 2 = 0").select("doc_id", "mapping_id")
    first = m.where("line_no = 0")
    extra = [first.where("doc_id % 19 = 0").withColumn("line_nos", F.array(F.lit(-1).cast("bigint"))), first.where("doc_id % 17 = 0").withColumn("mapping_id", F.concat("mapping_id", F.lit("'"))), first.where("doc_id % 23 = 0 and size(line_nos) > 1").withColumn("mapping_id", F.concat("mapping_id", F.lit('"'))).withColumn("line_nos", F.slice("line_nos", 2, 1))]
    formats = m.select("doc_id").distinct().withColumn("format", F.expr("if(doc_id % 29 = 0, 'docx', 'pdf')"))
    return regions.validate_region_config(m.unionByName(extra[0]).unionByName(extra[1]).unionByName(extra[2]), chosen.unionByName(chosen.where("doc_id % 7 = 0")), list(R.ROLES), formats)


@query("""SELECT m.doc_id, line_no // 2 AS position, mapping_id, role, page_no, stored_text AS text, CASE WHEN bool_or(line_no % 21 = 14 AND m.doc_id % 5 = 0) OVER (PARTITION BY m.doc_id) THEN 'unresolved' WHEN line_no % 3 = 0 THEN 'stale' END AS reason FROM r_mappings m QUALIFY role <> 'locked' AND line_no % 2 = 0""")
def a14_field_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.mappings(spark, sf_dir)
    states = m.select("mapping_id", F.expr("case when line_no % 21 = 14 and doc_id % 5 = 0 then 'unresolved' when line_no % 3 = 0 then 'stale' end").alias("reason"))
    selected = m.where("line_no % 2 = 0").select("doc_id", "mapping_id", F.expr("line_no div 2").alias("position"))
    return regions.field_cards(selected, m, states)


@query("""SELECT mapping_id, CASE WHEN NOT reviewed THEN 'not reviewed' WHEN role = 'locked' THEN 'locked' WHEN stored_text <> original_text THEN 'text' WHEN line_no % 5 = 4 THEN 'revision' WHEN mapping_id IN (SELECT mapping_id FROM r_blocked) THEN 'overlap' ELSE 'applied' END AS outcome,
CASE WHEN reviewed AND role <> 'locked' AND stored_text = original_text AND line_no % 5 <> 4 AND mapping_id NOT IN (SELECT mapping_id FROM r_blocked) THEN 'new' ELSE stored_text END AS text FROM r_mappings""")
def t11_apply_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.mappings(spark, sf_dir).withColumn("revision", F.expr("line_no % 5"))
    proposals = m.select("mapping_id", F.lit("new").alias("value"), F.col("original_text").alias("expected_text"), F.expr("if(line_no % 5 = 4, 0, line_no % 5)").alias("expected_revision"))
    return regions.apply_field_values(proposals, m, blocked(spark, sf_dir))


_GIVEN = "doc_id % 4 = 0 AND line_no % 3 = 0"


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """In every fourth document the first line of some mappings gets a role of its own; even lines are selected."""
    m = R.mappings(spark, sf_dir).select("mapping_id", "doc_id", "page_no", "line_nos", "role", "reviewed", "line_no")
    new = m.where(_GIVEN).withColumn("mapping_id", F.concat(F.lit("n"), "mapping_id")).withColumn("role", F.lit("body")).withColumn("line_nos", F.slice("line_nos", 1, 1)).drop("line_no")
    return regions.assign_roles(m.drop("line_no"), new, m.where("line_no % 2 = 0").select("doc_id", "mapping_id"))


@query(f"""SELECT mapping_id, role, reviewed AND NOT EXISTS (SELECT 1 FROM r_mappings x WHERE x.doc_id = m.doc_id AND x.doc_id % 4 = 0 AND x.line_no % 3 = 0) AS reviewed FROM r_mappings m WHERE NOT ({_GIVEN}) UNION ALL SELECT 'n' || mapping_id, 'body', false FROM r_mappings WHERE {_GIVEN}""")
def t12_assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("mapping_id", "role", "reviewed")


@query(f"SELECT doc_id, mapping_id FROM r_mappings WHERE line_no % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM r_mappings WHERE {_GIVEN})")
def t12_clear_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[1].select("doc_id", "mapping_id")


@query("SELECT mapping_id FROM r_mappings m WHERE role <> 'locked' AND stored_text = original_text AND mapping_id NOT IN (SELECT mapping_id FROM r_blocked)")
def p11_selection_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.mappings(spark, sf_dir)
    return regions.selection_eligible(m.select("mapping_id"), m, m.select("mapping_id", F.col("original_text").alias("actual_text")), blocked(spark, sf_dir))


@query()
def e1_replay_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_actions(R.full_actions(spark, sf_dir))


@query("SELECT doc, k % 5 AS page, (sum(CASE WHEN k % 3 = 0 THEN -90 WHEN k % 3 = 1 THEN 180 END) % 360 + 360)::BIGINT % 360 AS rotation FROM r_actions WHERE type = 'rotate' AND k % 3 <> 2 GROUP BY ALL")
def e2_rotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.actions(spark, sf_dir).where("type = 'rotate'").select("doc", F.expr("k % 5").alias("page"), F.expr("bigint(element_at(array(-90, 180, 45), int(k % 3) + 1))").alias("delta"))
    return edits.rotation_totals(a)


@query("""WITH a AS (SELECT doc, 'n' || k AS page_id, min(seq) AS seq FROM r_actions WHERE type = 'add' AND k % 4 <> 0 GROUP BY ALL)
SELECT d.doc, 3 + count(a.doc) AS n_pages, coalesce(arg_max(page_id, seq), 'p0') AS active FROM (SELECT DISTINCT doc FROM r_actions) d LEFT JOIN a ON d.doc = a.doc GROUP BY 1""")
def e2_page_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages at first; adds of one of them, and of a page added before, are refused."""
    a = R.actions(spark, sf_dir)
    pages = a.select("doc").distinct().select("doc", F.explode(F.expr("sequence(0L, 2L)")).alias("ord")).withColumn("page_id", F.expr("concat('p', ord)"))
    return edits.page_sequence(a.where("type = 'add'").select("doc", "seq", F.expr("if(k % 4 = 0, concat('p', k % 3), concat('n', k))").alias("target_id")), pages)


R.RELATIONS["r_edits"] = "SELECT doc, seq AS edit_id, seq % 2 = 0 AS old, k * 4 AS low, k * 4 + trunc(value)::BIGINT % 4 AS high FROM r_actions"


def _edits(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    rows = R.actions(spark, sf_dir).where(f"(seq % 2 = 0) = {str(old).lower()}")
    return rows.select("doc", F.col("seq").alias("edit_id"), F.expr("sequence(k * 4, k * 4 + bigint(value) % 4)").alias("line_ids"))


@query("""SELECT n.doc, n.edit_id, CASE WHEN bool_or(least(n.high, o.high) - greatest(n.low, o.low) < o.high - o.low) THEN 'refused' WHEN count(o.doc) > 0 THEN 'replaced' ELSE 'added' END AS outcome
FROM r_edits n LEFT JOIN r_edits o ON n.doc = o.doc AND o.old AND o.low <= n.high AND o.high >= n.low WHERE NOT n.old GROUP BY ALL""")
def e3_edit_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edit_ownership(_edits(spark, sf_dir, True), _edits(spark, sf_dir, False))


@query("""WITH n AS (SELECT doc, 1000000 AS edit_id, k * 4 AS low, k * 4 + 5 AS high FROM r_actions WHERE seq = 1), o AS (SELECT doc, edit_id, low, high, row_number() OVER (PARTITION BY doc ORDER BY edit_id) - 1 AS position FROM r_edits WHERE old),
x AS (SELECT n.*, count(o.doc) AS hits, coalesce(bool_or(o.low < n.low OR o.high > n.high), false) AS refused, min(position) AS place FROM n LEFT JOIN o ON n.doc = o.doc AND o.low <= n.high AND o.high >= n.low GROUP BY ALL),
kept AS (SELECT o.doc, o.edit_id, o.low, o.high, o.position, 0 AS last FROM o LEFT JOIN x ON o.doc = x.doc WHERE x.doc IS NULL OR x.refused OR NOT (o.low <= x.high AND o.high >= x.low) UNION ALL SELECT doc, edit_id, low, high, place, CASE WHEN place IS NULL THEN 1 ELSE 0 END FROM x WHERE NOT refused)
SELECT doc, edit_id, low, high, row_number() OVER (PARTITION BY doc ORDER BY last, position, edit_id) - 1 AS position FROM kept""")
def e3_replace_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new edit of six lines for each document."""
    old = _edits(spark, sf_dir, True).withColumn("position", (F.row_number().over(Window.partitionBy("doc").orderBy("edit_id")) - 1).cast("bigint"))
    new = R.actions(spark, sf_dir).where("seq = 1").select("doc", F.lit(1000000).cast("bigint").alias("edit_id"), F.expr("sequence(k * 4, k * 4 + 5)").alias("line_ids"))
    found = edits.replace_edits(old, new)
    return found.select("doc", "edit_id", F.array_min("line_ids").alias("low"), F.array_max("line_ids").alias("high"), "position")


@query("SELECT doc, edit_id FROM r_edits e WHERE old AND NOT EXISTS (SELECT 1 FROM r_actions a WHERE a.doc = e.doc AND a.type = 'undo' AND a.k * 4 + 1 BETWEEN e.low AND e.high)")
def e4_remove_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    removals = R.actions(spark, sf_dir).where("type = 'undo'").select("doc", F.expr("k * 4 + 1").alias("line")).distinct()
    return edits.remove_edit(_edits(spark, sf_dir, True), removals).select("doc", "edit_id")


@query("SELECT doc, coalesce(max(seq) FILTER (type = 'add') > coalesce(max(seq) FILTER (type NOT IN ('add', 'activate')), -1), false) AS reviewed FROM r_actions GROUP BY 1")
def e5_revoke_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.revoke_review(R.actions(spark, sf_dir).withColumn("type", F.expr("if(type = 'add', 'review', type)")))


@query("SELECT p.doc_id, bool_or(kind = 'blank' OR NOT original OR source_page <> ord - 1 OR rotation <> 0) OR count(*) IS DISTINCT FROM any_value(CASE WHEN p.doc_id % 3 = 0 THEN 3 ELSE 1 END) AS changed FROM r_pages p GROUP BY 1")
def e6_structural_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.doc_pages(spark, sf_dir)
    info = pages.select("doc_id").distinct().withColumn("page_count", F.expr("if(doc_id % 3 = 0, 3, 1)"))
    return edits.structural_change(pages, info)




@query("SELECT doc, event_id FROM (SELECT doc, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT *, sum(c) OVER (PARTITION BY doc ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS c FROM r_actions)) GROUP BY doc, burst)")
def r1_debounce_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.debounce(R.actions(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select("doc", "event_id")


@query("SELECT session, page, max(event_id) AS event_id FROM r_requests GROUP BY ALL")
def r2_latest_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.latest_render(R.requests(spark, sf_dir)).select("session", "page", "event_id")


@query("SELECT session, request_id, event_id FROM (SELECT *, max(request_id) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r_requests) WHERE before IS NULL OR request_id > before")
def r3_monotonic_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.monotonic_dedupe(R.requests(spark, sf_dir)).select("session", "request_id", "event_id")


@query("SELECT session, page, revision, min(event_id) AS event_id, count(*) AS waiting FROM r_requests GROUP BY ALL")
def r4_inflight_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.inflight_coalesce(R.requests(spark, sf_dir), ["session", "page", "revision"])


@query("""WITH a AS (SELECT *, lead(ts) OVER w AS later FROM r_request_events WINDOW w AS (PARTITION BY session, request ORDER BY ts, event_id)),
b AS (SELECT *, later IS NULL OR epoch_us(later) - epoch_us(ts) > 86400500000 AS silent FROM a),
c AS (SELECT *, count(*) FILTER (closed) OVER (PARTITION BY session, request ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, lag(silent OR phase = 'done') OVER (PARTITION BY session, request ORDER BY ts, event_id) AS closed FROM b))
SELECT session, request, event_id FROM (SELECT *, bool_or(phase = 'started') OVER (PARTITION BY session, request, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clock FROM c) WHERE silent AND clock AND phase <> 'done'""")
def r5_stalled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.stalled_requests(R.request_events(spark, sf_dir), 86400.5)


@query("SELECT session, event_id, revision FROM (SELECT *, max(revision) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS newest FROM r_requests) WHERE revision = newest")
def r6_stale_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.stale_responses(R.requests(spark, sf_dir)).select("session", "event_id", "revision")


R.RELATIONS["r_gated"] = "SELECT * FROM (SELECT doc, ts, event_id, coalesce(last_value(CASE WHEN type = 'add' THEN true WHEN type = 'undo' THEN false END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS state FROM r_actions) WHERE NOT state"


@query("SELECT doc, event_id FROM (SELECT doc, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT *, sum(c) OVER (PARTITION BY doc ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS c FROM r_gated)) GROUP BY doc, burst)")
def r7_gated_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup begins a composition, an error ends it."""
    a = R.actions(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("composing", F.expr("case type when 'add' then true when 'undo' then false end"))
    return edits.gated_saves(a, "1 hour").select("doc", "event_id")
