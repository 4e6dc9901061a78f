"""Queries over geometry operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import relations as R
from quire.operators import geometry as op
from quire.plans.intake import query

#: Two lines of text share a row; rows are 18 points apart, the second line begins right of the first.
R.RELATIONS["r_rows"] = """SELECT doc_id, page_no, line_no, text, size_pt, 60.0::DOUBLE + 9.0::DOUBLE * ((line_no % 40) - (line_no % 2)) + 0.4::DOUBLE * (line_no % 2) AS v, u + 130.0::DOUBLE * (line_no % 2) AS u,
u + 130.0::DOUBLE * (line_no % 2) + least(end_u - u, 125.0::DOUBLE) AS end_u, (line_no % 40) // 2 AS row_no FROM r_geo"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.geo_lines(spark, sf_dir).withColumn("w", F.expr("least(end_u - u, 125D)"))
    g = g.withColumn("v", F.expr("60D + 9D * ((line_no % 40) - (line_no % 2)) + 0.4D * (line_no % 2)")).withColumn("u", F.expr("u + 130D * (line_no % 2)"))
    return g.withColumn("end_u", F.expr("u + w")).drop("w")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their rows, as the fixture lays them out."""
    return items(spark, sf_dir).withColumn("row_no", F.expr("(line_no % 40) div 2"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.geo_lines(spark, sf_dir).where("page_no % 2 = 0").select(*op.PAGE).distinct()
    return p.select(*op.PAGE, F.lit(45.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(120.0).alias("x1"), F.lit(420.0).alias("y1"))


R.RELATIONS["r_images"] = "SELECT DISTINCT doc_id, page_no, 45.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, 120.0::DOUBLE AS x1, 420.0::DOUBLE AS y1 FROM r_geo WHERE page_no % 2 = 0"


@query("SELECT q.vec_id, min(t.vec_id) AS match FROM r_points q JOIN r_points t ON q.page_no = t.page_no AND (t.vec_id // 20) % 2 = 0 AND sqrt((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)) < 0.5 WHERE (q.vec_id // 20) % 2 = 1 GROUP BY 1")
def j6_near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.points(spark, sf_dir)
    return op.near_match(p.where("(vec_id div 20) % 2 = 1"), p.where("(vec_id div 20) % 2 = 0"), 0.5, ["page_no"]).where("match is not null")


#: Lines in three directions, with a glyph every six points, and other lines that begin near one of their glyphs.
_WAYS = "CASE line_no % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
_DX, _DY = _WAYS.format("1.0::DOUBLE", "0.6::DOUBLE", "0.8::DOUBLE"), _WAYS.format("0.0::DOUBLE", "0.8::DOUBLE", "-0.6::DOUBLE")
R.RELATIONS["r_slanted"] = f"SELECT doc_id, page_no, line_no AS line_id, u AS x, v AS y, {_DX} AS dx, {_DY} AS dy FROM r_geo"
R.RELATIONS["r_slanted_glyphs"] = "SELECT doc_id, page_no, line_id, x + 6.0::DOUBLE * k * dx AS x, y + 6.0::DOUBLE * k * dy AS y FROM (SELECT *, unnest(range(12)) AS k FROM r_slanted)"
R.RELATIONS["r_slanted_others"] = """SELECT doc_id, page_no, line_id, x + 6.0::DOUBLE * (line_id % 5) * dx - off * dy AS x, y + 6.0::DOUBLE * (line_id % 5) * dy + off * dx AS y, dx + CASE line_id % 4 WHEN 1 THEN 0.0004::DOUBLE WHEN 2 THEN 0.0015::DOUBLE ELSE 0.0::DOUBLE END AS dx, dy
FROM (SELECT *, CASE line_id % 7 WHEN 3 THEN 0.015::DOUBLE WHEN 4 THEN 0.025::DOUBLE ELSE 0.0::DOUBLE END AS off FROM r_slanted)"""


def slanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ways = lambda a, b, c: F.expr(f"case line_no % 3 when 0 then {a} when 1 then {b} else {c} end")
    lines = R.geo_lines(spark, sf_dir).select("doc_id", "page_no", F.col("line_no").alias("line_id"), F.col("u").alias("x"), F.col("v").alias("y"), ways("1D", "0.6D", "0.8D").alias("dx"), ways("0D", "0.8D", "-0.6D").alias("dy"))
    glyphs = lines.withColumn("k", F.explode(F.expr("sequence(0, 11)"))).select("doc_id", "page_no", "line_id", F.expr("x + 6D * k * dx").alias("x"), F.expr("y + 6D * k * dy").alias("y"))
    off = lines.withColumn("off", F.expr("case line_id % 7 when 3 then 0.015D when 4 then 0.025D else 0D end"))
    others = off.select("doc_id", "page_no", "line_id", F.expr("x + 6D * (line_id % 5) * dx - off * dy").alias("x"), F.expr("y + 6D * (line_id % 5) * dy + off * dx").alias("y"), F.expr("dx + case line_id % 4 when 1 then 0.0004D when 2 then 0.0015D else 0D end").alias("dx"), "dy")
    return lines, glyphs, others


@query("""SELECT DISTINCT a.doc_id, a.page_no, a.line_id AS a, b.line_id AS b FROM r_slanted a JOIN r_slanted_others b ON a.doc_id = b.doc_id AND a.page_no = b.page_no JOIN r_slanted_glyphs g ON g.doc_id = a.doc_id AND g.page_no = a.page_no AND g.line_id = a.line_id
WHERE sqrt((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy)) < 0.001 AND abs((b.x - a.x) * a.dy - (b.y - a.y) * a.dx) < 0.02 AND sqrt((b.x - g.x) * (b.x - g.x) + (b.y - g.y) * (b.y - g.y)) < 0.02""")
def j7_same_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.same_baseline(*slanted(spark, sf_dir), op.PAGE)


@query("SELECT a.doc_id, a.page_no, a.line_no AS a, b.line_no AS b FROM r_boxes a JOIN r_boxes b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line_no < b.line_no AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0")
def j8_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.line_boxes(spark, sf_dir)
    return op.box_join(b, b, lambda x, y: op.overlaps(x, y) & (F.col("a_line_no") < F.col("b_line_no"))).select(*op.PAGE, F.col("a_line_no").alias("a"), F.col("b_line_no").alias("b"))


@query("SELECT i.doc_id, i.page_no, b.line_no FROM r_images i JOIN r_boxes b ON i.doc_id = b.doc_id AND i.page_no = b.page_no AND i.x0 <= b.x0 AND i.y0 <= b.y0 AND i.x1 >= b.x1 AND i.y1 >= b.y1")
def j9_box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.box_join(images(spark, sf_dir), R.line_boxes(spark, sf_dir), op.contains).select(*op.PAGE, F.col("b_line_no").alias("line_no"))


@query("""WITH hit AS (SELECT doc_id, page_no, line_no FROM r_boxes WHERE 60 + doc_id % 50 <= x1 AND 110 + doc_id % 50 >= x0 AND 105 <= y1 AND 240 >= y0)
SELECT doc_id, page_no, line_no FROM hit UNION SELECT l.doc_id, l.page_no, l.line_no FROM r_geo l JOIN hit h ON l.doc_id = h.doc_id AND l.page_no = h.page_no AND l.line_no // 4 = h.line_no // 4 AND (l.line_no // 4) % 3 = 0""")
def j10_select_by_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query rectangle on each page; every third four lines are a group."""
    g = R.geo_lines(spark, sf_dir)
    rect = g.select(*op.PAGE).distinct().select(*op.PAGE, F.expr("60D + doc_id % 50").alias("x0"), F.lit(105.0).alias("y0"), F.expr("110D + doc_id % 50").alias("x1"), F.lit(240.0).alias("y1"))
    groups = g.where("(line_no div 4) % 3 = 0").select(*op.PAGE, F.expr("line_no div 4").alias("group_id"), "line_no")
    return op.select_by_rectangle(rect, R.line_boxes(spark, sf_dir), groups)


_OVER = "a.x0 < b.x1 - 0.01::DOUBLE AND a.x1 > b.x0 + 0.01::DOUBLE AND a.y0 < b.y1 - 0.01::DOUBLE AND a.y1 > b.y0 + 0.01::DOUBLE"
R.RELATIONS["r_layouts"] = "SELECT doc_id, page_no, line_no AS edit_id, line_no % 2 = 0 AS grouped, x0, y0, x1 + 20.0::DOUBLE AS x1, y1 + CASE WHEN line_no % 6 = 0 THEN 120.0::DOUBLE ELSE 0.0::DOUBLE END AS y1 FROM r_boxes WHERE line_no % 3 = 0"
R.RELATIONS["r_unedited"] = "SELECT * FROM r_boxes WHERE line_no % 3 <> 0"


@query(f"""SELECT l.doc_id, l.page_no, l.edit_id, coalesce(min(code), 0)::BIGINT AS code FROM r_layouts l LEFT JOIN (
SELECT doc_id, page_no, edit_id, 1 AS code FROM r_layouts WHERE NOT (x0 >= -0.01::DOUBLE AND y0 >= -0.01::DOUBLE AND x1 <= 250.01::DOUBLE AND y1 <= 840.01::DOUBLE)
UNION ALL SELECT doc_id, page_no, edit_id, 2 AS code FROM r_layouts WHERE edit_id % 5 = 0 AND x1 > 60.01::DOUBLE
UNION ALL SELECT a.doc_id, a.page_no, a.edit_id, 3 FROM r_layouts a JOIN r_unedited b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_OVER}
UNION ALL SELECT a.doc_id, a.page_no, a.edit_id, 4 FROM r_layouts a JOIN r_images b ON a.grouped AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND {_OVER} AND NOT (b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1)
UNION ALL SELECT a.doc_id, a.page_no, a.edit_id, 5 FROM r_layouts a JOIN r_layouts b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.edit_id <> b.edit_id AND {_OVER}) c
ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.edit_id = c.edit_id GROUP BY 1, 2, 3""")
def j11_layout_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is edited; of those every fifth line has a clip box that ends at 60 points."""
    b = R.line_boxes(spark, sf_dir)
    layouts = b.where("line_no % 3 = 0").select(*op.PAGE, F.col("line_no").alias("edit_id"), F.expr("line_no % 2 = 0").alias("grouped"), "x0", "y0", F.expr("x1 + 20D").alias("x1"), F.expr("y1 + if(line_no % 6 = 0, 120D, 0D)").alias("y1"))
    clips = layouts.where("edit_id % 5 = 0").select(*op.PAGE, "edit_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(2000.0).alias("y1"))
    return op.layout_collisions(layouts, b.where("line_no % 3 <> 0"), images(spark, sf_dir), (0.0, 0.0, 250.0, 840.0), clips)


@query("SELECT doc_id, page_no, 'line:' || line_no AS target, false AS edited FROM r_geo WHERE (line_no % 40) NOT IN (3, 4) UNION ALL SELECT DISTINCT doc_id, page_no, 'edit:' || page_no, true FROM r_geo")
def j5_overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit on each page owns its fourth and fifth line."""
    g = R.geo_lines(spark, sf_dir)
    edits = g.select(*op.PAGE).distinct().select(*op.PAGE, F.col("page_no").alias("edit_id"), F.expr("array(page_no * 40 + 3, page_no * 40 + 4)").alias("line_nos"))
    return op.overlay_edits(g, edits)


#: Ink of the items of a row, a rule under some rows that is broad enough on some pages, and rules between items.
R.RELATIONS["r_ink"] = "SELECT doc_id, page_no, row_no, line_no AS item_no, u AS x0, v - 9 AS y0, end_u AS x1, v + 3 AS y1 FROM r_rows"
R.RELATIONS["r_rules"] = """SELECT DISTINCT doc_id, page_no, 400.0::DOUBLE AS x0, r.y AS y0, CASE WHEN doc_id % 3 = 0 THEN 60.0::DOUBLE ELSE 30.0::DOUBLE END AS x1, r.y AS y1 FROM r_geo, (VALUES (64.5::DOUBLE), (120.0::DOUBLE), (156.0::DOUBLE)) r(y)
UNION ALL SELECT DISTINCT doc_id, page_no, 164.0::DOUBLE, 40.0::DOUBLE, 164.0::DOUBLE, CASE WHEN page_no % 2 = 0 THEN 130.0::DOUBLE ELSE 1000.0::DOUBLE END FROM r_geo"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.geo_lines(spark, sf_dir).select(*op.PAGE).distinct()
    across = pages.select(*op.PAGE, F.lit(400.0).alias("x0"), F.explode(F.array(F.lit(64.5), F.lit(120.0), F.lit(156.0))).alias("y0"), F.expr("if(doc_id % 3 = 0, 60D, 30D)").alias("x1")).withColumn("y1", F.col("y0"))
    return across.unionByName(pages.select(*op.PAGE, F.lit(164.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit(164.0).alias("x1"), F.expr("if(page_no % 2 = 0, 130D, 1000D)").alias("y1")))


@query("""WITH w AS (SELECT doc_id, page_no, row_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r_ink GROUP BY ALL),
h AS (SELECT doc_id, page_no, row_no, NULL::BIGINT AS item_no, lag(y1) OVER o AS low, y0 AS high, least(x0, lag(x0) OVER o) AS f, greatest(x1, lag(x1) OVER o) AS t, lag(y1) OVER o IS NOT NULL AS pair FROM w WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY row_no)),
v AS (SELECT doc_id, page_no, row_no, item_no, lag(x1) OVER o AS low, x0 AS high, least(y0, lag(y0) OVER o) AS f, greatest(y1, lag(y1) OVER o) AS t, lag(x1) OVER o IS NOT NULL AS pair FROM r_ink WINDOW o AS (PARTITION BY doc_id, page_no, row_no ORDER BY x0, item_no))
SELECT h.doc_id, h.page_no, row_no, -1::BIGINT AS item_no, r.y0 AS place FROM h JOIN r_rules r ON h.doc_id = r.doc_id AND h.page_no = r.page_no WHERE pair AND abs(r.y0 - r.y1) < 0.01 AND r.y0 > low + 0.01::DOUBLE AND r.y0 < high - 0.01::DOUBLE AND least(r.x0, r.x1) <= f + 0.01::DOUBLE AND greatest(r.x0, r.x1) >= t - 0.01::DOUBLE
UNION ALL SELECT v.doc_id, v.page_no, row_no, item_no, r.x0 FROM v JOIN r_rules r ON v.doc_id = r.doc_id AND v.page_no = r.page_no WHERE pair AND abs(r.x0 - r.x1) < 0.01 AND r.x0 > low + 0.01::DOUBLE AND r.x0 < high - 0.01::DOUBLE AND least(r.y0, r.y1) <= f + 0.01::DOUBLE AND greatest(r.y0, r.y1) >= t - 0.01::DOUBLE""")
def j20_ruling_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = rows(spark, sf_dir).select(*op.PAGE, "row_no", F.col("line_no").alias("item_no"), F.col("u").alias("x0"), (F.col("v") - 9).alias("y0"), F.col("end_u").alias("x1"), (F.col("v") + 3).alias("y1"))
    return op.ruling_crossings(ink, rules(spark, sf_dir)).withColumn("item_no", F.coalesce("item_no", F.lit(-1).cast("bigint")))


@query("""WITH g AS (SELECT doc_id, page_no, min(v) AS v0, max(v) AS v1, min(u) AS l, max(end_u) AS r FROM r_geo WHERE line_no % 40 IN (2, 5, 9) GROUP BY ALL)
SELECT x.doc_id, x.page_no, x.page_no AS group_id, line_no FROM r_geo x JOIN g ON x.doc_id = g.doc_id AND x.page_no = g.page_no WHERE line_no % 40 NOT IN (2, 5, 9) AND v >= v0 - 0.5 AND v <= v1 + 0.5 AND u < r AND end_u > l""")
def j21_intervening_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third, sixth and tenth line of each page are selected as a group."""
    g = R.geo_lines(spark, sf_dir)
    members = g.where("line_no % 40 in (2, 5, 9)").withColumn("group_id", F.col("page_no"))
    groups = members.groupBy(*op.PAGE, "group_id").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("u").alias("left"), F.max("end_u").alias("right"))
    return op.intervening_lines(groups, members.select(*op.PAGE, "group_id", "line_no"), g)


@query("SELECT vec_id, round(x * 2 + y * 0.5 + page_no, 6) AS tx, round(x * -1 + y * 1.5 + 3, 6) AS ty FROM r_points")
def p7_transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.points(spark, sf_dir)
    m = p.select("page_no").distinct().select("page_no", F.lit(2.0).alias("a"), F.lit(-1.0).alias("b"), F.lit(0.5).alias("c"), F.lit(1.5).alias("d"), F.col("page_no").cast("double").alias("e"), F.lit(3.0).alias("f"))
    return op.transform_points(p, m, ["page_no"]).select("vec_id", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


_BOX = "least(x0 * 2 + y0 * 0.5, x0 * 2 + y1 * 0.5, x1 * 2 + y0 * 0.5, x1 * 2 + y1 * 0.5) + {0} AS x0, least(x0 * -1 + y0 * 1.5, x0 * -1 + y1 * 1.5, x1 * -1 + y0 * 1.5, x1 * -1 + y1 * 1.5) + 3 AS y0"


@query(f"SELECT doc_id, page_no, line_no, round({_BOX.format('page_no').replace(' AS x0, ', ', 4) AS x0, round(').replace(' AS y0', ', 4) AS y0')}, round({_BOX.format('page_no').replace('least', 'greatest').replace(' AS x0, ', ', 4) AS x1, round(').replace(' AS y0', ', 4) AS y1')} FROM r_boxes")
def p7_transform_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.line_boxes(spark, sf_dir)
    m = b.select("page_no").distinct().select("page_no", F.lit(2.0).alias("a"), F.lit(-1.0).alias("b"), F.lit(0.5).alias("c"), F.lit(1.5).alias("d"), F.col("page_no").cast("double").alias("e"), F.lit(3.0).alias("f"))
    return op.transform_boxes(b, m, ["page_no"]).select("doc_id", "page_no", "line_no", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT doc_id, metric, coalesce(n, -1) AS n, reason FROM (WITH d AS (SELECT doc_id, doc_id % 4 <> 3 AS pdf, doc_id % 8 <> 7 AS structure, count(DISTINCT page_no) AS p, count(*) AS l, bool_or(page_no % 7 = 6) AS failed, count(*) FILTER (length(text) % 5 = 1) AS t, count(*) FILTER (length(text) % 5 = 2) AS f FROM r_geo GROUP BY 1)
SELECT doc_id, 'pages' AS metric, p AS n, NULL AS reason FROM d UNION ALL SELECT doc_id, 'lines', CASE WHEN pdf AND NOT failed THEN l END, CASE WHEN NOT pdf THEN 'depends on the layout' WHEN failed THEN 'text of a page is unavailable' END FROM d
UNION ALL SELECT doc_id, unnest(['tables', 'fields']), unnest([CASE WHEN NOT pdf AND structure THEN t END, CASE WHEN NOT pdf AND structure THEN f END]), CASE WHEN pdf THEN 'not in this format' WHEN NOT structure THEN 'structure is unavailable' END FROM d)""")
def a3_document_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document is a flowing one; lines stand for nodes of its structure by their length."""
    g = R.geo_lines(spark, sf_dir)
    pages = g.select(*op.PAGE).distinct().withColumn("ok", F.expr("page_no % 7 <> 6"))
    nodes = g.select("doc_id", F.expr("element_at(array('text', 'table', 'field', 'text', 'image'), length(text) % 5 + 1)").alias("node_type"))
    formats = g.select("doc_id").distinct().select("doc_id", F.expr("if(doc_id % 4 = 3, 'docx', 'pdf')").alias("format"), F.expr("doc_id % 8 <> 7").alias("structure"))
    return op.document_analysis(pages, g, nodes, formats).fillna(-1, ["n"])


@query("""SELECT doc_id, line_no, text, length(text)::BIGINT AS n, 40.0::DOUBLE AS origin_x, 100.0::DOUBLE AS origin_y, CASE WHEN doc_id % 2 = 1 THEN 32.0::DOUBLE ELSE 40.0::DOUBLE END AS x0, 100.0::DOUBLE AS y0, CASE WHEN doc_id % 2 = 1 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE + 6.0::DOUBLE * length(text) END AS x1,
CASE WHEN doc_id % 2 = 1 THEN 100.0::DOUBLE + 6.0::DOUBLE * length(text) ELSE 108.0::DOUBLE END AS y1, 6.0::DOUBLE * length(text) AS width FROM r_lines WHERE text <> ''""")
def a4_assemble_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs six points wide and eight high; lines of odd documents run downwards."""
    lines = R.lines(spark, sf_dir).select("doc_id", "line_no", F.split("text", "").alias("letters"))
    chars = lines.select("doc_id", "line_no", F.posexplode("letters").alias("char_no", "ch")).where("ch <> ''").drop("ch")
    chars = chars.withColumn("down", F.expr("doc_id % 2 = 1")).withColumn("dx", F.expr("if(down, 0D, 1D)")).withColumn("dy", F.expr("if(down, 1D, 0D)"))
    chars = chars.withColumn("x", F.expr("40D + 6D * char_no * dx")).withColumn("y", F.expr("100D + 6D * char_no * dy"))
    corner = lambda a, b: f"struct(x + {a} * dx - {b} * dy as x, y + {a} * dy + {b} * dx as y)"
    quad = F.expr(f"array({corner('0D', '0D')}, {corner('6D', '0D')}, {corner('0D', '8D')}, {corner('6D', '8D')})")
    return op.assemble_lines(lines, chars.withColumn("quad", quad))


@query("""SELECT l.doc_id, l.line_no, CASE WHEN doc_id % 10 = 0 AND position('e' IN text) > 0 THEN 1 WHEN line_no % 17 = 5 OR line_no % 19 = 5 THEN 2 WHEN doc_id % 7 = 3 AND position('e' IN text) > 0 THEN 3 WHEN line_no % 13 = 7 OR line_no % 11 = 7 THEN 4 WHEN text LIKE '% -%' THEN 5 WHEN EXISTS (SELECT 1 FROM r_boxes a JOIN r_boxes b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line_no <> b.line_no AND a.x0 < b.x1 - 0.01::DOUBLE AND a.x1 > b.x0 + 0.01::DOUBLE AND a.y0 < b.y1 - 0.01::DOUBLE AND a.y1 > b.y0 + 0.01::DOUBLE
WHERE a.doc_id = l.doc_id AND a.line_no = l.line_no) THEN 6 ELSE 0 END::BIGINT AS rule FROM r_lines l""")
def a6_line_editability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines get letters of another text, a Hebrew letter for every e, a turned direction or unsafe glyphs."""
    b = R.line_boxes(spark, sf_dir)
    hit = op.box_join(b, b, lambda x, y: op.overlaps(x, y, 0.01) & (F.col("a_line_no") != F.col("b_line_no"))).select("doc_id", F.col("a_line_no").alias("line_no"))
    hebrew = "decode(unhex('D790'), 'utf-8')"
    lines = R.lines(spark, sf_dir).withColumn("text", F.expr(f"if(doc_id % 7 = 3, replace(text, 'e', {hebrew}), text)")).withColumn("semantic", F.expr(f"if(doc_id % 10 = 0, replace(replace(text, {hebrew}, 'x'), 'e', 'x'), text)"))
    flags = {"same_origin": "text like '% -%'", "vertical": "line_no % 17 = 5", "dx": "if(line_no % 19 = 5, 0.9D, 0.6D)", "dy": "0.8D", "unsafe": "line_no % 13 = 7", "boxed": "line_no % 11 <> 7"}
    return op.line_editability(lines.withColumns({k: F.expr(v) for k, v in flags.items()}), hit)


@query("SELECT doc_id, page_no, line_no, row_no FROM r_rows")
def w2_row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.row_bands(items(spark, sf_dir))


@query("""SELECT doc_id, page_no, row_no, line_no, gap FROM (SELECT *, u - lag(end_u) OVER w AS gap, coalesce(line_no % 6 <> 5 AND lag(line_no) OVER w % 6 <> 5 AND lag(end_u - 6.0::DOUBLE) OVER w <= u + 1 AND u > greatest(lag(u) OVER w, lag(end_u - 8.0::DOUBLE) OVER w) AND lag(end_u) OVER w < least(end_u, u + 9.0::DOUBLE), false) AS bearings
FROM r_rows WINDOW w AS (PARTITION BY doc_id, page_no, row_no ORDER BY u, line_no)) WHERE (gap < -0.5 AND NOT bearings) OR gap > 1.5 * size_pt""")
def w3_row_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink begins a point after an item and ends six points before its end; some items have no paint boxes."""
    ink = {"boxed": "line_no % 6 <> 5", "ink0": "u + 1D", "ink1": "end_u - 6D", "first_end": "u + 9D", "last_u": "end_u - 8D"}
    return op.row_gap_check(rows(spark, sf_dir).withColumns({k: F.expr(v) for k, v in ink.items()}))


@query("""WITH a AS (SELECT doc_id, page_no, row_no, min(v) AS v, min(u) AS u, min(end_u) AS e FROM r_rows GROUP BY ALL), b AS (SELECT *, v - lag(v) OVER (PARTITION BY doc_id, page_no ORDER BY row_no) AS gap FROM a),
c AS (SELECT doc_id, page_no, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g, min(u) AS l, max(u) AS f, min(e) AS e FROM b GROUP BY ALL), d AS (SELECT *, CASE WHEN len(g) > 0 THEN g[len(g) // 2 + 1] ELSE 12.0::DOUBLE * 1.35::DOUBLE END AS ld FROM c)
SELECT doc_id, page_no, ld AS "leading", CASE WHEN len(list_filter(g, lambda x: x < 7.8 OR x > 30 OR abs(x - ld) > 4.8)) > 0 THEN 'leading' WHEN f - l > 36 THEN 'indent' WHEN e <= l THEN 'column' END AS reason FROM d""")
def w4_leading_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.leading_check(rows(spark, sf_dir))


@query(r"""WITH a AS (SELECT doc_id, page_no, row_no, min(u) AS u, max(end_u) AS e, arg_min(text, u) AS text FROM r_rows GROUP BY ALL), b AS (SELECT *, lag(u) OVER w AS u0, lag(e) OVER w AS e0 FROM a WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY row_no))
SELECT doc_id, page_no, row_no, CASE WHEN greatest(u, u0) >= least(e, e0) THEN 'column' ELSE 'list' END AS reason FROM b WHERE u0 IS NOT NULL AND (greatest(u, u0) >= least(e, e0) OR regexp_matches(text, '^\s*(?:[•●▪◦]|[-*]\s|\d+[.)]\s)'))""")
def w5_column_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.column_continuity(rows(spark, sf_dir))


@query("""WITH o AS (SELECT *, lag(row_no) OVER w AS r0, lag(end_u) OVER w AS e0 FROM r_rows WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY row_no, u, line_no)),
s AS (SELECT * REPLACE (CASE WHEN line_no % 40 = 2 THEN 'edited ' || line_no ELSE text END AS text) FROM o WHERE line_no % 40 NOT IN (3, 4)), p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page_no ORDER BY row_no, u, line_no) AS t0 FROM s WHERE text <> '')
SELECT doc_id, page_no, string_agg(CASE WHEN (r0 <> row_no OR u - e0 > 1.8) AND NOT regexp_matches(t0, '\\s$') AND NOT regexp_matches(text, '^\\s') THEN ' ' || text ELSE text END, '' ORDER BY row_no, u, line_no) AS text FROM p GROUP BY ALL""")
def w6_group_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit on each page stands for its third to fifth line."""
    r = rows(spark, sf_dir)
    edits = r.where("line_no % 40 = 2").select(*op.PAGE, F.expr("array(line_no + 2, line_no, line_no + 1)").alias("line_nos"), F.expr("concat('edited ', line_no)").alias("content"))
    return op.group_text(r, edits)


@query("""WITH a AS (SELECT doc_id, page_no, row_no, min(u) AS u, max(end_u) AS e, min(v) AS v FROM r_rows GROUP BY ALL), b AS (SELECT *, v - lag(v) OVER (PARTITION BY doc_id, page_no ORDER BY row_no) AS gap FROM a),
g AS (SELECT doc_id, page_no, max(e) - min(u) AS width, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, 12.0::DOUBLE AS size, arg_min(u, row_no) - min(u) AS first_indent, coalesce(min(u) FILTER (row_no > 0), min(u)) - min(u) AS rest_indent, min(u) AS "left", max(e) AS "right", min(v) AS v0, max(v) AS v1 FROM b GROUP BY ALL)
SELECT * EXCLUDE (gaps), CASE WHEN len(gaps) > 0 THEN gaps[len(gaps) // 2 + 1] ELSE size * 1.35::DOUBLE END AS "leading" FROM g""")
def w7_group_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.group_layout(rows(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN ord = 1 THEN 0 ELSE ord // 2 END AS spread, min(ord) AS first, max(ord) AS last FROM r_pages GROUP BY ALL")
def w13_page_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_spreads(R.doc_pages(spark, sf_dir))


@query("SELECT ch, x, count(*) AS n_before, 0::BIGINT AS n_after FROM (SELECT unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS x FROM r_lines WHERE line_no % 7 = 3 AND text <> '') WHERE ch = 'T' GROUP BY ALL")
def u2_unaffected_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by place, before and after every T of each seventh line is lost."""
    c = R.lines(spark, sf_dir).select("line_no", F.posexplode(F.split("text", "")).alias("x", "ch")).where("ch <> ''").withColumn("x", F.col("x").cast("bigint"))
    return op.unaffected_audit(c, c.where("not (line_no % 7 = 3 and ch = 'T')"), ["ch", "x"]).withColumn("lost", F.expr("n_before - n_after")).select("ch", "x", F.col("lost").alias("n_before"), F.expr("0L").alias("n_after"))
