"""Queries over fonts and hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import relations as R
from quire.operators import fonts, trees
from quire.plans.intake import query
from quire.sources.tables import table


@query("SELECT font_id, (weight * 53) & 512 = 0 AND (weight * 53) & 14 <> 2 AS allowed FROM r_fonts")
def p8_embedding_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.font_declarations(spark, sf_dir).select("font_id", fonts.embedding_allowed(F.col("weight") * 53).alias("allowed"))


R.RELATIONS["r_faces"] = """SELECT f.page_no, face, count(*) AS n, count(DISTINCT (weight, style, embedded, program, type3, builtin, legacy)) > 1 OR bool_or(several AND NOT embedded) AS conflict, bool_or(several) AS several, bool_and(embedded) AS emb, bool_and(embedded OR type3 OR builtin) AS has, f.page_no % 9 = 4 AS partial
FROM (SELECT *, regexp_replace(name, '^[A-Z]{6}\\+', '') AS face FROM r_fonts) f JOIN (SELECT page_no, font, count(DISTINCT regexp_replace(name, '^[A-Z]{6}\\+', '')) > 1 AS several FROM r_fonts GROUP BY ALL) s ON f.page_no = s.page_no AND f.font = s.font GROUP BY f.page_no, face"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth page could not be read in full."""
    declared = R.font_declarations(spark, sf_dir)
    return fonts.reconcile_fonts(declared, declared.where("page_no % 9 = 4").select("page_no"))


@query("SELECT page_no, face, n, conflict, several, CASE WHEN conflict OR partial THEN 'unknown' ELSE emb::VARCHAR END AS embedded, has AND NOT conflict AND NOT partial AS usable FROM r_faces")
def a9_reconcile_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir)


R.RELATIONS["r_catalog"] = "SELECT p_brand AS name, 'face-' || p_brand AS face_id, min(p_size)::BIGINT AS weight, bool_or(p_size % 2 = 0 AND p_partkey % 40 = 0) AS italic FROM part WHERE right(p_brand, 1) IN ('1', '3', '5') GROUP BY ALL"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("right(p_brand, 1) in ('1', '3', '5')")
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.min(F.col("p_size").cast("bigint")).alias("weight"), F.bool_or(F.expr("p_size % 2 = 0 and p_partkey % 40 = 0")).alias("italic")).withColumn("face_id", F.concat(F.lit("face-"), "name"))


@query("""SELECT font_id, CASE WHEN NOT bad THEN face_id END AS face_id, bad AND face_id IS NOT NULL AS conflict FROM (SELECT font_id, face_id, coalesce(w <> c.weight, false) OR coalesce(i <> c.italic, false) AS bad FROM
(SELECT font_id, regexp_replace(name, '^[A-Z]{6}\\+', '') AS ps, CASE WHEN font_id % 4 = 0 THEN weight END AS w, CASE WHEN font_id % 3 = 0 THEN weight > 25 END AS i FROM r_fonts) f LEFT JOIN r_catalog c ON f.ps = c.name)""")
def j18_catalog_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.catalog_face(_styled(spark, sf_dir), catalog(spark, sf_dir))


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of which some give a weight, and some a slant."""
    return R.font_declarations(spark, sf_dir).withColumn("italic", F.expr("if(font_id % 3 = 0, weight > 25, null)")).withColumn("weight", F.expr("if(font_id % 4 = 0, weight, null)"))


R.RELATIONS["r_offers"] = """SELECT page_no, ps, face_id IS NOT NULL AND NOT (coalesce(w <> c.weight, false) OR coalesce(i <> c.italic, false)) AS fits FROM
(SELECT page_no, regexp_replace(name, '^[A-Z]{6}\\+', '') AS ps, CASE WHEN font_id % 4 = 0 THEN weight END AS w, CASE WHEN font_id % 3 = 0 THEN weight > 25 END AS i FROM r_fonts) f LEFT JOIN r_catalog c ON f.ps = c.name"""


@query("""WITH d AS (SELECT p_partkey AS font_id, lower(replace(p_name, '-', '')) AS b, CASE p_size % 5 WHEN 0 THEN 'bold' WHEN 1 THEN 'italic' ELSE '' END AS st, CASE WHEN p_size % 3 = 0 THEN 400 END AS w, CASE WHEN p_size % 2 = 0 THEN false END AS it FROM part),
f AS (SELECT p_partkey AS file_id, lower(regexp_replace(p_name, '[\\s_-]', '', 'g')) AS fam, CASE WHEN p_size > 40 THEN 700 ELSE 400 END AS fw, p_size % 7 = 0 AS fi FROM part)
SELECT DISTINCT font_id, file_id FROM (SELECT font_id, regexp_replace(b, '[\\s_-]', '', 'g') AS b, st, w, it FROM d) d JOIN f ON d.b = f.fam WHERE (it IS NULL OR it = fi) AND CASE WHEN st <> '' THEN (st = 'bold') = (fw >= 600) AND (st = 'italic') = fi ELSE fw = coalesce(w, 400) AND fi = coalesce(it, false) END""")
def j17_match_font_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    declared = p.select(F.col("p_partkey").alias("font_id"), F.expr("concat(p_name, case p_size % 5 when 0 then ',Bold' when 1 then ',Italic' else '' end)").alias("name"), F.expr("if(p_size % 3 = 0, 400, null)").alias("weight"), F.expr("if(p_size % 2 = 0, false, null)").alias("italic"))
    files = p.select(F.col("p_partkey").alias("file_id"), F.expr("upper(replace(p_name, ' ', '-'))").alias("family"), F.expr("concat(p_name, ' Full')").alias("full_name"), F.expr("if(p_size > 40, 700, 400)").alias("weight"), F.expr("p_size % 7 = 0").alias("italic"))
    return fonts.match_font_file(declared, files)


R.RELATIONS["r_glyphs"] = "SELECT doc_id % 20 AS font, ascii(ch) AS cp, (ascii(ch) + CASE WHEN line_no % 50 = 49 THEN 1 ELSE 0 END)::BIGINT AS gid FROM (SELECT doc_id, line_no, unnest(string_split(text, '')) AS ch FROM r_lines WHERE text <> '') WHERE ch <> ''"


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.lines(spark, sf_dir).select("doc_id", "line_no", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return c.select(F.expr("doc_id % 20").alias("font"), F.expr("ascii(ch)").alias("cp"), F.expr("bigint(ascii(ch) + if(line_no % 50 = 49, 1, 0))").alias("gid"))


@query("SELECT font, cp, CASE WHEN min(gid) = max(gid) THEN min(gid) ELSE 0 END AS gid FROM r_glyphs GROUP BY ALL")
def a10_glyph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.glyph_coverage(glyphs(spark, sf_dir))


@query("""SELECT DISTINCT u.font, u.cp FROM (SELECT (font + 1) % 20 AS font, cp FROM r_glyphs) u WHERE (u.font, u.cp) NOT IN (SELECT (font, cp) FROM r_glyphs GROUP BY font, cp HAVING min(gid) = max(gid))""")
def j19_missing_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each font is used for the text of its neighbour."""
    g = glyphs(spark, sf_dir)
    return fonts.missing_glyphs(g.withColumn("font", F.expr("(font + 1) % 20")), fonts.glyph_coverage(g))


@query("SELECT page_no, face, CASE WHEN conflict OR partial THEN 'substitute' WHEN (page_no, face) IN (SELECT (page_no, ps) FROM r_offers GROUP BY ALL HAVING bool_and(fits)) AND NOT several THEN 'download' ELSE 'own_file' END AS action FROM r_faces WHERE conflict OR partial OR NOT has")
def t8_font_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.font_action(reconciled(spark, sf_dir), _styled(spark, sf_dir), catalog(spark, sf_dir))


R.RELATIONS["r_up"] = """SELECT node, node AS anc, 0 AS depth FROM r_tree UNION ALL SELECT node, parent, 1 FROM r_tree WHERE parent IS NOT NULL UNION ALL SELECT a.node, b.parent, 2 FROM r_tree a JOIN r_tree b ON a.parent = b.node WHERE b.parent IS NOT NULL
UNION ALL SELECT a.node, c.parent, 3 FROM r_tree a JOIN r_tree b ON a.parent = b.node JOIN r_tree c ON b.parent = c.node WHERE c.parent IS NOT NULL"""


@query("SELECT u.node, arg_min(t.value, depth) FILTER (t.value IS NOT NULL) AS value FROM r_up u JOIN r_tree t ON u.anc = t.node GROUP BY 1")
def h1_inherit_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.inherit_attribute(R.tree(spark, sf_dir))


@query("""SELECT d.doc_id, d.page_no, NOT (d.doc_id % 17 = 0) AND NOT coalesce(s.sig, false) AS may_copy, coalesce(bool_or(s.sig) OVER (PARTITION BY d.doc_id), false) AS doc_signed FROM (SELECT o_custkey AS doc_id, o_orderkey % 4 AS page_no FROM orders GROUP BY ALL) d
LEFT JOIN (SELECT o_custkey AS doc_id, o_orderkey % 4 AS page_no, bool_or(o_orderkey % 7 = 0) AS sig FROM orders GROUP BY ALL) s ON d.doc_id = s.doc_id AND d.page_no = s.page_no""")
def h2_duplicate_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are widgets on their customer's pages; every seventh is a signature of its own, the rest inherit another type."""
    o = table(spark, sf_dir, "orders")
    fields = R.tree(spark, sf_dir).withColumn("value", F.expr("case when left(node, 1) = 'o' and value is not null then 'Sig' when left(node, 1) = 'o' then null when value is null then null else 'Tx' end"))
    widgets = o.select(F.col("o_custkey").alias("doc_id"), F.expr("o_orderkey % 4").alias("page_no"), F.expr("concat('o', o_orderkey)").alias("node"))
    docs = o.select(F.col("o_custkey").alias("doc_id")).distinct().withColumn("xfa", F.expr("doc_id % 17 = 0"))
    return trees.duplicate_capability(widgets.select("doc_id", "page_no").distinct(), widgets, fields, docs)


R.RELATIONS["r_alias"] = "SELECT 'a' || c_custkey AS name, CASE WHEN c_custkey % 8 = 0 THEN 't' || c_custkey WHEN c_custkey % 8 = 4 THEN 'a' || (c_custkey + 3) WHEN c_custkey % 8 = 7 THEN CASE WHEN c_custkey % 16 = 7 THEN 'a' || (c_custkey - 3) ELSE 'x' || c_custkey END ELSE 'a' || (c_custkey - 1) END AS dest FROM customer"


def _aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains of up to four names; some end at a target, some in a cycle, some nowhere."""
    c = table(spark, sf_dir, "customer")
    to = "case when c_custkey % 8 = 0 then concat('t', c_custkey) when c_custkey % 8 = 4 then concat('a', c_custkey + 3) when c_custkey % 8 = 7 then if(c_custkey % 16 = 7, concat('a', c_custkey - 3), concat('x', c_custkey)) else concat('a', c_custkey - 1) end"
    targets = c.where("c_custkey % 8 = 0").select(F.expr("concat('t', c_custkey)").alias("name"), F.expr("concat('page', c_custkey % 100)").alias("target"))
    return c.select(F.expr("concat('a', c_custkey)").alias("name"), F.expr(to).alias("to")), targets


R.RELATIONS["r_resolved"] = """SELECT 'a' || k AS name, CASE WHEN m IN (0, 1, 2, 3) THEN CASE WHEN k - m IN (SELECT c_custkey FROM customer) THEN 'page' || ((k - m) % 100) ELSE 'a' || (k - 1) END ELSE (SELECT dest FROM r_alias a WHERE a.name = 'a' || k) END AS target,
CASE WHEN m IN (0, 1, 2, 3) THEN CASE WHEN k - m IN (SELECT c_custkey FROM customer) THEN 'ok' ELSE 'missing' END WHEN (k - m + 7) % 16 = 7 AND k - m + 7 IN (SELECT c_custkey FROM customer) THEN 'cycle' ELSE 'missing' END AS status FROM (SELECT c_custkey AS k, c_custkey % 8 AS m FROM customer)"""


@query("SELECT * FROM r_resolved")
def h3_resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.resolve_aliases(*_aliases(spark, sf_dir))


R.RELATIONS["r_stay"] = """WITH dead AS (SELECT DISTINCT u.node FROM r_up u JOIN r_tree t ON u.anc = t.node WHERE t.gone), leaf AS (SELECT node FROM r_tree WHERE node NOT IN (SELECT parent FROM r_tree WHERE parent IS NOT NULL) AND node NOT IN (SELECT node FROM dead))
SELECT DISTINCT anc AS node FROM r_up WHERE node IN (SELECT node FROM leaf)"""


@query("SELECT node FROM r_stay")
def h4_prune_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.prune_tree(R.tree(spark, sf_dir)).select("node")


@query("SELECT parent AS list_id, row_number() OVER (PARTITION BY parent ORDER BY node) - 1 AS ord, node FROM r_tree WHERE parent IS NOT NULL AND node IN (SELECT node FROM r_stay)")
def h4_prune_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's children in order of their names are a list of references."""
    tree = R.tree(spark, sf_dir)
    lists = tree.where("parent is not null").select(F.col("parent").alias("list_id"), "node").withColumn("ord", F.row_number().over(Window.partitionBy("list_id").orderBy("node")))
    return trees.prune_references(lists, trees.prune_tree(tree))


@query("""SELECT o_orderkey AS ref_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'page' || (o_orderkey % 100) END, r.target) AS page FROM orders o LEFT JOIN (SELECT * FROM r_resolved WHERE status = 'ok') r ON r.name = 'a' || o_custkey
WHERE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'page' || (o_orderkey % 100) END, r.target) IN (SELECT 'page' || p FROM range(0, 100, 3) x(p))""")
def h5_drop_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.expr("if(o_orderkey % 2 = 0, concat('page', o_orderkey % 100), null)").alias("page"), F.expr("concat('a', o_custkey)").alias("name"))
    kept = table(spark, sf_dir, "orders").select(F.expr("o_orderkey % 100").alias("p")).distinct().where("p % 3 = 0").select(F.expr("concat('page', p)").alias("page"))
    return trees.drop_dangling(refs, kept, *_aliases(spark, sf_dir))


@query("""SELECT name FROM r_resolved WHERE status <> 'ok' OR target IN (SELECT 'page' || p FROM range(0, 100, 3) x(p)) UNION ALL SELECT 't' || c_custkey FROM customer WHERE c_custkey % 8 = 0 AND c_custkey % 100 % 3 = 0""")
def h5_kept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.range(0, 100, 3).select(F.expr("concat('page', id)").alias("page"))
    return trees.kept_names(kept, *_aliases(spark, sf_dir))


@query("""SELECT 'o' || o_orderkey AS node, unnest(['reached twice', 'parent pointer']) AS violation FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'c' || c_custkey, unnest(['cycle', 'parent pointer']) FROM customer WHERE c_custkey % 40 = 1 UNION ALL SELECT 'k' || c_custkey, 'cycle' FROM customer WHERE c_custkey % 40 = 1
UNION ALL SELECT 'o' || o_orderkey, 'on two pages' FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'o' || o_orderkey, 'on removed page' FROM orders WHERE o_orderkey % 6 = 5 OR (o_orderkey % 13 = 0 AND o_orderkey % 6 = 4)
UNION ALL SELECT 's' || s_suppkey, 'not in tree' FROM supplier""")
def h6_tree_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with second parents, cycles of a customer and a node of its own, and suppliers as stray widgets."""
    tree = R.tree(spark, sf_dir).select("node", "parent")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    looped = customers.where("c_custkey % 40 = 1").select(F.expr("concat('c', c_custkey)").alias("node"), F.expr("concat('k', c_custkey)").alias("parent"))
    edges = tree.where("parent is not null").join(looped.select("node"), "node", "left_anti").unionByName(looped)
    edges = edges.union(looped.select("parent", "node")).union(orders.where("o_orderkey % 11 = 0").selectExpr("concat('o', o_orderkey)", "concat('n', o_orderkey % 25)"))
    widgets = orders.select(F.expr("concat('o', o_orderkey)").alias("node"), F.explode(F.expr("if(o_orderkey % 13 = 0, array(o_orderkey % 6, o_orderkey % 6 + 1), array(o_orderkey % 6))")).alias("page"))
    widgets = widgets.union(table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey)", "1L"))
    return trees.tree_consistency(edges, tree, widgets, widgets.select("page").distinct().where("page < 5"))


@query("""WITH ins AS (SELECT DISTINCT u.node FROM r_up u WHERE u.anc LIKE 'n%' AND substring(u.anc, 2)::INT % 5 = 0), ids AS (SELECT node, 'copy-' || substring(sha256('copy/' || node), 1, 16) AS new FROM ins)
SELECT node, parent, value AS name FROM r_tree UNION ALL SELECT i.new, coalesce(p.new, t.parent), CASE WHEN t.node LIKE 'n%' THEN 'copy_' || t.value ELSE t.value END FROM r_tree t JOIN ids i ON t.node = i.node LEFT JOIN ids p ON t.parent = p.node""")
def h7_clone_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = R.tree(spark, sf_dir).withColumnRenamed("value", "name")
    roots = tree.where("left(node, 1) = 'n' and int(substring(node, 2)) % 5 = 0").select("node")
    return trees.clone_subtree(tree, roots, "copy").select("node", "parent", "name")
