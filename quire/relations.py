"""Relations that the queries run on, derived from the given tables, and the same derivations as SQL.

Spark side: functions (spark, sf_dir) -> DataFrame. SQL side: RELATIONS, one DuckDB SELECT for each name;
with_relations() puts those that a query needs before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.tables import table

#: Main content types of packages, and the names of their parts.
WORD_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
PRESENTATION_MAIN = "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"
RELATIONS: dict[str, str] = {}


def with_relations(sql: str) -> str:
    """sql with a WITH clause for every relation that it names, directly or through another."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(RELATIONS[name].replace(name, "") if name in RELATIONS[name] else RELATIONS[name])
                needed.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in needed)
    if sql.lstrip().startswith("WITH ") and needed:
        return f"WITH {head}, " + sql.lstrip()[len("WITH ") :]
    return (f"WITH {head} " if needed else "") + sql


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("bigint"))


RELATIONS["r_lines"] = "SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"


def geo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines laid out on pages of 40 rows, 18 points apart."""
    at = lines(spark, sf_dir).withColumn("page_no", F.expr("line_no div 40")).withColumn("v", F.expr("60D + 18D * (line_no % 40)"))
    return at.withColumn("u", F.expr("40D + 12D * ((7 * line_no + doc_id) % 3)")).withColumn("end_u", F.expr("u + 0.05D * length(text)")).withColumn("size_pt", F.lit(12.0))


RELATIONS["r_geo"] = """SELECT *, u + 0.05::DOUBLE * length(text) AS end_u, 12.0::DOUBLE AS size_pt FROM (
SELECT doc_id, line_no, text, line_no // 40 AS page_no, 60.0::DOUBLE + 18.0::DOUBLE * (line_no % 40) AS v, 40.0::DOUBLE + 12.0::DOUBLE * ((7 * line_no + doc_id) % 3) AS u FROM r_lines)"""


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo_lines(spark, sf_dir)
    return g.select("doc_id", "page_no", "line_no", F.col("u").alias("x0"), (F.col("v") - 9).alias("y0"), F.col("end_u").alias("x1"), F.expr("v + if(line_no % 10 = 3, 13D, 3D)").alias("y1"))


RELATIONS["r_boxes"] = "SELECT doc_id, page_no, line_no, u AS x0, v - 9 AS y0, end_u AS x1, v + CASE WHEN line_no % 10 = 3 THEN 13.0::DOUBLE ELSE 3.0::DOUBLE END AS y1 FROM r_geo"


def line_runs(spark: SparkSession, sf_dir: str, source=lines) -> DataFrame:
    """The runs of words() as an array in their line's row."""
    run = lambda word, n: F.struct(n.cast("bigint").alias("run_no"), F.concat(word, F.lit(" ")).alias("text"), (F.length(word) >= 8).alias("bold"))
    return source(spark, sf_dir).select("doc_id", "line_no", F.transform(F.split("text", " ", -1), run).alias("runs"))


def words(spark: SparkSession, sf_dir: str, source=lines) -> DataFrame:
    """Runs of each line: its words with the space that follows, bold when 8 characters or longer."""
    w = source(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("text", " ", -1)).alias("run_no", "text"))
    order = Window.partitionBy("doc_id", "line_no").orderBy("run_no")
    w = w.withColumn("run_no", F.col("run_no").cast("bigint")).withColumn("bold", F.length("text") >= 8).withColumn("text", F.concat("text", F.lit(" ")))
    return w.withColumn("stop", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("stop") - F.length("text"))


def _words_sql(lines: str) -> str:
    return f"""SELECT *, stop - length(text) AS begin FROM (SELECT doc_id, line_no, run_no, bold, text,
CAST(sum(length(text)) OVER (PARTITION BY doc_id, line_no ORDER BY run_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
FROM (SELECT doc_id, line_no, run_no, length(w) >= 8 AS bold, w || ' ' AS text FROM
(SELECT doc_id, line_no, unnest(range(len(a))) AS run_no, unnest(a) AS w FROM (SELECT doc_id, line_no, string_split(text, ' ') AS a FROM {lines}))))"""


RELATIONS["r_words"] = _words_sql("r_lines")


def marked(text: str = "text") -> str:
    """SQL of either engine for a text with decomposed letters, CRLF, CR and tabs, by document."""
    text = f"CASE WHEN doc_id % 2 = 0 THEN replace({text}, 'e', concat('e', chr(769))) ELSE {text} END"
    text = f"CASE WHEN doc_id % 3 = 0 THEN replace({text}, ',', concat(chr(13), chr(10))) WHEN doc_id % 3 = 1 THEN replace({text}, ',', chr(13)) ELSE {text} END"
    return f"CASE WHEN doc_id % 5 = 0 THEN replace({text}, '.', chr(9)) ELSE {text} END"


def _spark_marked() -> str:
    return marked().replace("chr(769)", "decode(unhex('CC81'), 'utf-8')")  # chr() of Spark stops at 255


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_spark_marked()).alias("text"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", F.expr(_spark_marked()).alias("text"))


RELATIONS["r_marked_docs"] = f"SELECT doc_id, {marked()} AS text FROM documents"
RELATIONS["r_marked"] = f"SELECT doc_id, line_no, {marked()} AS text FROM r_lines"
RELATIONS["r_marked_words"] = _words_sql("r_marked")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id % 20").alias("page_no"), F.expr("round(50D + 10D * double(embedding[0]), 2)").alias("x"), F.expr("round(50D + 10D * double(embedding[1]), 2)").alias("y"))


RELATIONS["r_points"] = "SELECT vec_id, vec_id % 20 AS page_no, round(50.0::DOUBLE + 10.0::DOUBLE * embedding[1]::DOUBLE, 2) AS x, round(50.0::DOUBLE + 10.0::DOUBLE * embedding[2]::DOUBLE, 2) AS y FROM embeddings"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "concat(element_at(split(url, '/'), -1), element_at(array('.pdf', '.docx', '.hwp', '.PDF', '.pptx', '', '.Pdf', '.DocX', '.doc'), int(page_id % 9) + 1))"
    content = "case page_id % 5 when 0 then concat(encode('%PDF-', 'utf-8'), encode(html, 'utf-8')) when 1 then concat(encode('PK', 'utf-8'), encode(html, 'utf-8')) when 2 then concat(X'D0CF11E0A1B11AE1', encode(html, 'utf-8')) when 3 then encode(html, 'utf-8') else X'' end"
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("upload_id"), F.expr(name).alias("file_name"), F.expr(content).alias("content"))


RELATIONS["r_uploads"] = r"""SELECT page_id AS upload_id, string_split(url, '/')[-1] || ['.pdf', '.docx', '.hwp', '.PDF', '.pptx', '', '.Pdf', '.DocX', '.doc'][page_id % 9 + 1] AS file_name,
CASE page_id % 5 WHEN 0 THEN encode('%PDF-') || encode(html) WHEN 1 THEN encode('PK') || encode(html) WHEN 2 THEN '\xD0\xCF\x11\xE0\xA1\xB1\x1A\xE1'::BLOB || encode(html) WHEN 3 THEN encode(html) ELSE ''::BLOB END AS content FROM pages"""

#: Part names of packages.
PART_NAMES = ("word/document.xml", "ppt/presentation.xml", "Contents/content.hpf", "Contents/section0.xml", "docProps/app.xml", "media/a.png", "media/b.png")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts for each package, in a row; some empty, some names in other case, some overlapping."""
    names = ", ".join(f"'{n}'" for n in PART_NAMES)
    p = table(spark, sf_dir, "part").select(F.expr("(p_partkey - 1) div 5").alias("package"), F.expr("(p_partkey - 1) % 5").alias("part_no"), "p_size", F.expr(f"element_at(array({names}), int((p_partkey * 7 + p_size) % 7) + 1)").alias("n"))
    order = Window.partitionBy("package").orderBy("part_no")
    p = p.withColumn("name", F.expr("if(p_size % 13 = 0, upper(n), n)")).withColumn("size", F.expr("bigint(if(p_size % 4 = 0, 0, p_size))"))
    p = p.withColumn("stop_off", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return p.select("package", "part_no", F.col("name").alias("part_name"), "size", F.expr("stop_off - size - if(p_size % 17 = 0, 1, 0)").alias("start_off"), "stop_off", F.col("p_size").cast("bigint").alias("p_size"))


RELATIONS["r_parts"] = f"""SELECT package, part_no, name AS part_name, size, stop_off - size - CASE WHEN p_size % 17 = 0 THEN 1 ELSE 0 END AS start_off, stop_off, p_size FROM (
SELECT *, CAST(sum(size) OVER (PARTITION BY package ORDER BY part_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop_off FROM (
SELECT package, part_no, p_size, CASE WHEN p_size % 13 = 0 THEN upper(n) ELSE n END AS name, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS BIGINT) AS size FROM (
SELECT (p_partkey - 1) // 5 AS package, (p_partkey - 1) % 5 AS part_no, p_size::BIGINT AS p_size, {list(PART_NAMES)}[(p_partkey * 7 + p_size) % 7 + 1] AS n FROM part)))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = f"case when p_size % 19 = 0 then 'application/vnd.ms-word.document.macroEnabled.main+xml' when lower(part_name) = 'word/document.xml' then '{WORD_MAIN}' when lower(part_name) = 'ppt/presentation.xml' then '{PRESENTATION_MAIN}' else 'application/xml' end"
    return parts(spark, sf_dir).select("package", F.expr("if(p_size % 11 = 0, 'Default', 'Override')").alias("kind"), F.concat(F.lit("/"), "part_name").alias("part"), F.expr(kind).alias("content_type"))


RELATIONS["r_manifest"] = f"""SELECT package, CASE WHEN p_size % 11 = 0 THEN 'Default' ELSE 'Override' END AS kind, '/' || part_name AS part,
CASE WHEN p_size % 19 = 0 THEN 'application/vnd.ms-word.document.macroEnabled.main+xml' WHEN lower(part_name) = 'word/document.xml' THEN '{WORD_MAIN}' WHEN lower(part_name) = 'ppt/presentation.xml' THEN '{PRESENTATION_MAIN}' ELSE 'application/xml' END AS content_type FROM r_parts"""

#: Records from orders, for both engines: {day} is the day number of the order.
_RECORD = {
    "format": "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'docx' WHEN '2' THEN 'hwp' WHEN '3' THEN 'hwpx' WHEN '4' THEN 'pptx' ELSE 'pdf' END",
    "sequence": "{day} + 1", "revision": "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 0 THEN 0 ELSE {day} % 50 END", "modified": "o_orderstatus <> 'O'", "saved_at": "{day}", "file_name": "concat('doc-', CAST(o_custkey AS {text}), '.bin')",
    "source_name": "concat('src-', CAST(o_custkey % 97 AS {text}), CASE WHEN o_orderkey % 31 = 0 THEN '-x' ELSE '' END)", "version": "CASE WHEN o_orderkey % 41 = 0 THEN 2 WHEN o_orderkey % 47 = 0 THEN 0 ELSE 1 END",
    "zoom": "CASE WHEN o_orderkey % 43 = 0 THEN {zero} ELSE {one} END", "custkey": "o_custkey", "layout": "1 + o_orderkey % 2", "consent": "o_orderkey % 3 <> 0",
}
_MORE = {
    "engine_id": "concat(format, CASE WHEN id % 53 = 0 THEN '-other' ELSE '-engine' END)", "engine_version": "'1'", "checkpoint_kind": "CASE WHEN id % 29 = 0 THEN NULL WHEN id % 37 = 5 THEN 'odd' WHEN format = 'pptx' THEN 'slides' ELSE 'native' END",
    "checkpoint_format": "CASE WHEN id % 58 = 29 THEN NULL WHEN id % 59 = 0 THEN 'doc' ELSE format END", "asset_ids": "CASE WHEN id % 7 = 0 THEN {array}'a', 'b', 'a'{end} ELSE {array}'a', 'b'{end} END", "slide_ids": "CASE WHEN id % 11 = 0 THEN {array}'s', 's'{end} ELSE {array}'s'{end} END",
}
_SPARK = {"day": "bigint(datediff(date(o_orderdate), date'1970-01-01'))", "text": "string", "zero": "0D", "one": "1D", "array": "array(", "end": ")"}
_DUCK = {"day": "date_diff('day', DATE '1970-01-01', o_orderdate::DATE)", "text": "VARCHAR", "zero": "0.0::DOUBLE", "one": "1.0::DOUBLE", "array": "[", "end": "]"}


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a stored record."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[F.expr(v.format(**_SPARK)).alias(k) for k, v in _RECORD.items()])
    rows = rows.withColumns({k: F.col(k).cast("bigint") for k in ("sequence", "revision", "version", "layout")}).withColumn("source_hash", F.expr("sha2(concat('s', id, if(id % 61 = 0, 'x', '')), 256)"))
    return rows.withColumns({k: F.expr(v.format(**_SPARK)) for k, v in _MORE.items()})


RELATIONS["r_store"] = "SELECT *, " + ", ".join(f"{v.format(**_DUCK)} AS {k}" for k, v in _MORE.items()) + " FROM (SELECT o_orderkey AS id, " + ", ".join(
    f"CAST({v.format(**_DUCK)} AS BIGINT) AS {k}" if k in ("sequence", "revision", "version", "layout") else f"{v.format(**_DUCK)} AS {k}" for k, v in _RECORD.items()) + ", sha256('s' || o_orderkey || CASE WHEN o_orderkey % 61 = 0 THEN 'x' ELSE '' END) AS source_hash FROM orders)"

#: How an incoming record differs from the stored one of its id; every tenth has an id of its own.
_CHANGED = {"id": "CASE WHEN id % 10 = 3 THEN id + 1000000000 ELSE id END", "sequence": "sequence + id % 3 - 1", "revision": "revision + CASE WHEN id % 5 = 0 THEN -1 ELSE 1 END", "modified": "modified AND id % 7 <> 0", "zoom": "CASE WHEN id % 4 = 0 THEN zoom ELSE zoom * 2 END",
            "source_name": "CASE WHEN id % 13 = 0 THEN 'moved' ELSE source_name END", "saved_at": "saved_at + 1", "file_name": "file_name"}


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).select("*", *[F.expr(v).alias(f"new_{k}") for k, v in _CHANGED.items()]).drop(*_CHANGED).withColumnsRenamed({f"new_{k}": k for k in _CHANGED})


RELATIONS["r_incoming"] = "SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in _CHANGED.items()) + ") FROM r_store"


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages of a document."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    p = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order).cast("bigint"))
    return p.select(F.col("l_orderkey").alias("doc_id"), "ord", F.expr("if(l_returnflag = 'R' and l_partkey % 5 = 0, 'blank', 'pdf')").alias("kind"), F.expr("bigint(l_linenumber) - 1").alias("source_page"), F.expr("l_suppkey % 7 <> 0").alias("original"), F.expr("90 * (l_partkey % 4)").alias("rotation"))


RELATIONS["r_pages"] = """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN 'blank' ELSE 'pdf' END AS kind, l_linenumber::BIGINT - 1 AS source_page, l_suppkey % 7 <> 0 AS original, 90 * (l_partkey % 4) AS rotation FROM lineitem"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as an edit log: (doc, seq, ts, type, k)."""
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    kind = "case event_type when 'view' then 'rotate' when 'signup' then 'add' when 'purchase' then 'duplicate' when 'click' then 'activate' else 'undo' end"
    return e.select(F.col("user_id").alias("doc"), "seq", "event_id", "ts", F.expr(kind).alias("type"), F.expr("bigint(get_json_object(props, '$.k'))").alias("k"), "value")


RELATIONS["r_actions"] = """SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts,
CASE event_type WHEN 'view' THEN 'rotate' WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'duplicate' WHEN 'click' THEN 'activate' ELSE 'undo' END AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events"""


#: Three lines in seven belong to one mapping, the others have one each; both engines.
_FIRST = "line_no - CASE WHEN line_no % 40 % 7 IN (1, 2) THEN line_no % 40 % 7 ELSE 0 END"
ROLES = ("title", "author", "date", "body", "note", "amount", "name", "address", "phone")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field mappings over all text lines, by page; locked where the document is toxic."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    m = lines(spark, sf_dir).withColumn("page_no", F.expr("line_no div 40")).withColumn("first", F.expr(_FIRST))
    m = m.groupBy("doc_id", "page_no", "first").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("own")).join(marks, "doc_id", "left")
    role = f"if(coalesce(toxic, 0) = 1, 'locked', element_at(array({', '.join(map(repr, ROLES))}), int(first % 9) + 1))"
    m = m.withColumn("original_text", F.array_join("own.text", "\n"))
    return m.select("doc_id", "page_no", F.col("first").alias("line_no"), F.col("own.line_no").alias("line_nos"), F.expr("concat(doc_id, ':', first)").alias("mapping_id"), F.expr(role).alias("role"), F.expr("coalesce(quality, 0) = 1").alias("reviewed"), "original_text", F.expr("concat(original_text, if(doc_id % 11 = 0, '!', ''))").alias("stored_text"))


RELATIONS["r_mappings"] = f"""SELECT l.doc_id, page_no, first AS line_no, line_nos, l.doc_id || ':' || first AS mapping_id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'locked' ELSE {list(ROLES)}[first % 9 + 1] END AS role,
coalesce(quality, 0) = 1 AS reviewed, t AS original_text, t || CASE WHEN l.doc_id % 11 = 0 THEN '!' ELSE '' END AS stored_text
FROM (SELECT doc_id, line_no // 40 AS page_no, {_FIRST} AS first, list(line_no ORDER BY line_no) AS line_nos, string_agg(text, chr(10) ORDER BY line_no) AS t FROM r_lines GROUP BY ALL) l LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) b ON l.doc_id = b.doc_id"""


def font_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations; every tenth font has two of them, with names of their own."""
    p = table(spark, sf_dir, "part").withColumn("font", F.expr("if(p_partkey % 10 = 1, p_partkey - 1, p_partkey)"))
    return p.select(
        F.expr("font % 50").alias("page_no"), "font", F.expr("concat(if(p_partkey % 2 = 1, 'ABCDEF+', ''), p_brand)").alias("name"), F.expr("bigint(p_size)").alias("weight"), F.expr("p_type").alias("style"), F.expr("p_partkey % 3 <> 0").alias("embedded"),
        F.expr("concat('g', p_size)").alias("program"), F.expr("p_size % 23 = 0").alias("type3"), F.expr("p_size % 29 = 0").alias("builtin"), F.expr("if(p_size % 31 = 0, p_name, null)").alias("legacy"), F.col("p_partkey").alias("font_id"))


RELATIONS["r_fonts"] = """SELECT *, font % 50 AS page_no FROM (SELECT CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END AS font, CASE WHEN p_partkey % 2 = 1 THEN 'ABCDEF+' ELSE '' END || p_brand AS name, p_size::BIGINT AS weight, p_type AS style, p_partkey % 3 <> 0 AS embedded,
'g' || p_size AS program, p_size % 23 = 0 AS type3, p_size % 29 = 0 AS builtin, CASE WHEN p_size % 31 = 0 THEN p_name END AS legacy, p_partkey AS font_id FROM part)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, value): regions over nations over customers over orders."""
    t = lambda name: table(spark, sf_dir, name)
    rows = [
        t("region").select(F.expr("concat('r', r_regionkey)").alias("node"), F.lit(None).cast("string").alias("parent"), F.expr("concat('R', r_regionkey)").alias("value"), F.lit(False).alias("gone")),
        t("nation").select(F.expr("concat('n', n_nationkey)"), F.expr("concat('r', n_regionkey)"), F.expr("if(n_nationkey % 3 = 0, concat('N', n_nationkey), null)"), F.lit(False)),
        t("customer").select(F.expr("concat('c', c_custkey)"), F.expr("concat('n', c_nationkey)"), F.expr("if(c_custkey % 5 = 0, concat('C', c_custkey), null)"), F.lit(False)),
        t("orders").select(F.expr("concat('o', o_orderkey)"), F.expr("concat('c', o_custkey)"), F.expr("if(o_orderkey % 7 = 0, concat('O', o_orderkey), null)"), F.expr("o_orderstatus in ('F', 'O')")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


RELATIONS["r_tree"] = """SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent, 'R' || r_regionkey AS value, false AS gone FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'N' || n_nationkey END, false FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'C' || c_custkey END, false FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'O' || o_orderkey END, o_orderstatus IN ('F', 'O') FROM orders"""


#: Kinds of actions in a full edit log, dealt by event and its number.
KINDS = ("rotate", "add", "duplicate", "delete", "reorder", "activate", "undo", "redo", "edit", "remove", "region", "region", "field", "rename", "undo", "edit", "field", "edit", "rotate", "restore")
_MAPPING = "named_struct('id', concat('m', {j}), 'role', if({j} = 3, 'locked', 'title'), 'page_id', concat('p', {j} % 3), 'source_page', bigint({j} % 3), 'line_ids', {lines}, 'text', '')"
_MAPPED = "if({j} = 4, array('l3', 'l4'), array(concat('l', {j})))"
#: What an action of a kind says; j = k % 5.
_PAYLOAD = {
    "page_id": "case when type = 'field' then concat('p', j % 3) when type not in ('undo', 'redo', 'region', 'rename', 'add', 'load', 'restore') then element_at(array('p0', 'p1', 'p2', 'p3', 'n0', 'n1', 'x'), int((k + seq) % 7) + 1) end",
    "target_id": "case when type in ('add', 'duplicate') then concat('n', (k + seq) % 6) when type = 'reorder' then element_at(array('p0', 'p1', 'p2', 'n0', 'n2'), int((k * 3 + seq) % 5) + 1) end",
    "delta": "case when type = 'rotate' then double(element_at(array(90, 180, 270, -90, 45, 0, 450, -45), int(k % 8) + 1)) end",
    "line_ids": f"case when type = 'field' then {_MAPPED.format(j='j')} when type = 'remove' then array(concat('l', j)) when type <> 'edit' then null when k % 13 = 0 then cast(array() as array<string>) when k % 17 = 0 then array('l1', 'l1') when k % 19 = 0 then array('') else transform(sequence(j, j + k % 3), i -> concat('l', i)) end",
    "value": "case when type in ('edit', 'field') then concat('text ', k % 4) when type in ('rename', 'load', 'restore') then concat('name ', k) end",
    "mapping_id": "if(type = 'field', concat('m', j), null)", "revision": "case when type = 'restore' then k % 23 when type = 'field' and k % 9 = 0 then seq end",
    "pages": "if(type in ('load', 'restore'), transform(sequence(0L, 2 + k % 2), i -> named_struct('id', concat('p', i), 'kind', if(i = 3, 'blank', 'pdf'), 'source_page', i, 'original', true, 'rotation', 0L)), null)",
    "region": f"if(type = 'region', named_struct('reviewed', k % 3 > 0, 'mappings', transform(sequence(j, j + 2), i -> {_MAPPING.format(j='(i % 5)', lines=_MAPPED.format(j='(i % 5)'))}), 'selected', array(concat('m', j))), null)",
}


def full_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a typed edit log: first a load, then actions of every kind, some of pages, lines and
    revisions that are not there; now and then a document is loaded anew."""
    a = actions(spark, sf_dir)
    kind = f"if(event_id % 97 = 0, 'load', element_at(array({', '.join(map(repr, KINDS))}), int((event_id * 7 + k * 3 + seq) % {len(KINDS)}) + 1))"
    rows = a.select("doc", "seq", F.expr(kind).alias("type"), "k")
    rows = rows.unionByName(a.select("doc").distinct().select("doc", F.lit(0).cast("bigint").alias("seq"), F.lit("load").alias("type"), F.lit(0).cast("bigint").alias("k")))
    rows = rows.withColumn("j", F.expr("k % 5"))
    return rows.select("doc", "seq", "type", *[F.expr(v).alias(c) for c, v in _PAYLOAD.items()])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.expr("(event_id * 7919) % 10007").alias("request_id"), F.expr("bigint(get_json_object(props, '$.k'))").alias("page"), F.expr("event_id % 5").alias("revision"), F.col("event_type").alias("method"), "ts", "event_id")


RELATIONS["r_requests"] = "SELECT user_id AS session, (event_id * 7919) % 10007 AS request_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, event_id % 5 AS revision, event_type AS method, ts, event_id FROM events"


_PHASE = "CASE method WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'error' THEN 'done' ELSE 'progress' END"


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the requests of a session: each has several events, the first of which need not be its start."""
    return requests(spark, sf_dir).select("session", F.expr("page % 4").alias("request"), "event_id", "ts", F.expr(_PHASE).alias("phase"))


RELATIONS["r_request_events"] = f"SELECT session, page % 4 AS request, event_id, ts, {_PHASE} AS phase FROM r_requests"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


RELATIONS["r_versions"] = "SELECT conv_id, turn, text FROM conversations"


def asset_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("case l_linenumber % 7 when 0 then concat('blob:', l_partkey) when 1 then concat('note ', l_partkey) else concat('asset:', l_partkey) end").alias("ref"))


RELATIONS["r_refs"] = "SELECT l_orderkey AS doc_id, CASE l_linenumber % 7 WHEN 0 THEN 'blob:' || l_partkey WHEN 1 THEN 'note ' || l_partkey ELSE 'asset:' || l_partkey END AS ref FROM lineitem"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 45").select(F.expr("string(p_partkey)").alias("asset_id"), F.sha2("p_name", 256).alias("hash"), "p_partkey")


RELATIONS["r_assets"] = "SELECT p_partkey::VARCHAR AS asset_id, sha256(p_name) AS hash, p_partkey FROM part WHERE p_size <= 45"
