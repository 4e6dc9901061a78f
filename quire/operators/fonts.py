"""Fonts: reconciling declarations, matching files and catalogue faces, glyph coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scratch import Scratch
from quire.operators.spans import in_nfc


def embedding_allowed(fs_type: Column) -> Column:
    """Embedding bits allow outlines: not bitmap only, and not restricted alone."""
    return (fs_type.bitwiseAND(F.lit(0x0200)) == 0) & (fs_type.bitwiseAND(F.lit(0x000E)) != 2)


def postscript_name(name: Column) -> Column:
    """The name without a subset prefix."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def with_font_key(rows: DataFrame, column: str) -> DataFrame:
    """Rows with the name in column in NFC, lower case, without white space, underscores and hyphens."""
    return rows.withColumn(column, F.regexp_replace(F.lower(in_nfc(F.col(column))), r"[\s_\-]", ""))


#: What declarations of one name must agree in.
DECLARED = ("embedded", "program", "type3", "builtin", "weight", "style", "legacy")


def reconcile_fonts(declared: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(page_no, face, n, conflict, several, embedded, usable): declarations of a page by normalised name.

    declared (page_no, font, name, and the columns DECLARED, which may be null), incomplete (page_no): pages
    whose fonts could not all be read. A name is in conflict if its declarations differ in any column, a
    missing value differing from a known one, or if a font that isn't embedded has several names. On an
    incomplete page, and in conflict, embedded is `unknown` and nothing is usable; else a face is usable if it
    is embedded, type 3 or built in. several: some font of that name has other names too, so no catalogue
    face is offered for it.
    """
    rows = declared.withColumn("face", postscript_name(F.col("name")))
    names = rows.groupBy("page_no", "font").agg((F.count_distinct("face") > 1).alias("several"))
    g = rows.join(names, ["page_no", "font"]).groupBy("page_no", "face").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(*DECLARED)).alias("kinds"), F.bool_or("several").alias("several"),
        F.bool_or(F.col("several") & ~F.col("embedded")).alias("loose"), F.bool_and("embedded").alias("embedded"), F.bool_and(F.col("embedded") | F.col("type3") | F.col("builtin")).alias("has"))
    g = g.withColumn("conflict", (F.col("kinds") > 1) | F.col("loose")).join(incomplete.select("page_no", F.lit(True).alias("partial")).distinct(), "page_no", "left")
    unknown = F.col("conflict") | F.col("partial").isNotNull()
    return g.select("page_no", "face", "n", "conflict", "several", F.when(unknown, "unknown").otherwise(F.col("embedded").cast("string")).alias("embedded"), (F.col("has") & ~unknown).alias("usable"))


def catalog_face(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(font_id, face_id, conflict): catalogue face by exact PostScript name; not offered (null) where the
    declared weight or slant is known and differs. catalog: (face_id, name, weight, italic); the catalogue is a
    small dimension, but Spark decides by its size whether it is broadcast."""
    c = catalog.select("face_id", F.col("name").alias("ps"), F.col("weight").alias("c_weight"), F.col("italic").alias("c_italic"))
    rows = declared.withColumn("ps", postscript_name(F.col("name"))).join(c, "ps", "left")
    conflict = F.coalesce(F.col("weight") != F.col("c_weight"), F.lit(False)) | F.coalesce(F.col("italic") != F.col("c_italic"), F.lit(False))
    return rows.select("font_id", F.when(~conflict, F.col("face_id")).alias("face_id"), (conflict & F.col("face_id").isNotNull()).alias("conflict"))


#: Parts of a kind, fonts and files of a list, and pairs of a task; see match_font_file. Spark holds all pairs of a list of
#: fonts with the files of a part at once, so these lists are short.
PARTS, FONTS, FILES, PAIRS = 4, 16, 256, 8_000_000


def _lists(rows: DataFrame, key: str, part: str, name: str, most: int) -> DataFrame:
    """(kind, part, name): the keys of a kind in lists of `most`, dealt into PARTS parts; a null key stays."""
    every = F.concat(F.array_sort(F.collect_list(key)), F.array_repeat(F.lit(None).cast(rows.schema[key].dataType), (F.count("*") - F.count(key)).cast("int")))
    parts = rows.groupBy("kind", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias(part)).agg(every.alias("all"))
    return parts.select("kind", part, F.explode(F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(most)), lambda at: F.slice("all", at, most))).alias(name))


def match_font_file(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(font_id, file_id): files whose face is the declared one, all that fit.

    declared (font_id, name, weight, italic), weight and italic maybe null; files (file_id, family,
    full_name, weight, italic). A file fits if its slant agrees with a declared one and: for a name
    `Family,Style`, family equal, bold iff weight >= 600, italic iff the style says so; else full name equal,
    or family equal with the declared weight (400 if none) and slant (upright if none).

    Fonts that ask for the same and files of the same names, weight and slant are one kind each; kinds meet, then lists
    of the fonts meet lists of the files of the kinds that fit, each of PARTS parts with each. So only pairs that fit are
    formed, each once, and neither a name that many share nor the pairs themselves are dealt to one task.

    The pairs grow with the square of a kind. They leave list by list, a font with each file of a list in turn, and a
    task has about PAIRS of them, of few kinds: so a columnar file, which keeps a run or a short cycle of known values in
    a few bits, stores them in a small part of their size.
    """
    d = declared.withColumn("base", F.regexp_extract("name", r"^([^,]*)", 1)).withColumn("style", F.lower(F.regexp_extract("name", r",(.*)$", 1)))
    kinds = lambda rows, key, *columns: rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("of")).withColumn("kind", F.to_json("of"))
    fonts = kinds(with_font_key(d, "base"), "font_id", "base", "style", "weight", "italic")
    own = kinds(with_font_key(with_font_key(files, "family"), "full_name").withColumnsRenamed({"weight": "fw", "italic": "fi"}), "file_id", "family", "full_name", "fw", "fi")
    names = F.array(F.struct(F.lit(True).alias("family"), F.col("o.family").alias("base")), F.struct(F.lit(False).alias("family"), F.col("o.full_name").alias("base")))
    asked = fonts.groupBy("kind", "of").agg(F.count("*").alias("fonts")).select(F.col("kind").alias("asked"), "fonts", F.explode("of").alias("o")).select("asked", "fonts", "o.*")
    given = own.groupBy("kind", "of").agg(F.count("*").alias("files")).select("kind", "files", F.explode("of").alias("o")).select("kind", "files", "o.fw", "o.fi", F.explode(names).alias("x")).select("kind", "files", "fw", "fi", "x.*")
    rows = asked.join(given, "base")
    slant = F.col("italic").isNull() | (F.col("italic") == F.col("fi"))
    by_style = F.col("family") & (F.col("style").contains("bold") == (F.col("fw") >= 600)) & (F.col("style").rlike("italic|oblique") == F.col("fi"))
    by_name = ~F.col("family") | ((F.col("fw") == F.coalesce("weight", F.lit(400))) & (F.col("fi") == F.coalesce("italic", F.lit(False))))
    spark = declared.sparkSession
    fit = Scratch(spark).save(rows.where(slant & F.when(F.col("style") != "", by_style).otherwise(by_name)).select("asked", "kind", (F.col("fonts") * F.col("files")).alias("pairs")).distinct(), "fit")
    tasks = min(max((fit.agg(F.sum("pairs")).first()[0] or 0) // PAIRS, spark.sparkContext.defaultParallelism), 10_000)
    each = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    wanted = _lists(fonts, "font_id", "part", "fonts", FONTS).withColumnRenamed("kind", "asked").join(fit, "asked").select("kind", "part", each.alias("chunk"), "fonts")
    offered = _lists(own, "file_id", "chunk", "files", FILES).select("kind", each.alias("part"), "chunk", "files")
    cell = ["kind", "part", "chunk"]
    met = wanted.repartition(tasks, *cell).join(offered.repartition(tasks, *cell), cell)
    return met.select(F.explode("fonts").alias("font_id"), "files").select("font_id", F.explode("files").alias("file_id"))


def glyph_coverage(observed: DataFrame) -> DataFrame:
    """A10: (font, cp, gid): the glyph of a code point, 0 where two were seen."""
    return observed.groupBy("font", "cp").agg(F.when(F.min("gid") == F.max("gid"), F.min("gid")).otherwise(0).alias("gid"))


def missing_glyphs(used: DataFrame, coverage: DataFrame) -> DataFrame:
    """(font, cp) that runs use and for which the font has no unambiguous glyph."""
    return used.select("font", "cp").distinct().join(coverage.where("gid <> 0"), ["font", "cp"], "left_anti")


def font_action(reconciled: DataFrame, declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_no, face, action) of each unusable face: substitute (unknown), download (catalog_face offers a face to
    every declaration of it on the page, so none differs in weight or slant, and no font of that name has others),
    own_file (known but not embedded)."""
    offers = catalog_face(declared, catalog).join(declared.select("font_id", "page_no", postscript_name(F.col("name")).alias("face")), "font_id")
    offered = offers.groupBy("page_no", "face").agg(F.bool_and(F.col("face_id").isNotNull()).alias("offered"))
    rows = reconciled.where("not usable").join(offered, ["page_no", "face"], "left")
    action = F.when(F.col("embedded") == "unknown", "substitute").when(F.col("offered") & ~F.col("several"), "download").otherwise("own_file")
    return rows.select("page_no", "face", action.alias("action"))
