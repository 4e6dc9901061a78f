"""Jobs that run again only for the groups of files that have changed."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import files as fs
from quire.functions.scratch import Scratch
from quire.operators.intake import fingerprint_partitions


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(source): the groups that have an output, from Spark's listing of files, whose content isn't read."""
    if not fs.exists(spark, f"{folder}/data"):
        return spark.createDataFrame([], "source string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder}/data")
    return listed.select(F.url_decode(F.regexp_extract("path", "/source=([^/]*)/", 1)).alias("source")).distinct()


def plan_rebuild(files: DataFrame, folder: str, version: str) -> DataFrame:
    """(source, fingerprint, state) of each group of files and of each that is gone: `new`, `changed`, `lost`
    (unchanged, but its output is missing), `kept` or `gone`. files: (source, path, size, modified); source is text.
    A group whose output had no rows needs none. Stamps and outputs are those that `rebuild` has left in the folder."""
    spark, stamps = files.sparkSession, f"{folder}/stamps"
    schema = "fingerprint string, n_rows bigint, source string"
    old = spark.read.schema(schema).parquet(stamps) if fs.exists(spark, stamps) else spark.createDataFrame([], schema)
    rows = fingerprint_partitions(files, version).join(old.withColumnRenamed("fingerprint", "before"), "source", "full_outer")
    rows = rows.join(_outputs(spark, folder).withColumn("there", F.lit(True)), "source", "left")
    lost = (F.col("n_rows") > 0) & F.col("there").isNull()
    state = F.when(F.col("fingerprint").isNull(), "gone").when(F.col("before").isNull(), "new").when(F.col("before") != F.col("fingerprint"), "changed").when(lost, "lost").otherwise("kept")
    return rows.select("source", "fingerprint", state.alias("state"))


def rebuild(files: DataFrame, folder: str, version: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Builds the groups that plan_rebuild calls new, changed or lost, and only those, drops what is gone, and
    returns the plan.

    `build` gets the rows of `files` of these groups and gives rows with the column source. The rows of a group replace
    its folder under `data`, then its stamp is replaced; a job that fails in between finds the group changed or lost
    and builds it again. A group that is gone, or whose rows are none now, loses its folder; the driver names these
    groups one by one. One job at a time.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    plan = scratch.save(plan_rebuild(files, folder, version), "plan")  # as what it reads is about to change
    stale = plan.where("state in ('new', 'changed', 'lost')")
    built = scratch.save(build(files.join(stale.select("source"), "source", "left_semi")), "built")
    counts = scratch.save(built.groupBy("source").agg(F.count("*").alias("n_rows")), "counts")

    def overwrite(rows: DataFrame, at: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{folder}/{at}")

    def drop(groups: DataFrame, at: str) -> None:
        doomed = {r.source for r in groups.select("source").collect()}
        for name in fs.names(spark, f"{folder}/{at}") if doomed else ():
            if name.startswith("source=") and unquote(name.removeprefix("source=")) in doomed:
                fs.delete(spark, f"{folder}/{at}/{name}")

    drop(plan.where("state in ('gone', 'changed')").join(counts, "source", "left_anti"), "data")
    overwrite(built, "data")
    overwrite(stale.join(counts, "source", "left").select("fingerprint", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "source"), "stamps")
    drop(plan.where("state = 'gone'"), "stamps")
    return plan
