"""Small files and folders of the address space that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all that is in it; what is not there stays so."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where the folder is missing."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a text at a path where nothing is, whole or not at all; False if something is there already.

    The text is written beside it and renamed without overwriting, which file systems with an atomic rename decide
    for one of several writers."""
    context = spark.sparkContext
    fs, fresh = _at(spark, f"{path}.{context.applicationId}.{id(text)}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = context._jvm.org.apache.hadoop.fs
    options = context._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fresh, hadoop.Path(path), options)
    except Exception as error:
        fs.delete(fresh, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True
