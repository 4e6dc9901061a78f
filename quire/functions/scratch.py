"""Tables that cut a long lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_used: list[str] = []


class Scratch:
    """Parquet tables under spark.checkpoint.dir, which all executors share.

    The setting is read from the session. Only where it is unset and the master is local, as in tests, a
    temporary folder of this machine is used; elsewhere an unset folder is an error, since executors would
    each write to a disk of their own. Tables that a result may still read stay until the driver ends;
    others can be dropped before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.base = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
        _used.append(self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back, which cuts its lineage."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark.sparkContext, f"{self.base}/{name}")


def _delete(context: SparkContext, path: str) -> None:
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    """Removes the tables of this driver when it ends, where its session still runs."""
    context = SparkContext._active_spark_context
    for base in _used if context is not None and context._jsc is not None else ():
        _delete(context, base)
