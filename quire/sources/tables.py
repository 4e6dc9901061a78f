"""Reading tables, landing folders and keyed record stores; writing records and backups."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from quire.functions import files

#: Suffixes that intake accepts; fixed values.
SUFFIXES = ("pdf", "docx", "hwp", "hwpx", "pptx", "doc", "ppt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_documents(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Files of a landing folder with an accepted suffix in any case: (path, size, modified, content).
    Files without a byte, which intake would reject, are passed over by Spark's reader."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES) + "}"
    if stream:
        found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(folder)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def land_files(landing: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files of a folder, each from the task that holds its row, and returns their
    number. A file is written under a name that scans pass over and then moved, so a scan sees it whole or not at
    all, and a task that runs again replaces it. Names are unique; tasks must reach the folder by its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{root}/_{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return landing.select("name", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(run, "name string").count()


def write_records(store: DataFrame, incoming: DataFrame, reason, key: str | list[str] = "id") -> tuple[DataFrame, DataFrame]:
    """S3: (next store, quarantined rows): incoming rows replace stored ones of the same key; a replaced row
    for which `reason`, a column of the store, isn't null is quarantined first. incoming has one row for each
    key. See Store.write for the sink."""
    keys = incoming.select(key)
    hit = store.withColumn("reason", reason).join(keys, key, "left_semi")
    kept = store.join(keys, key, "left_anti").select(*store.columns)
    return kept.unionByName(incoming.select(*store.columns)), hit.where("reason is not null")


class Conflict(Exception):
    """Another writer has put its version in force first."""


class Store:
    """A record store in a folder, laid out by namespace, kind and a slot of the key, under a log of versions.

    Each file of the folder `versions` says which partition folders are in force, so a reader sees one version whole.
    A change reads and writes only the partitions of the rows that come in, into folders of its own, and puts version
    n + 1 in force by creating its file; a writer that finds it there already was second and gets a Conflict, its
    rows never seen. Records are told by namespace, kind and key. Quarantined rows are part of the version that
    made them leave. The file system must rename atomically, as HDFS and local disks do; namespaces and kinds are plain
    words.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", parts: tuple[str, ...] = ("namespace", "kind"), slots: int = 8):
        self.spark, self.folder, self.key, self.parts, self.slots = spark, folder.rstrip("/"), key, parts, slots

    def _slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def _state(self) -> dict:
        found = [n for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json")]
        return json.loads(files.read_text(self.spark, f"{self.folder}/versions/{found[-1]}")) if found else {"version": 0, "parts": [], "retained": [], "batches": {}, "schema": None}

    def version(self) -> int:
        """The version in force, 0 before the first write."""
        return self._state()["version"]

    def _rows(self, state: dict, folders: list[str]) -> DataFrame:
        kinds = StructType.fromJson(state["schema"])
        if not folders:
            return self.spark.createDataFrame([], kinds)
        # columns that are folders: the write, the parts and the slot
        schema = StructType([f for f in kinds if f.name not in self.parts]).add("slot", "integer")
        for c in self.parts:
            schema = schema.add(c, "string")
        found = self.spark.read.schema(schema.add("write", "string")).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{f}" for f in folders])
        return found

    def read(self, key: object | None = None, **parts: str) -> DataFrame:
        """All records in force, or those of a namespace, a kind, a key; Spark prunes the folders of others. A
        missing key gives no row."""
        state = self._state()
        rows = self._rows(state, state["parts"])
        for c, value in parts.items():
            rows = rows.where(F.col(c) == value)
        if key is not None:
            rows = rows.where(F.col(self.key) == F.lit(key))
            if "slot" in rows.columns:
                kind = rows.schema[self.key].dataType
                rows = rows.where(F.col("slot") == self._slot(F.lit(key).cast(kind)))
        return rows.select(*StructType.fromJson(state["schema"]).names)

    def retained(self) -> DataFrame:
        """All rows that were quarantined, with the reason and version_left."""
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{f}" for f in self._state()["retained"]])

    def change(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]], batch: tuple[str, int] | None = None) -> int:
        """Puts merge(stored, incoming) -> (rows, quarantined) in force for the partitions of the incoming rows, of
        which `stored` are the rows; other partitions stay as they are. Returns the version. batch is (stream, id): a
        batch of a stream that the store has seen changes nothing."""
        state = self._state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return state["version"]
        slotted = incoming.withColumn("slot", self._slot(F.col(self.key)))
        touched = []
        for row in slotted.select(*self.parts, "slot").distinct().collect():  # at most slots for each kind of each namespace
            if any(not isinstance(v, str) or not re.fullmatch("[A-Za-z0-9_-]+", v) for v in row[:-1]):
                raise ValueError(f"{self.parts} must be plain words, not {tuple(row[:-1])}")
            touched.append("/".join(f"{c}={v}" for c, v in row.asDict().items()))
        held = {f.split("/", 1)[1]: f for f in state["parts"]}
        state["schema"] = state["schema"] or incoming.schema.jsonValue()
        stored = self._rows(state, [held[t] for t in touched if t in held]).select(*StructType.fromJson(state["schema"]).names)
        rows, quarantined = merge(stored, incoming.select(*stored.columns))
        write, new = f"write={uuid.uuid4().hex}", state["version"] + 1
        if quarantined is not None:
            quarantined.withColumn("version_left", F.lit(new)).write.parquet(f"{self.folder}/retained/{write}")
            state["retained"].append(f"retained/{write}")
        rows.withColumn("slot", self._slot(F.col(self.key))).write.partitionBy(*self.parts, "slot").parquet(f"{self.folder}/data/{write}")
        parts = [f for at, f in held.items() if at not in touched]
        parts += [f"{write}/{t}" for t in touched if files.exists(self.spark, f"{self.folder}/data/{write}/{t}")]
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        if not files.write_new(self.spark, f"{self.folder}/versions/{new:012d}.json", json.dumps({"version": new, "parts": parts, "retained": state["retained"], "batches": batches, "schema": state["schema"]})):
            files.delete(self.spark, f"{self.folder}/data/{write}")
            files.delete(self.spark, f"{self.folder}/retained/{write}")
            raise Conflict(f"version {new} of {self.folder} is another writer's")
        return new

    def write(self, incoming: DataFrame, reason) -> int:
        """S3: write_records into the store; returns the version."""
        return self.change(incoming, lambda stored, rows: write_records(stored, rows, reason, [*self.parts, self.key]))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the folders that none of the newest `keep` versions names, and the files of older versions; returns
        what went. A reader of an older version, or a writer that has not put its version in force yet, loses its
        folders."""
        versions = [n for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json")]
        kept = [json.loads(files.read_text(self.spark, f"{self.folder}/versions/{n}")) for n in versions[-keep:]]
        used = {f.split("/")[0] for state in kept for f in state["parts"]}
        gone = [f"versions/{n}" for n in versions[:-keep]] + [f"data/{w}" for w in files.names(self.spark, f"{self.folder}/data") if w.startswith("write=") and w not in used]
        for name in gone:
            files.delete(self.spark, f"{self.folder}/{name}")
        return gone


def delete_by_key(store: DataFrame, keys: DataFrame, key_col: str = "id", kind_col: str = "kind") -> DataFrame:
    """The store without the listed keys; drafts are never deleted."""
    drafts = store.where(F.col(kind_col) == "draft")
    return drafts.unionByName(store.where(F.col(kind_col) != "draft").join(keys.select(key_col).distinct(), key_col, "left_anti").select(*store.columns))


def export_backup_json(records: DataFrame, type_col: str = "type", content_col: str = "content") -> DataFrame:
    """Each row as one JSON text in column `json`; bytes become {type, base64} under a marker key, null
    fields are left out. A number that JSON cannot hold (NaN, an infinity) is an error, as is a column of a type
    that JSON would not give back (intervals, maps with keys other than text)."""
    rest = [c for c in records.columns if c not in (type_col, content_col)]
    for c in rest:
        if not _representable(records.schema[c].dataType):
            raise ValueError(f"JSON cannot hold column {c}: {records.schema[c].dataType.simpleString()}")
    blob = F.struct(F.lit(True).alias("__blob__"), F.col(type_col).alias("type"), F.regexp_replace(F.base64(content_col), "[\r\n]", "").alias("base64"))
    odd = [F.coalesce(_odd(F.col(c), records.schema[c].dataType), F.lit(False)) for c in rest]
    json = F.to_json(F.struct(*rest, blob.alias("source")), {"ignoreNullFields": "true"})
    bad = reduce(lambda a, b: a | b, odd, F.lit(False))
    return records.select(*rest, F.when(bad, F.raise_error(F.lit("a number that JSON cannot hold"))).otherwise(json).alias("json"))


def _representable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _representable(kind.elementType)
    if isinstance(kind, MapType):
        return isinstance(kind.keyType, StringType) and _representable(kind.valueType)
    if isinstance(kind, StructType):
        return all(_representable(f.dataType) for f in kind.fields)
    return isinstance(kind, (NumericType, StringType, BooleanType, DateType, TimestampType, TimestampNTZType))


def _odd(value: Column, kind: DataType) -> Column:
    """Whether a value holds a number that is not finite."""
    if isinstance(kind, (FloatType, DoubleType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(kind, ArrayType):
        return F.exists(value, lambda x: F.coalesce(_odd(x, kind.elementType), F.lit(False)))
    if isinstance(kind, MapType):
        return F.exists(F.map_values(value), lambda x: F.coalesce(_odd(x, kind.valueType), F.lit(False)))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a | b, [F.coalesce(_odd(value[f.name], f.dataType), F.lit(False)) for f in kind.fields], F.lit(False))
    return F.lit(False)
