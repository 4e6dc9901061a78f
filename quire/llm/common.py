"""Helpers that the training-data operators share: scratch tables, held-out splits, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.scratch import Scratch

#: Text bytes that one step of a task handles at once.
CHUNK_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Spark hand at most so many rows at once to Python workers, as a row may be a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(key: Column, modulus: int, remainder: int = 2) -> Column:
    """crc32(key as text) mod modulus = remainder; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


_kept: dict[str, object] = {}


def kept(key: str, build: Callable[[], object]):
    """What build() gives, made once in each Python worker; a worker keeps one such thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def settle() -> None:
    """Gives the memory that a step has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: Rows up to which a table of ids is broadcast unless a caller says otherwise; a larger one is joined by a shuffle.
SMALL = 1_000_000


def side(table: DataFrame, rows: int, limit: int) -> DataFrame:
    """The smaller side of a join: broadcast if it has at most `limit` rows, as counted, else left to a shuffle."""
    return F.broadcast(table) if rows <= limit else table


#: Hash slots among which equal values of most_frequent are dealt.
SLOTS = 256


def most_frequent(counts: DataFrame, key: str, column: str, limit: int) -> DataFrame:
    """The rows of counts with the largest values of column, at most `limit` of them.

    The least value taken is read off a histogram of a few hundred bins, so no task or driver sorts the
    table. The bin that would pass the limit is filled value by value; of the value that would pass it, rows
    are taken by slots of a hash of key, so ties fill the limit up to one slot of SLOTS.
    """
    value, slot = F.col(column), F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bin_ = F.floor(F.log2(value) * 16).cast("int")
    total, last = 0, None
    for at, n in sorted(((r[0], r[1]) for r in counts.groupBy(bin_).count().collect()), reverse=True):
        if total + n > limit:
            last = at
            break
        total += n
    if last is None:
        return counts
    taken = bin_ > last
    inside = counts.where(bin_ == last).groupBy(value.alias("value"), slot.alias("slot")).count().collect()
    for at, s, n in sorted(((r["value"], r["slot"], r["count"]) for r in inside), key=lambda r: (-r[0], r[1])):
        if total + n > limit:
            taken = taken | ((bin_ == last) & ((value > at) | ((value == at) & (slot < s))))
            break
        total += n
    return counts.where(taken)


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` text bytes each; a longer text comes alone. A list of numbers
    counts as a text of six bytes for each."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.multiply(pc.list_value_length(column), 6) if pa.types.is_list(column.type) else pc.binary_length(column)
        sizes = np.asarray(pc.fill_null(sizes, 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            settle()
            begin = stop


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that is linked to it over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def ragged_take(data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenation of data[offsets[i] : offsets[i] + lengths[i]] for i in index."""
    n = lengths[index]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(offsets[index] - (ends - n), n)]


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large and small stars: each round links every node's larger neighbours to its smallest
    one, then its smaller neighbours likewise, until nothing changes. The smallest neighbours come from a
    group-by with map-side minima and are written as tables before the edges are joined to them, so both
    sides of a join are plain shuffles, which Spark splits where a hub is hot. Edges never reach the driver;
    only a count and a checksum do. Loops and null ends are ignored; an empty input gives no rows.
    """

    def least(table: DataFrame, at: str) -> DataFrame:
        return scratch.save(table.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u"), at)

    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = scratch.save(e.where("hi <> lo and hi is not null and lo is not null").distinct(), f"{name}-0")
    state, done = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state, done = now, done + 1
        # the smallest neighbour of a node that is the larger end of no edge is the node itself
        large = e.join(least(e, f"{name}-least"), F.col("lo") == F.col("u"), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        large = scratch.save(large.distinct(), f"{name}-large")
        small = large.join(least(large, f"{name}-lower"), F.col("hi") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("x")).select("x.hi", F.col("x.m").alias("lo"))
        e = scratch.save(small.where("hi <> lo").distinct(), f"{name}-{done}")
        scratch.drop(f"{name}-{done - 1}")
