"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each. For two of them the dot product differs from that
of the quantised ones by at most |x'||f| + |e|(|y'| + |f|), where x', y' are the quantised vectors and e, f
the remainders, whose lengths are known. Tiles of integer products decide all pairs whose bounds lie on one
side of the threshold; only codes and lengths are sent to them. The vectors of the other pairs follow in
full, and those pairs are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, connected_components, local_roots

#: Vectors of a block, and rows of a block that are multiplied at once.
BLOCK, STRIP = 8192, 1024
#: Dimensions whose int8 products still sum exactly in single precision: 1024 * 127 * 127 < 2**24.
EXACT = 1024
#: Added to each bound for the rounding of scales, norms and products.
ROUNDING = 1e-5
PAIRS = 1 << 15


class Quantised:
    """Codes of unit vectors with scale, and the lengths of the quantised vector and of the remainder, rounded up."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, length: np.ndarray, rest: np.ndarray):
        self.codes, self.scale, self.length, self.rest = codes, scale, length, rest

    @classmethod
    def of(cls, vectors: np.ndarray) -> Quantised:
        """From finite vectors other than zero."""
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        scale = np.nextafter((np.abs(unit).max(axis=1) / 127).astype(np.float32), np.float32(1))
        codes = np.rint(unit / scale[:, None].astype(np.float64)).astype(np.int8)
        near = codes * scale[:, None].astype(np.float64)
        up = lambda x: np.nextafter(np.sqrt((x**2).sum(axis=1)).astype(np.float32), np.float32(2))
        return cls(codes, scale, up(near), up(unit - near))

    def part(self, rows) -> Quantised:
        return Quantised(self.codes[rows], self.scale[rows], self.length[rows], self.rest[rows])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by a power of two near its largest component, so that squares stay finite."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def judged_pairs(x: Quantised, y: Quantised, threshold: float, same: bool):
    """Strips of (i, j, sure): pairs of rows of x and y that can reach the threshold, sure if they do whatever the
    remainders are; i < j only if x and y are the same block. Each pair is judged alike wherever it stands."""
    dims = x.codes.shape[1]
    right = y.codes.astype(np.float32)
    for begin in range(0, len(x.codes), STRIP):
        part = slice(begin, begin + STRIP)
        left = x.codes[part].astype(np.float32)
        product = (left[:, :EXACT] @ right[:, :EXACT].T).astype(np.float32 if dims <= EXACT else np.float64)
        for d in range(EXACT, dims, EXACT):
            product += left[:, d : d + EXACT] @ right[:, d : d + EXACT].T
        least = threshold - (x.length[part].max() * y.rest.max() + x.rest[part].max() * (y.length + y.rest).max() + 2 * ROUNDING)
        # a coarse cut first: products of codes that are too small at the largest scales of the strip
        i, j = np.nonzero(product >= least / (float(x.scale[part].max()) * float(y.scale.max())))
        i_all = i + begin
        if same:
            keep = i_all < j
            i, i_all, j = i[keep], i_all[keep], j[keep]
        near = product[i, j].astype(np.float64) * x.scale[i_all].astype(np.float64) * y.scale[j].astype(np.float64)
        bound = x.length[i_all].astype(np.float64) * y.rest[j] + x.rest[i_all].astype(np.float64) * (y.length[j].astype(np.float64) + y.rest[j]) + ROUNDING
        keep = near + bound >= threshold
        yield i_all[keep], j[keep], (near - bound >= threshold)[keep]


def exact_links(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """For each pair (i of x, j of y) whether its cosine reaches the threshold in double precision."""
    out = np.empty(len(i), dtype=bool)
    norms = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y)]
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        out[k : k + PAIRS] = np.einsum("ij,ij->i", x[a], y[b]) / (norms[0][a] * norms[1][b]) >= threshold
    return out


class Forest:
    """Link counts of the rows of a tile, and a spanning forest of its links, added strip by strip."""

    def __init__(self, rep: np.ndarray, n: np.ndarray):
        self.rep, self.n, self.links = rep, n, np.zeros(len(rep), dtype=np.int64)
        self.order = np.argsort(rep, kind="stable")  # so that the smallest row of a component has its smallest id
        self.place = np.empty(len(rep), dtype=np.int64)
        self.place[self.order] = np.arange(len(rep))
        self.root = np.arange(len(rep))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.links += np.bincount(i, weights=self.n[j], minlength=len(self.rep)).astype(np.int64)
            self.links += np.bincount(j, weights=self.n[i], minlength=len(self.rep)).astype(np.int64)
            a, b = self.root[self.place[i]], self.root[self.place[j]]
            self.root = local_roots(len(self.rep), a, b)[self.root]

    def rows(self) -> list[pa.Array]:
        at = np.flatnonzero(self.links > 0)
        return [pa.array(self.rep[at]), pa.array(self.links[at]), pa.array(self.rep[self.order[self.root[self.place[at]]]])]


CODES = "rep bigint, n bigint, dims int, codes binary, scale float, length float, rest float"


def _quantise(batches):
    for batch in batches:
        rep, n, dims, v = batch.columns
        for k in np.unique(dims.to_numpy()).tolist():
            at = np.flatnonzero(dims.to_numpy() == k)
            vectors = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), k)
            q = Quantised.of(_scaled(vectors))
            codes = pa.array([row.tobytes() for row in q.codes], pa.binary())
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(at)), n.take(pa.array(at)), dims.take(pa.array(at)), codes, *map(pa.array, (q.scale, q.length, q.rest))], [c.split()[0] for c in CODES.split(", ")])


PACKED = ("reps", "ns", "codes", "scales", "lengths", "rests")


def _pack(table: pa.Table) -> pa.Table:
    """The rows of a block as one row of bytes."""
    data = [table.column("rep").to_numpy().tobytes(), table.column("n").to_numpy().tobytes(), b"".join(table.column("codes").to_pylist()), *(table.column(c).to_numpy().tobytes() for c in ("scale", "length", "rest"))]
    head = [pa.array([table.column("dims")[0].as_py()], pa.int32()), pa.array([table.column("block")[0].as_py()], pa.int64())]
    return pa.table([*head, *(pa.array([d], pa.binary()) for d in data)], names=["dims", "block", *PACKED])


def _tile(threshold: float):
    """For a pair of blocks: rows with links (rep, links, root), and rows (rep, open) of pairs still open."""

    def run(table: pa.Table) -> pa.Table:
        blocks = []
        for row in table.sort_by("block").to_pylist():
            floats = [np.frombuffer(row[c], dtype=np.float32) for c in ("scales", "lengths", "rests")]
            codes = np.frombuffer(row["codes"], dtype=np.int8).reshape(-1, row["dims"])
            blocks.append((np.frombuffer(row["reps"], dtype=np.int64), np.frombuffer(row["ns"], dtype=np.int64), Quantised(codes, *floats)))
        (rep, n, x), (_, _, y), shift = blocks[0], blocks[-1], 0
        if len(blocks) == 2:
            shift = len(rep)
            rep, n = np.concatenate([rep, blocks[1][0]]), np.concatenate([n, blocks[1][1]])
        forest, unsure = Forest(rep, n), np.zeros(len(rep), dtype=bool)
        for i, j, sure in judged_pairs(x, y, threshold, same=not shift):
            forest.add(i[sure], j[sure] + shift)
            unsure[i[~sure]] = unsure[j[~sure] + shift] = True
        linked, at = forest.rows(), np.flatnonzero(unsure)
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [pa.concat_arrays([linked[0], pa.array(rep[at])]), pa.concat_arrays([linked[1], none(len(at))]), pa.concat_arrays([linked[2], none(len(at))])]
        size = len(columns[0])
        key = [pa.array([table.column(c)[0].as_py()] * size, t) for c, t in (("dims", pa.int32()), ("i", pa.int64()), ("j", pa.int64()))]
        second = pa.array(np.concatenate([np.zeros(len(linked[0]), dtype=bool), at >= shift if shift else np.zeros(len(at), dtype=bool)]))
        return pa.table([*key, *columns, second], names=["dims", "i", "j", "rep", "links", "root", "second"])

    return run


def _recheck(threshold: float):
    """The open pairs of a tile, from full vectors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("second")
        dims = table.column("dims")[0].as_py()
        values = pa.concat_arrays(table.column("v").chunks).flatten().to_numpy(zero_copy_only=False)
        vectors, rep, n = _scaled(values.reshape(table.num_rows, dims)), table.column("rep").to_numpy(), table.column("n").to_numpy()
        shift = int(np.searchsorted(table.column("second").to_numpy(zero_copy_only=False), True))
        both = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        if not both:
            shift = 0
        q, forest = Quantised.of(vectors), Forest(rep, n)
        x, y = (q.part(slice(0, shift)), q.part(slice(shift, None))) if both else (q, q)
        for i, j, sure in judged_pairs(x, y, threshold, same=not both):
            i, j = i[~sure], j[~sure] + shift
            near = exact_links(vectors, vectors, i, j, threshold)
            forest.add(i[near], j[near])
        return pa.table(forest.rows(), names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: exact links of cosine >= threshold.

    Equal vectors collapse to their smallest id first, by a 128-bit hash, and come back in the counts, so a
    group of copies costs one row. Distinct vectors are dealt by hash into blocks of about BLOCK; every pair
    of blocks is one group of a shuffle, which carries a byte a dimension, so work is spread evenly and no
    task holds more than two blocks. A tile returns link counts and a spanning forest of its links, never the
    pairs; the vectors of pairs that codes cannot decide follow to a group of the same two blocks.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id,
    link with nothing and are their own component; vectors of different dimensions don't link. Rows that
    share an id are separate vectors in the counts. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, v).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    distinct = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").cast("bigint").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = scratch.save(distinct.withColumn("dims", F.size("v")), "distinct")
    blocks = distinct.groupBy("dims").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = scratch.save(blocks, "blocks")  # one row for each number of dimensions
    codes = distinct.select("rep", "n", "dims", "v").mapInArrow(_quantise, CODES)
    dealt = codes.join(blocks, "dims").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks")
    packed = dealt.groupBy("dims", "block").applyInArrow(_pack, "dims int, block bigint, " + ", ".join(f"{c} binary" for c in PACKED))
    packed = scratch.save(packed, "packed").join(blocks, "dims")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tiles = pairs.groupBy("dims", "i", "j").applyInArrow(_tile(threshold), "dims int, i bigint, j bigint, rep bigint, links bigint, root bigint, second boolean")
    tiles = scratch.save(tiles, "tiles")
    unsure = tiles.where("root is null").select("dims", "i", "j", "second", "rep").join(distinct.select("rep", "n", "v"), "rep")
    again = unsure.groupBy("dims", "i", "j").applyInArrow(_recheck(threshold), "rep bigint, links bigint, root bigint")
    links = scratch.save(tiles.where("root is not null").select("rep", "links", "root").unionByName(again), "links")
    joined = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = distinct.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(joined, distinct.rep == joined.node, "left")
    found = found.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("id", "h1", "h2").join(scratch.save(found, "found"), ["h1", "h2"], "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", F.col("id").cast("bigint")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
