"""Line dedup: fuzzy lines by MinHash, exact verification, one line kept in each component.

Equal lines collapse by a 128-bit hash before anything is compared. Distinct lines get a MinHash signature
of their character shingles; lines that share a band share a bucket. Buckets with the same lines are
verified once. A bucket is dealt into groups bounded in lines and characters, and a group verifies all its
pairs by one product of its line-by-shingle matrix: that gives the exact Jaccard similarities, of which only
a spanning forest of the links is returned, never the pairs. In a bucket too large for one group, lines
are compared with a pivot first, in a very large one with pivots in rounds: those similar to a pivot are connected by it,
and as Jaccard distances add up, only lines that touch it can be similar to them. Components are found by joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.llm.common import SMALL, Scratch, connected_components, local_roots, settle, side, text_batches
from quire.llm.textmatch import gram_hashes

#: Bands and rows: of pairs of similarity 0.8 a share of 0.995 meets, of 0.9 all but 3 in a million.
BANDS, ROWS = 8, 3
SLOTS = BANDS * ROWS
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
#: Shingles that are hashed at once.
STEP = 1 << 17
#: Lines and characters that a group may hold from each of its two blocks, about.
TILE, TILE_CHARS = 1024, 1 << 20
#: Pivots of a large bucket in a round, and blocks of a bucket beyond which they are taken in rounds.
PIVOTS, WIDE = 8, 32
#: Shingles that are multiplied at once.
COLUMNS = 4096
#: Key slots that are counted to find hot buckets, and rows that a hot bucket has at least.
KEY_SLOTS, HOT = 1 << 14, 4096


def normal(line: str) -> str:
    """What is compared: lower case, white space collapsed."""
    return " ".join(line.lower().split())


def shingles(line: str, q: int) -> set[str]:
    return {line[i : i + q] for i in range(len(line) - q + 1)} or {line}


def _mixed(codes: np.ndarray, q: int) -> np.ndarray:
    h = gram_hashes(codes, q)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _long_signature(line: str, q: int) -> np.ndarray:
    """MinHash values of one line, STEP shingles at a time."""
    low = np.full(SLOTS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for begin in range(0, len(line) - q + 1, STEP):
        x = _mixed(np.frombuffer(line[begin : begin + STEP + q - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32), q)
        for s in range(SLOTS):
            low[s] = min(low[s], ((x ^ _XOR[s]) * _ODD[s]).min())
    return low


def signatures(lines: list[str], q: int) -> np.ndarray:
    """MinHash values, one row of SLOTS for each line; a line under q characters is one shingle."""
    out = np.empty((len(lines), SLOTS), dtype=np.uint32)
    sizes = np.maximum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)), q)
    grams = np.cumsum(sizes - q + 1)
    begin = 0
    while begin < len(lines):
        stop = max(begin + 1, int(np.searchsorted(grams, (grams[begin - 1] if begin else 0) + STEP, side="right")))
        if stop == begin + 1 and sizes[begin] > STEP:
            out[begin] = _long_signature(lines[begin], q)
            begin = stop
            continue
        codes = np.frombuffer("".join(x.ljust(q, "\0") for x in lines[begin:stop]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(sizes[begin:stop])
        real = np.ones(len(codes) - q + 1, dtype=bool)
        for k in range(1, q):
            real[ends[:-1] - k] = False
        x = _mixed(codes, q)[real]
        starts = np.cumsum(sizes[begin:stop] - q + 1) - (sizes[begin:stop] - q + 1)
        for s in range(SLOTS):
            out[begin:stop, s] = np.minimum.reduceat((x ^ _XOR[s]) * _ODD[s], starts)
        begin = stop
    return out


def _line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def occurrences(rows: DataFrame, q: int) -> DataFrame:
    """(nid, twin, doc, version, line, size, sig) for each line with other characters than white space.

    rows: (doc, version, text). nid and twin are the two halves of the line's hash; sig is null where the
    step has it already.
    """

    def run(batches):
        for batch in text_batches(batches, text=2, limit=2 << 20):
            first: dict[bytes, int] = {}
            keys, owner, number, fresh, lines, sizes = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate(text.split("\n")):
                    if not (line := normal(line)):
                        continue
                    key = _line_key(line)
                    keys.append(key)
                    owner.append(i)
                    number.append(k)
                    sizes.append(len(line))
                    if key in first:
                        fresh.append(-1)
                    else:
                        first[key] = len(lines)
                        fresh.append(len(lines))
                        lines.append(line)
            halves = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
            raw = signatures(lines, q).astype("<u4").tobytes()
            sig = [None if f < 0 else raw[f * 4 * SLOTS : (f + 1) * 4 * SLOTS] for f in fresh]
            at = pa.array(owner, pa.int64())
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["nid", "twin", "doc", "version", "line", "size", "sig"])

    kind = rows.dtypes[0][1]
    return rows.mapInArrow(run, f"nid bigint, twin bigint, doc {kind}, version bigint, line int, size int, sig binary")


def hot_keys(rows: DataFrame) -> list[int]:
    """The keys that hold many of the rows (key, nid), of which there are few: at least HOT of them and over a
    2048th of all. Rows are counted by slots of their keys first, so that only rows of hot slots are counted
    by key."""
    slot = F.pmod("key", F.lit(KEY_SLOTS))
    slots = rows.groupBy(slot.alias("slot")).count()
    total = slots.agg(F.sum("count")).first()[0] or 0
    least = max(HOT, total // 2048)
    hot = [r[0] for r in slots.where(F.col("count") >= least).select("slot").collect()]
    if not hot:
        return []
    return [r[0] for r in rows.where(slot.isin(hot)).groupBy("key").count().where(F.col("count") >= least).select("key").collect()]


def bucket_keys(occ: DataFrame) -> DataFrame:
    """(nid, size, keys): the distinct lines with the keys of their buckets."""
    marked = occ.where("sig is not null").groupBy("nid").agg(F.first("sig").alias("sig"), F.first("size").alias("size"))
    keys = [F.xxhash64(F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS), F.lit(b)) for b in range(BANDS)]
    return marked.select("nid", "size", F.array(*keys).alias("keys"))


def bucket_members(lines: DataFrame) -> DataFrame:
    """(key, nid, size) for the lines (nid, size, keys) of each bucket of two or more.

    A bucket's rows pass by in order, so only its last row is held. Rows of hot buckets need no such pass,
    as they have fellows for certain; so no bucket makes one task large.
    """
    rows = lines.select(F.explode("keys").alias("key"), "nid", "size")

    def run(batches):
        last, shown = None, False  # the row before this batch, and whether it has been returned
        for batch in batches:
            key, *others = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.append(False, same) | np.append(same, False)
            columns = [key, *others]
            if last is not None and last[0] == key[0]:
                keep[0] = True
                if not shown:
                    columns = [np.append(np.asarray(x, dtype=c.dtype), c) for x, c in zip(last, columns)]
                    keep = np.append(True, keep)
            last, shown = [c[-1] for c in columns], bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "nid", "size"])

    hot = hot_keys(rows)
    cold = rows.where(~F.col("key").isin(hot)) if hot else rows
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, nid bigint, size int")
    return found.unionByName(rows.where(F.col("key").isin(hot))) if hot else found


def distinct_buckets(members: DataFrame) -> DataFrame:
    """(key, blocks, pivot): one of all buckets that hold the same lines (by count and two sums of hashes),
    the blocks that it is dealt into, and its smallest line."""
    total = lambda seed: F.sum(F.xxhash64("nid", F.lit(seed)).cast("decimal(20,0)"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), total(1).alias("h1"), total(2).alias("h2"), F.sum("size").alias("chars"), F.min("nid").alias("pivot"))
    one = buckets.groupBy("n", "h1", "h2").agg(F.min(F.struct("key", "chars", "pivot")).alias("b")).select("n", "b.*")
    return one.select("key", _blocks(F.col("n"), F.col("chars")).alias("blocks"), "pivot")


def _blocks(n, chars):
    return F.greatest(F.ceil(n / TILE), F.ceil(chars / TILE_CHARS)).cast("bigint")


def similar_rows(lines: list[str], q: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) whose shingle sets have a Jaccard similarity of threshold or more."""
    sizes = np.maximum(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)), q)
    codes = np.frombuffer("".join(x.ljust(q, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h, owner = gram_hashes(codes, q), np.repeat(np.arange(len(lines), dtype=np.int32), sizes)[: len(codes) - q + 1]
    real = np.ones(len(h), dtype=bool)
    ends = np.cumsum(sizes)[:-1]
    for k in range(1, q):
        real[ends - k] = False
    _, gram, times = np.unique(h[real], return_inverse=True, return_counts=True)
    owner = owner[real]
    # shingles that occur once are in no two lines: they only count in the size of their line's set
    several = times > 1
    alone = ~several[gram]
    own = np.bincount(owner[alone], minlength=len(lines)).astype(np.float32)
    gram, owner = (np.cumsum(several) - 1)[gram[~alone]], owner[~alone]
    distinct = int(several.sum())
    shared = np.zeros((len(lines), len(lines)), dtype=np.float32)
    if distinct > COLUMNS:
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
    for begin in range(0, distinct, COLUMNS):
        part = slice(*np.searchsorted(gram, [begin, begin + COLUMNS])) if distinct > COLUMNS else slice(None)
        matrix = np.zeros((len(lines), min(COLUMNS, distinct - begin)), dtype=np.float32)
        matrix[owner[part], gram[part] - begin] = 1
        shared += matrix @ matrix.T
    own += shared.diagonal()
    return np.nonzero(np.triu(shared >= threshold * (own[:, None] + own[None, :] - shared) - 1e-3, 1))


def _touching(rows: DataFrame, q: int, threshold: float) -> DataFrame:
    """(key, nid, pivot, near) of the rows (key, nid, content, pivot, against) whose lines are similar to the pivot's
    content `against` (near), or near enough for a line similar to the pivot to be similar to them: distances add up, so
    two lines that far apart need a similarity to the pivot of 2 * threshold - 1."""

    def run(batches):
        held: dict[int, set[str]] = {}
        last, own = None, set()
        for whole in batches:
            for batch in text_batches(iter([whole]), text=2, limit=1 << 20):
                near, touch = [], []
                for nid, line, pivot, against in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                    if nid != last:
                        last, own = nid, shingles(line, q)
                    if pivot not in held:
                        if len(held) >= 64:
                            held.clear()
                        held[pivot] = shingles(against, q)
                    both = len(own & held[pivot])
                    total = len(own) + len(held[pivot]) - both
                    near.append(both >= threshold * total - 1e-3)
                    touch.append(near[-1] or both >= (2 * threshold - 1) * total - 1e-2)
                keep = pa.array(touch, pa.bool_())
                columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(near, pa.bool_())]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["key", "nid", "pivot", "near"])

    return rows.mapInArrow(run, "key bigint, nid bigint, pivot bigint, near boolean")


def _through(n) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), n - 1)


def _pivot_rounds(lines: DataFrame, q: int, threshold: float, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(tables of _touching, far): the lines (key, nid, size, content) of large buckets against pivots, in rounds, and
    the lines (key, nid, size) that are near none.

    A round takes one pivot of each of PIVOTS hash slots of a bucket's far lines and compares all its lines with them. A
    bucket is done when its far lines fit into one block, or when a round has made fewer than a tenth of them near.
    """
    touched: list[DataFrame] = []
    far = lines.select("key", "nid", "size")
    active = scratch.save(far.groupBy("key").agg(F.count("*").alias("n")), "active-0")
    while not active.isEmpty():
        k = len(touched)
        chosen = far.join(active.select("key"), "key", "left_semi").groupBy("key", F.pmod(F.xxhash64("nid", F.lit(k)), F.lit(PIVOTS)).alias("slot")).agg(F.min("nid").alias("nid"))
        pivots = chosen.join(lines.select("key", "nid", "content"), ["key", "nid"]).select("key", F.col("nid").alias("pivot"), F.col("content").alias("against"))
        pivots = scratch.save(pivots, f"pivots-{k}")
        touched.append(scratch.save(_touching(lines.join(pivots, "key").select("key", "nid", "content", "pivot", "against"), q, threshold), f"touched-{k}"))
        far = scratch.save(far.join(touched[-1].where("near").select("key", "nid"), ["key", "nid"], "left_anti"), f"far-{k}")
        left = far.groupBy("key").agg(F.count("*").alias("now"), F.sum("size").alias("chars")).where(_blocks(F.col("now"), F.col("chars")) > 1)
        active = scratch.save(active.join(left, "key").where(F.col("now") < 0.9 * F.col("n")).select("key", F.col("now").alias("n")), f"active-{k + 1}")
    return touched, far


def _large_groups(lines: DataFrame, q: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(groups, near): what is left to compare in large buckets once each line is known to be near pivots or far from
    all, and the links (a, b) of near lines to their pivots.

    Two lines that are similar, but not connected by pivots so far, are both far, or one is near a pivot and the other
    touches it. So the far lines of a bucket meet in pairs of blocks, and of each pivot the near lines meet those that
    touch it and belong elsewhere. groups: (key, i, j, nid, content), each of at most two blocks.
    """
    touched, far = _pivot_rounds(lines, q, threshold, scratch)
    touches = reduce(lambda a, b: a.unionByName(b), touched)
    near = touches.where("near and nid <> pivot").select(F.col("nid").alias("a"), F.col("pivot").alias("b"))
    joined = scratch.save(connected_components(near, scratch, "families"), "families")
    of = lambda c, name: joined.select(F.col("node").alias(c), F.col("component").alias(name))
    apart = touches.where("not near").join(of("nid", "own"), "nid", "left").join(of("pivot", "theirs"), "pivot", "left")
    apart = apart.where(F.coalesce("own", "nid") != F.coalesce("theirs", "pivot")).select("key", "pivot", "nid", F.lit(False).alias("near"))
    apart = scratch.save(apart, "apart")
    home = touches.where("near").join(apart.select("key", "pivot").distinct(), ["key", "pivot"], "left_semi").select("key", "pivot", "nid", "near")
    sides = apart.unionByName(home).join(lines.select("key", "nid", "size", "content"), ["key", "nid"])
    count = sides.groupBy("key", "pivot", "near").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).select("key", "pivot", "near", _blocks(F.col("n"), F.col("chars")).alias("blocks"))
    both = count.where("near").select("key", "pivot", F.col("blocks").alias("homes")).join(count.where("not near").select("key", "pivot", F.col("blocks").alias("others")), ["key", "pivot"])
    at = lambda blocks: F.pmod(F.xxhash64("nid"), F.col(blocks))
    dealt = sides.join(scratch.save(both, "sides"), ["key", "pivot"]).withColumn("own", F.when(F.col("near"), at("homes")).otherwise(at("others")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("near"), _through(F.col("others"))).otherwise(_through(F.col("homes")))))
    i, j = F.when(F.col("near"), F.col("own")).otherwise(F.col("other")), F.when(F.col("near"), F.col("other")).otherwise(F.col("own"))
    cross = dealt.select(F.xxhash64("key", "pivot").alias("key"), i.alias("i"), j.alias("j"), "nid", "content")
    sizes = far.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).select("key", _blocks(F.col("n"), F.col("chars")).alias("far"))
    apart_all = far.select("key", "nid").join(scratch.save(sizes, "sizes"), "key").withColumn("i", at("far")).withColumn("j", F.explode(_through(F.col("far"))))
    alone = apart_all.join(lines.select("key", "nid", "content"), ["key", "nid"]).select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "nid", "content")
    return cross.unionByName(alone), near


def _near_pivot(rows: DataFrame, q: int, threshold: float) -> DataFrame:
    """rows (key, pivot, blocks, nid, size, content, against) with `near`: whether the line is similar to the
    pivot's content `against`, which is dropped."""

    def run(batches):
        for batch in batches:
            memo, near = {}, []
            for line, pivot in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                if pivot not in memo:
                    memo = {pivot: shingles(pivot, q)}
                a, b = shingles(line, q), memo[pivot]
                both = len(a & b)
                near.append(both >= threshold * (len(a) + len(b) - both) - 1e-3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(near, pa.bool_())], [*batch.schema.names[:6], "near"])

    return rows.mapInArrow(run, "key bigint, pivot bigint, blocks bigint, nid bigint, size int, content string, near boolean")


def _one_pivot(rows: DataFrame, pivots: DataFrame, q: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(groups, near) as _large_groups has them, of rows (key, pivot, blocks, nid, size, content) of buckets of few blocks:
    lines near the bucket's pivot (key, against) are connected by it, so their blocks meet only those of the others."""
    judged = scratch.save(_near_pivot(rows.join(pivots, "key").select("key", "pivot", "blocks", "nid", "size", "content", "against"), q, threshold), "judged")
    near = judged.where("near and nid <> pivot").select(F.col("nid").alias("a"), F.col("pivot").alias("b"))
    far = judged.where("not near").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).select("key", _blocks(F.col("n"), F.col("chars")).alias("far"))
    dealt = judged.join(scratch.save(far, "far"), "key")
    own = dealt.withColumn("i", F.pmod(F.xxhash64("nid"), F.when(F.col("near"), F.col("blocks")).otherwise(F.col("far"))))
    meets = own.withColumn("j", F.explode(F.when(F.col("near"), _through(F.col("far"))).otherwise(_through(F.col("far") + F.col("blocks")))))
    # blocks of far lines count from 0, those of near ones from `far` on; groups are pairs (i <= j) with a far one
    i = F.when(F.col("near"), F.col("i") + F.col("far")).otherwise(F.col("i"))
    meets = meets.withColumn("i", i)
    return meets.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "nid", "content"), near


def bucket_groups(members: DataFrame, texts: DataFrame, q: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(groups, links): the groups (key, i, j, nid, content) of lines whose pairs are to be compared, a small bucket
    being one of them, and links (a, b) that are known without, if any bucket is too large for one group. Up to WIDE
    blocks one pivot will do, as all pairs of blocks are a bounded number; beyond, pivots are taken in rounds."""
    buckets = scratch.save(distinct_buckets(members), "buckets")
    rows = members.join(buckets, "key").join(texts.select("nid", "content"), "nid").select("key", "pivot", "blocks", "nid", "size", "content")
    zero = F.lit(0).cast("bigint")
    groups = rows.where("blocks = 1").select("key", zero.alias("i"), zero.alias("j"), "nid", "content")
    most = buckets.agg(F.max("blocks")).first()[0] or 1
    if most == 1:
        return groups, None
    some = (F.col("blocks") > 1) & (F.col("blocks") <= WIDE)
    pivots = buckets.where(some).select("key", F.col("pivot").alias("nid")).join(texts.select("nid", F.col("content").alias("against")), "nid").select("key", "against")
    more, near = _one_pivot(rows.where(some), scratch.save(pivots, "pivots"), q, threshold, scratch)
    if most > WIDE:
        lines = scratch.save(rows.where(F.col("blocks") > WIDE).select("key", "nid", "size", "content"), "large")
        large, connected = _large_groups(lines, q, threshold, scratch)
        more, near = more.unionByName(large), near.unionByName(connected)
    return groups.unionByName(more), near


def verified_links(members: DataFrame, texts: DataFrame, q: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect the lines of each bucket wherever similar ones do."""
    groups, near = bucket_groups(members, texts, q, threshold, scratch)

    def links(table: pa.Table):
        k, i, j, nid = (table.column(x).to_numpy() for x in range(4))
        content = table.column(4).to_pylist()
        heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        first, second = [], []
        for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(k)]):
            a, b = similar_rows(content[low:high], q, threshold)
            if len(a):
                root = local_roots(high - low, a, b)
                moved = np.flatnonzero(root != np.arange(high - low))
                first.append(nid[low + moved])
                second.append(nid[low + root[moved]])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for whole in batches:
            for batch in text_batches(iter([whole]), text=4):
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
                same = np.ones(held.num_rows, dtype=bool)
                for x in range(3):
                    same &= held.column(x).to_numpy() == held.column(x)[-1].as_py()
                cut = int(np.argmax(same))
                if cut:
                    yield from links(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from links(held)
        held = None
        settle()

    found = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint")
    return (found if near is None else found.unionByName(near)).distinct()


def _texts(rows: DataFrame, occ: DataFrame, wanted: DataFrame, scratch: Scratch, broadcast_rows: int) -> DataFrame:
    """(nid, twin, content): the normal form of the wanted lines, each cut from one row."""
    found = occ.where("sig is not null").select("nid", "twin", "doc", "version", "line").join(wanted, "nid")
    found = found.groupBy("nid").agg(F.min(F.struct("doc", "version", "line", "twin")).alias("at")).select("nid", "at.*")
    places = scratch.save(found, "places")
    cut = places.groupBy("doc", "version").agg(F.collect_list(F.struct("line", "nid", "twin")).alias("lines"))
    cut = side(cut, places.count(), broadcast_rows)

    def run(batches):
        for batch in text_batches(batches):
            out = ([], [], [])
            for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = text.split("\n")
                for row in lines:
                    line = normal(parts[row["line"]]) if row["line"] < len(parts) else ""
                    key = _line_key(line)
                    if (int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)) == (row["nid"], row["twin"]):
                        for held, value in zip(out, (row["nid"], row["twin"], line)):
                            held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string()))], ["nid", "twin", "content"])

    cuts = rows.join(cut, ["doc", "version"]).select("doc", "text", "lines").mapInArrow(run, "nid bigint, twin bigint, content string")
    return scratch.save(cuts.dropDuplicates(["nid"]), "texts")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text): version tells texts of one id apart."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.where("doc is not null and text is not null")


def duplicate_lines(docs: DataFrame, q: int = 8, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, broadcast_rows: int = SMALL) -> DataFrame:
    """(doc, version, lines array<int>): for each document that loses lines, their numbers from 0 on; version is
    the xxhash64 of its text.

    Lines are what stands between line feeds; those of white space alone are never removed. Two lines link
    if their normal forms (lower case, white space collapsed) are equal, or if the Jaccard similarity of
    their q-character shingle sets reaches the threshold and MinHash makes them meet. Of each component the
    line with the smallest (id, version, number) stays. Rows with one id and different texts are documents of
    their own; rows equal in both are one document. Rows with a null id or text take no part.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    occ = scratch.save(occurrences(rows, q), "occurrences")
    members = scratch.save(bucket_members(scratch.save(bucket_keys(occ), "keys")), "members")
    scratch.drop("keys")
    texts = _texts(rows, occ, members.select("nid").distinct(), scratch, broadcast_rows)
    joined = scratch.save(connected_components(verified_links(members, texts, q, threshold, scratch), scratch, "links"), "joined")
    at = F.struct("doc", "version", "line")
    plain = occ.groupBy("nid", "twin").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    member = joined.join(texts.select(F.col("nid").alias("node"), "twin"), "node").select(F.col("node").alias("nid"), "twin", "component")
    several = plain.join(member, ["nid", "twin"], "left").where("n > 1 or component is not null")
    several = scratch.save(several.select("nid", "twin", "at", "component"), "several")
    stays = several.where("component is not null").groupBy("component").agg(F.min("at").alias("stay"))
    several = several.join(scratch.save(stays, "stays"), "component", "left").select("nid", "twin", F.coalesce("stay", "at").alias("stay"))
    gone = occ.select("nid", "twin", "doc", "version", "line").join(several, ["nid", "twin"]).where(at != F.col("stay"))
    return gone.groupBy("doc", "version").agg(F.array_sort(F.collect_set("line")).alias("lines"))


#: Tables that nothing reads once the lines to remove are known.
DONE = ("occurrences", "members", "places", "texts", "buckets", "pivots", "judged", "far", "large", "families", "apart", "sides", "sizes", "joined", "several", "stays")


def dedup_lines(docs: DataFrame, q: int = 8, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = SMALL) -> DataFrame:
    """docs with the duplicate lines taken out of text_col, and the column n_removed (a column of that name
    in docs is replaced). Every row stays, if with an empty text; null texts stay null, rows with a null id
    keep their text. See duplicate_lines for what counts as a duplicate. A table of at most broadcast_rows
    removed lines is broadcast; a larger one meets the texts by a shuffle, with the same result."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_removed")
    fields, place = docs.schema.fields, docs.columns.index(text_col)
    gone = scratch.save(duplicate_lines(docs, q, threshold, id_col, text_col, scratch, broadcast_rows), "gone")
    scratch.drop(*DONE)
    lost = gone.agg(F.sum(F.size("lines"))).first()[0] or 0
    plain = docs.toDF(*[f"c{i}" for i in range(len(fields))])  # so that no column clashes with those of `gone`
    same = (plain[f"c{docs.columns.index(id_col)}"] == gone["doc"]) & (F.xxhash64(plain[f"c{place}"]) == gone["version"])
    joined = plain.join(side(gone, lost, broadcast_rows), same, "left").drop("doc", "version")
    names = docs.columns

    def run(batches):
        for batch in text_batches(batches, text=place):
            columns, texts, counts = batch.columns[:-1], [], []
            for text, lines in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if lines and text is not None:
                    drop, parts = set(lines), text.split("\n")
                    kept = [line for i, line in enumerate(parts) if i not in drop]
                    counts.append(len(parts) - len(kept))
                    text = "\n".join(kept) if any(map(str.strip, kept)) else ""
                else:
                    counts.append(0)
                texts.append(text)
            columns[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*names, "n_removed"])

    return joined.mapInArrow(run, StructType([*fields, StructField("n_removed", IntegerType())]))
