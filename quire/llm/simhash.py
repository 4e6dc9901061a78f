"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

A fingerprint has eight positional bytes. Two fingerprints with at most three differing bits differ in at
most three bytes, so they share at least five of the eight. A posting list for each single byte would hold
1/256 of all rows, so the index posts three positions at once: split the eight positions into two halves
of four; of any five shared positions, three lie in one half. The eight triples of the halves therefore
meet every such pair. For each pair that meets, the shared positional bytes are tallied, pairs below the
guaranteed five are dropped, and the rest are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SMALL, Scratch, connected_components, local_roots, side, text_batches

BITS, BYTES = 64, 8
#: Byte positions that are posted together.
TRIPLES = tuple(t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3))
#: Rows of a posting list that are compared at once; longer lists are split and compared block by block.
TILE = 1024
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the word shingles of a text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.append(0, ends[:-1])[: len(words) - size + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), dtype=np.uint64, count=len(starts))
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist()))


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) for each row: the fingerprint's 64 bits as a signed number. Null counts as empty."""

    def run(batches):
        for batch in text_batches(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    schema = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("fp")).schema
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _linked(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal group (rows sorted by it) within `bits` bits, by count filter and verification."""
    first, second = [], []
    rows = np.arange(len(fp))
    step = 1
    while True:
        rows = rows[rows < len(fp) - step]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        other = (fp[rows] ^ fp[rows + step]).view(np.uint8).reshape(-1, BYTES)
        tally = (other == 0).sum(axis=1) >= BYTES - bits
        near = rows[tally][_ONES[other[tally]].sum(axis=1) <= bits]
        first.append(near)
        second.append(near + step)
        step += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (rows, rows)


def fingerprint_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between representatives of distinct fingerprints that connect all near ones.

    prints: (fp, rep), fp distinct. Every pair within `bits` bits (3 at most) is compared where its
    posting lists meet; what is returned of each list is a spanning forest of its links, not all pairs.
    A list of more than TILE rows is dealt into blocks, and each pair of blocks is a group of its own, so
    no group grows with the data.
    """
    if bits > 3:
        raise ValueError("the triples meet every pair of at most 3 differing bits")
    part = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = [F.lit(n << 24) + F.shiftleft(part[a], 16) + F.shiftleft(part[b], 8) + part[c] for n, (a, b, c) in enumerate(TRIPLES)]
    posted = prints.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    full = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = posted.join(full, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "rep")

    def run(batches):
        held: pa.Table | None = None

        def edges(table: pa.Table) -> pa.RecordBatch:
            k, i, j, fp, rep = (table.column(c).to_numpy() for c in range(5))
            change = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            a, b = _linked(np.cumsum(change), fp, bits)
            root = local_roots(len(fp), a, b)
            low = rep[root]
            return pa.RecordBatch.from_arrays([pa.array(rep[rep != low]), pa.array(low[rep != low])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = [held.column(c)[-1].as_py() for c in range(3)]
            same = np.ones(held.num_rows, dtype=bool)
            for c in range(3):
                same &= held.column(c).to_numpy() == last[c]
            cut = int(np.argmax(same))
            if cut:
                yield edges(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held)

    sort = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sort.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id reachable over links.

    Two rows link if their fingerprints differ in `bits` bits or fewer. Equal fingerprints collapse to
    their smallest id before anything is compared, so a group of copies costs one row. Null and empty
    texts have fingerprint 0 and link like any other; rows with a null id get component null. Repeated
    ids give repeated rows. Empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.save(simhash(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "marks")
    reps = scratch.save(marks.where("id is not null").groupBy("fp").agg(F.min("id").cast("bigint").alias("rep")), "reps")
    joined = connected_components(fingerprint_links(reps, bits), scratch)
    owner = reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    found = marks.join(owner, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return found.withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = SMALL) -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the smallest (id, xxhash64 of the text).

    Documents are rows with an id, told apart by id and text (null as empty): rows equal in both are one and
    stay or go together. Rows with a null id stay. A table of at most broadcast_rows documents that go is
    broadcast; a larger one meets docs by a shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    version = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), version.alias("version")).alias("row"), F.col(text_col).alias("text"))
    marks = scratch.save(simhash(rows, shingle, "row", "text"), "marks")
    prints = scratch.save(marks.select("fp", F.col("fp").alias("rep")).distinct(), "prints")
    joined = scratch.save(connected_components(fingerprint_links(prints, bits), scratch), "joined")
    groups = marks.join(joined, marks.fp == joined.node, "left").select("row", F.coalesce("component", "fp").alias("group"))
    stays = scratch.save(groups.groupBy("group").agg(F.min("row").alias("stay"), F.count("*").alias("n")).where("n > 1").select("group", "stay"), "stays")
    gone = groups.join(stays, "group").where("row <> stay").select("row.id", "row.version").distinct()
    gone = scratch.save(gone, "gone")
    scratch.drop("marks", "prints", "joined", "stays")
    return docs.join(side(gone, gone.count(), broadcast_rows), (docs[id_col] == gone["id"]) & (version == gone["version"]), "left_anti")
