"""Byte-level BPE encoding and decoding by a rank queue over a hierarchical bitmap.

All distinct pre-tokens of a step are laid end to end as one linked list of byte positions. A bucket for
each merge rank holds the positions whose pair has that rank. A three-level bitmap marks the buckets that
hold something, so the next rank is found by find-first-set. A bucket is taken out whole; entries whose
pair has changed since are stale and skipped. Cost follows the bytes, not the square of a piece's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import kept, ragged_take, text_batches

NONE = np.int32(2**31 - 1)


class RankBitmap:
    """Three levels of 64-bit words over ranks; first() is the smallest rank that is set."""

    def __init__(self, n: int):
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def set(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def clear(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))

    def first(self) -> int:
        if not self.top:
            return -1
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        m = (t << 6) + (m & -m).bit_length() - 1
        x = self.low[m]
        return (m << 6) + (x & -x).bit_length() - 1


class Vocabulary:
    """Ranks as read from a rank file, with the tables that merging and decoding need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.size = ranks, regex.compile(pattern), max(ranks.values()) + 1
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values, self.wary = [], [], np.zeros(self.size, dtype=bool)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
                # a merge of one of these parts can create a pair of a lower rank than its own
                for part in (left, right):
                    if part is not None and part > rank:
                        self.wary[part] = True
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order]
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_table = _table(by_id)
        self.decimal_table = _table([b"%d," % i for i in range(self.size)])

    @classmethod
    def load(cls, data: bytes, pattern: str) -> Vocabulary:
        lines = (line.split() for line in data.splitlines() if line)
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece)."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbol = self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(symbol)
        if not n:
            return symbol, sizes
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        # position n is a sentinel that stands for "no neighbour"
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = n
        symbol, pair = np.append(symbol, 0), np.full(n + 1, NONE, dtype=np.int32)
        inner = np.flatnonzero(after[:n] != n)
        pair[inner] = self.pair_rank(symbol[inner], symbol[inner + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.size)

        def push(at: np.ndarray) -> None:
            at = at[pair[at] != NONE]
            if not len(at):
                return
            rank = pair[at]
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                r = int(rank[i])
                if r in buckets:
                    buckets[r].append(at[i:j])
                else:
                    buckets[r] = [at[i:j]]
                    bitmap.set(r)

        push(inner)
        while (r := bitmap.first()) >= 0:
            bitmap.clear(r)
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == r]
            if len(at) > 1:
                if self.wary[r]:
                    head = np.append(True, owner[at[1:]] != owner[at[:-1]])
                    rest = at[~head]
                    at = at[head]
                    if len(rest):
                        buckets[r] = [rest]
                        bitmap.set(r)
                else:  # of overlapping pairs in a run, the first, third, ... merge
                    linked = after[at[:-1]] == at[1:]
                    if linked.any():
                        run = np.append(0, np.where(linked, 0, np.arange(1, len(at))))
                        at = at[(np.arange(len(at)) - np.maximum.accumulate(run)) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            onward = after[gone]
            symbol[at], pair[gone] = r, NONE
            symbol[gone] = -1
            after[at] = onward
            before[onward] = at
            back = before[at]
            pair[at] = np.where(onward != n, self.pair_rank(symbol[at], symbol[onward]), NONE)
            back = back[back != n]
            pair[back] = self.pair_rank(symbol[back], symbol[after[back]])
            push(np.unique(np.concatenate([at, back])))
        alive = symbol[:n] >= 0
        counts = np.bincount(owner[alive], minlength=len(pieces))
        return symbol[:n][alive], counts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; equal pre-tokens of all texts are merged once."""
        index: dict[str, int] = {}
        spots = []
        for text in texts:
            words = self.pattern.findall(text)
            spots.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int32, count=len(words)))
        pieces = [w.encode() for w in index]
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
        split = np.flatnonzero(whole < 0)
        merged, counts = self.merge([pieces[i] for i in split])
        length = np.ones(len(pieces), dtype=np.int64)
        length[split] = counts
        offset = np.cumsum(length) - length
        ids = np.empty(int(length.sum()), dtype=np.int32)
        ids[offset[whole >= 0]] = whole[whole >= 0]
        ids[np.repeat(whole < 0, length)] = merged
        for spot in spots:
            yield ragged_take(ids, offset, length, spot)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(*self.token_table, ids).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        return ragged_take(*self.decimal_table, ids).tobytes()[:-1]


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(length) - length, length


def _vocabulary(data: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    return kept(key, lambda: Vocabulary.load(data, pattern))


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>) for each row of docs; a null or empty text has no ids.

    rank_file is read once, by the driver, and its bytes (a vocabulary, under 2 MB) go to the tasks with
    the function. No shuffle. Repeated rows give repeated rows; other columns are not carried.
    """
    data = open(rank_file, "rb").read()

    def run(batches):
        vocabulary = _vocabulary(data, pattern)
        for batch in text_batches(batches):
            ids = [x for x in vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id, content binary) for each row of ids; null ids decode to no bytes."""
    data = open(rank_file, "rb").read()

    def run(batches):
        vocabulary = _vocabulary(data, pattern)
        for batch in batches:
            content = [vocabulary.decode(np.array(x or [], dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, type=pa.binary())], ["id", "content"])

    kind = encoded.select(id_col).dtypes[0][1]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", step_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row: encodes, decodes the ids, digests both.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded bytes. Null and
    empty texts have no ids and the digests of no bytes. One pass without shuffle; ids stay in the task.
    step_bytes of text share one rank queue; a longer text has a queue of its own.
    """
    data = open(rank_file, "rb").read()

    def run(batches):
        vocabulary = _vocabulary(data, pattern)
        for batch in text_batches(batches, limit=step_bytes):
            counts, ids_sha, text_sha = [], [], []
            for ids in vocabulary.encode([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(vocabulary.decimals(ids)).hexdigest())
                text_sha.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(ids_sha, type=pa.string()), pa.array(text_sha, type=pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).dtypes[0][1]
    out = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, out).withColumnRenamed("id", id_col)
