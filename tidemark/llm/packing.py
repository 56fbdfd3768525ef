"""Packing of token streams into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, pieces, table

CAPACITY = 1024
END_ID = 0
#: So many pieces of remainders are packed together.
BATCH = 1536


#: Tokens that the vocabulary has besides its ranks; fixed values. Their strings in a text are these tokens.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=1)
def encoder(ranks_name: str = "byte_bpe_50k.tiktoken"):
    """Encoder of the public byte-level vocabulary, one for a worker. encode() gives a text's ids.

    The ranks file holds the same vocabulary as byte_bpe_50k.json and gives the same ids, several times faster.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def ids_of(text: str | None) -> np.ndarray:
    """The ids of a whole text, as the vocabulary's own tokenizer gives them."""
    return encoder().encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """The window of each item, and the fullest window's sum: multiway largest differencing.

    Each item starts as a partial partition of its own. The two partitions of the largest imbalance are merged, the
    fullest window of one onto the emptiest of the other, until one is left. What a window holds is a tree of merges.
    """
    n = len(sizes)
    sums = np.zeros((n, windows), np.int64)
    tree = np.full((n, windows), -1, np.int64)
    sums[:, -1], tree[:, -1] = sizes, np.arange(n)
    left, right, made = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total, x, y = sums[a] + sums[b][::-1], tree[a], tree[b][::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        left[made : made + len(both)], right[made : made + len(both)] = x[both], y[both]
        merged = np.maximum(x, y)
        merged[both] = n + made + np.arange(len(both))
        made += len(both)
        order = np.argsort(total, kind="stable")
        sums[a], tree[a] = total[order], merged[order]
        heapq.heappush(heap, (int(sums[a, 0] - sums[a, -1]), a))
    last = heap[0][1]
    window = np.full(n + made, -1, np.int64)
    held = tree[last] >= 0
    window[tree[last][held]] = np.flatnonzero(held)
    for i in range(made - 1, -1, -1):
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n], int(sums[last, -1])


class Packer:
    """Packs documents as they come. take() and close() return pieces (row, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, batch: int = BATCH):
        self.sequence, self.capacity, self.batch = first_sequence, capacity, batch
        self.rest: list[tuple] = []

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def take(self, row: object, ids: np.ndarray) -> list[tuple]:
        """Whole windows of a document at once; its remainder waits, in pieces of at most half a window."""
        full, half = len(ids) // self.capacity * self.capacity, self.capacity // 2
        out = [(row, i, self.capacity, zlib.crc32(ids[i : i + self.capacity]), len(ids), self._next(), 0) for i in range(0, full, self.capacity)]
        for i in range(full, len(ids), half):
            self.rest.append((row, i, min(half, len(ids) - i), zlib.crc32(ids[i : i + half]), len(ids)))
        return out + (self.close() if len(self.rest) >= self.batch else [])

    def close(self) -> list[tuple]:
        """Packs what waits: windows are opened until differencing leaves none over capacity."""
        if not self.rest:
            return []
        sizes = np.array([p[2] for p in self.rest])
        windows = -(-int(sizes.sum()) // self.capacity)
        while True:
            at, most = difference(sizes, windows)
            if most <= self.capacity:
                break
            windows += 1
        first, filled, out = self.sequence, [0] * windows, []
        for p, w in zip(self.rest, at.tolist(), strict=True):
            out.append((*p, first + w, filled[w]))
            filled[w] += p[2]
        self.sequence += windows
        self.rest = []
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of docs.

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Each id lies in exactly one piece.
    Full windows of a document are sequences of their own; remainders, cut at half a window at most, are packed
    in batches of BATCH pieces into near-equal windows, each padded to capacity. Every task packs its own rows, so there is no
    shuffle and a task holds one batch; sequences are numbered within the task's range, and a rerun over the same
    partitions gives the same result. Repeated rows are packed as often as they come. Other columns aren't read. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        id_type: pa.DataType | None = None

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in pieces(batches):
            id_type = b.schema.field(0).type
            out: list[tuple] = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += packer.take(row, np.append(ids_of(text), END_ID).astype("<u4"))
            if out:
                yield batch(out)
        if out := packer.close():
            yield batch(out)

    return map_batches(rows, run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
