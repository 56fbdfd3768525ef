"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import range_of
from .shared import Workspace, map_batches, pieces, table

#: Words of a cell: a paragraph is a line, cut into runs of so many words.
CELL_WORDS = 8
#: Cells of the sketch that is the fingerprint, hashes of a digest, and by how much a failed sketch grows.
SKETCH, HASHES, GROWTH = 24, 3, 4
#: Characters that a task compares at once, and characters that a range of ids aims at.
BATCH_CHARS, RANGE_CHARS = 1 << 18, 1 << 23
#: Ranges for each core at least, ranges at most, and rows drawn for each range to cut by.
RANGES, MOST_RANGES, DRAWN = 4, 1 << 18, 16
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraph cells; the same cell again has a digest of its own."""
    out: dict[bytes, int] = {}
    found = []
    for line in text.split("\n"):
        words = line.split(" ")
        for i in range(0, len(words), CELL_WORDS):
            cell = " ".join(words[i : i + CELL_WORDS]).encode("utf-8", "surrogatepass")
            again = out.get(cell, 0)
            out[cell] = again + 1
            found.append(xxhash.xxh3_64_intdigest(cell, seed=again))
    return np.array(found, np.uint64)


class Sketches:
    """One sketch for each of many documents, in flat arrays: cells of (count, xor of digests, xor of checks)."""

    def __init__(self, cells: np.ndarray, attempt: int = 0):
        self.cells = (np.maximum(cells, HASHES) + HASHES - 1) // HASHES * HASHES
        self.start = np.append(0, np.cumsum(self.cells))
        self.attempt = attempt
        n = int(self.start[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = mix(keys + _U(0x51ED270B))
        part = (self.cells[doc] // HASHES).astype(np.uint64)
        for j in range(HASHES):
            at = self.start[doc] + (part * _U(j)).astype(np.int64) + (mix(keys + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64) + _U(self.attempt)) % part).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells, self.attempt)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, digest, sign) of all that could be recovered, and whether each document's sketch became empty.

        sign is 1 for digests of the first side alone, -1 for those of the second. The sketches are used up.
        """
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        docs, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        # An overfull sketch can, once in a great while, yield a digest that no side has; rounds are bounded for that.
        for _ in range(4 * int(self.cells.max(initial=1)) + 8):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (mix(self.keys + _U(0x51ED270B)) == self.checks))
            if not len(pure):
                break
            order = np.lexsort((self.keys[pure], owner[pure]))
            pure = pure[order]
            new = np.append(True, (owner[pure][1:] != owner[pure][:-1]) | (self.keys[pure][1:] != self.keys[pure][:-1]))
            pure = pure[new]
            d, k, s = owner[pure], self.keys[pure].copy(), self.count[pure].copy()
            self.add(d, k, -s)
            docs.append(d)
            keys.append(k)
            signs.append(s)
        left = np.bincount(owner, (self.count != 0) | (self.keys != 0) | (self.checks != 0), len(self.cells))
        return np.concatenate(docs), np.concatenate(keys), np.concatenate(signs), left == 0


def _flat(sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sides)), [len(x) for x in sides]), np.concatenate([*sides, np.zeros(0, np.uint64)])


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of digest lists, how many digests only the first and only the second have.

    Sketches are subtracted and peeled. Where peeling fails, both are made anew with more cells, at GROWTH
    times as many, and at least as many as could be needed from the third time on, under another hash.
    """
    only_a, only_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    todo, attempt = np.arange(len(a)), 0
    while len(todo):
        need = np.array([len(a[i]) + len(b[i]) for i in todo], np.int64)
        cells = np.full(len(todo), SKETCH, np.int64) if not attempt else np.maximum(SKETCH * GROWTH, 2 * need * attempt) if attempt > 1 else np.maximum(SKETCH * GROWTH, need + need // 2)
        x, y = Sketches(cells, attempt), Sketches(cells, attempt)
        x.add(*_flat([a[i] for i in todo]), 1)
        y.add(*_flat([b[i] for i in todo]), 1)
        doc, _, sign, done = x.minus(y).peel()
        plus, minus = (np.bincount(doc, sign == s, len(todo)).astype(np.int64) for s in (1, -1))
        only_a[todo[done]], only_b[todo[done]] = plus[done], minus[done]
        todo, attempt = todo[~done], attempt + 1
    return only_a, only_b


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of digests, from the recovered difference."""
    only_a, only_b = differences(a, b)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = na - only_a
    return both / np.maximum(1, na + only_b)


def fingerprints(sides: list[np.ndarray]) -> list[str]:
    """Number of digests, a dot, and the sketch of SKETCH cells in base64: equal for equal texts, subtractable else."""
    s = Sketches(np.full(len(sides), SKETCH, np.int64))
    s.add(*_flat(sides), 1)
    raw = np.zeros(len(s.count), np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u4")]))
    raw["n"], raw["k"], raw["c"] = s.count, s.keys, (s.checks & _U(0xFFFFFFFF)).astype(np.uint32)
    return [f"{len(x)}.{base64.b64encode(raw[s.start[i] : s.start[i + 1]].tobytes()).decode()}" for i, x in enumerate(sides)]


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each against the one after it."""
    own = [digests(t) for t in texts]
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    new = [digests(t) for t in changed]
    n = len(changed)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    columns = [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), pa.array(fingerprints(own[:n])), pa.array(fingerprints(new)), pa.array(likeness(own[:n], new)), pa.array(likeness(own[:n], own[1:]))]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, text, peek) in order -> compared rows. A range ends with a peek at the next one's first row."""
    at, ids, texts, size = None, [], [], 0
    for b in pieces(batches, 64):
        for part, i, t, peek in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if part != at:
                if len(texts) > 1:
                    yield _compare(ids, texts)
                at, ids, texts, size = part, [], [], 0
            if peek and not texts:
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > BATCH_CHARS and len(texts) > 1:
                yield _compare(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(t)
    if len(texts) > 1:
        yield _compare(ids, texts)


def fingerprint_versions(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """NAMES for each row of docs; near_edited and near_next compare a text's digests with those of its edited text
    and of the next document.

    Documents are ordered by id, nulls first; rows of one id by the hash of their text. The last one's next is the first.
    A null text is empty; an empty text has one cell, the empty one. A single document is its own next. Repeated rows
    each give a row, and are each other's next. Other columns aren't read. An empty table gives no rows.

    Texts are shuffled once, into ranges of (id, hash, place in the input), each a partition of its own; cuts come from
    a sample, whose size is bounded by MOST_RANGES. So rows of one id, or of none, are dealt over many tasks as well. A copy
    of each range's first row goes to the range before it. A task walks a sorted range with one batch in memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not total.n:
        return ws.spark.createDataFrame([], SCHEMA)
    # By the texts and the cores, not by the number of shuffle partitions: each range is a task and mostly a file, and on local
    # disks Hadoop starts a process for each file that it makes.
    ranges = int(min(MOST_RANGES, max(RANGES * ws.spark.sparkContext.defaultParallelism, total.chars / RANGE_CHARS)))
    key = ["doc_id", "hash", "place"]
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    scale = 1 << 40
    drawn = keyed.where(F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(scale)) < F.lit(min(scale, scale * ranges * DRAWN // total.n))).select(*key).collect()
    drawn.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash, r.place))
    cuts = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else drawn
    literal = lambda r: F.struct(*[F.lit(r[c]).cast("long").alias(c) for c in key])
    placed = keyed.withColumn("key", F.struct(*key)).withColumn("part", range_of(F.struct(*key), [literal(c) for c in cuts]))
    # One row a range: its first key, for the range before it.
    firsts = placed.groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()
    plan = [(before.part, r.first.doc_id, r.first.hash) for r, before in zip(firsts, [firsts[-1], *firsts], strict=False)]
    plan = F.broadcast(ws.spark.createDataFrame(plan, "part int, first long, first_hash long"))
    found = keyed.join(plan, (F.col("hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first")))
    # Rows that are equal in id and text may all match; any of them will do.
    peeks = found.groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("hash").alias("hash"))
    peeks = peeks.select("part", "doc_id", "text", F.lit(True).alias("peek"), "hash", F.lit(0).cast("long").alias("place"))
    both = placed.select("part", "doc_id", "text", F.lit(False).alias("peek"), "hash", "place").unionByName(peeks)
    ordered = both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "peek", F.col("doc_id").asc_nulls_first(), "hash", "place")
    return map_batches(ordered.select("part", "doc_id", "text", "peek"), _walk, SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(Workspace(spark), table(spark, sf_dir, "documents"))
