"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, collapse, components, map_batches, table

#: Numbers in a block of vectors, and blocks that even small tables are cut into, so that tiles keep all cores busy.
BLOCK_VALUES, LEAST_BLOCKS, LEAST_ROWS = 1 << 21, 10, 512
#: Rows and columns of one product within a tile, and pairs that are recomputed at once.
ROWS, COLUMNS, PAIRS = 1024, 4096, 1 << 16
#: What rounding may add to or take from a cosine that is computed from codes in single precision.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: neither null nor empty nor zero, all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Codes q of unit vectors u, with scales s and bounds: error >= |u - s q| and size >= |s q|."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, size: np.ndarray):
        # Products of int8 codes are whole numbers; single precision holds them exactly up to 2**24.
        self.codes = codes.astype(np.float32 if codes.shape[1] * 127**2 < 1 << 24 else np.float64)
        self.scale, self.error, self.size = scale, error, size

    @classmethod
    def of(cls, u: np.ndarray) -> Quantised:
        scale = np.abs(u).max(axis=1) / 127
        codes = np.rint(u / scale[:, None])
        near = codes * scale[:, None]
        error = np.sqrt(((u - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        return cls(codes, scale, error, np.sqrt((near**2).sum(axis=1)) * (1 + 1e-9))

    def take(self, at: np.ndarray) -> Quantised:
        return Quantised(self.codes[at], self.scale[at], self.error[at], self.size[at])


def possible_pairs(a: Quantised, b: Quantised, least: float, same: bool):
    """(row of a, row of b, whether sure) in pieces, for all pairs whose cosine may be >= least; with same, only those
    with the first before the second.

    For unit u, v near r = s q and t: u.v = r.t + (u - r).t + u.(v - t), so |u.v - r.t| <= error_u |t| + error_v. A pair whose
    product of codes is further below than that can't reach least; one that is as far above is sure to.
    """
    for j in range(0, len(b.scale), COLUMNS):
        right = slice(j, j + COLUMNS)
        error, size = b.error[right].max(), b.size[right].max()
        scale = b.scale[right].astype(b.codes.dtype)
        for i in range(0, min(len(a.scale), j + COLUMNS) if same else len(a.scale), ROWS):
            left = slice(i, i + ROWS)
            product = a.codes[left] @ b.codes[right].T
            product *= scale
            floor = (least - SLACK - a.error[left] * size - error) / a.scale[left]
            x, y = np.nonzero(product >= floor[:, None].astype(product.dtype))
            near, bound = product[x, y] * a.scale[left][x], a.error[left][x] * b.size[right][y] + b.error[right][y]
            good, sure = near + bound >= least - SLACK, near - bound >= least + SLACK
            x, y = x + i, y + j
            if same:
                good &= x < y
            yield x[good], y[good], sure[good]


#: Columns of quantised vectors.
CODES = "node long, weight long, dim int, codes binary, scale double, error double, size double"


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, weight, dim, vector) -> CODES, each vector once."""
    for b in batches:
        dims = b.column(2).to_numpy()
        for dim in np.unique(dims):
            own = b.filter(pa.array(dims == dim))
            q = Quantised.of(unit(own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))))
            raw = pa.Array.from_buffers(pa.binary(int(dim)), own.num_rows, [None, pa.py_buffer(q.codes.astype(np.int8).tobytes())])
            yield pa.RecordBatch.from_arrays([*own.columns[:3], raw.cast(pa.binary()), pa.array(q.scale), pa.array(q.error), pa.array(q.size)], [x.split()[0] for x in CODES.split(", ")])


def _read(rows: pa.Table, dim: int) -> Quantised:
    raw = b"".join(rows.column("codes").to_pylist())
    return Quantised(np.frombuffer(raw, np.int8).reshape(-1, dim), *(rows.column(c).to_numpy() for c in ("scale", "error", "size")))


def _tile(least: float, exact: bool):
    """Tiles of codes -> rows (a, b, n): (a, null, n), that a has n links here; (a, b, null), a forest of the links; without
    exact also (a, null, null), that a has pairs which its codes leave open. With exact the tile has the open nodes alone,
    and their vectors, and decides these pairs in double precision."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key)
        node, weight, block = (rows.column(c).to_numpy() for c in ("node", "weight", "block"))
        whole = _read(rows, dim)
        u = unit(rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) if exact else None
        at = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count, forest, open_ = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], np.zeros(len(node), bool)
        if len(at[0]) and len(at[1]):
            a = whole.take(at[0])
            b = a if i == j else whole.take(at[1])
            for x, y, sure in possible_pairs(a, b, least, i == j):
                x, y = at[0][x], at[1][y]
                if exact:
                    x, y = x[~sure], y[~sure]
                    good = np.zeros(len(x), bool)
                    for k in range(0, len(x), PAIRS):
                        part = slice(k, k + PAIRS)
                        good[part] = np.einsum("ij,ij->i", u[x[part]], u[y[part]]) >= least
                else:
                    good = sure
                    open_[x[~sure]] = open_[y[~sure]] = True
                x, y = x[good], y[good]
                np.add.at(count, x, weight[y])
                np.add.at(count, y, weight[x])
                nodes, roots = collapse(x, y)
                forest.append((nodes[nodes != roots], roots[nodes != roots]))
        x, y = (np.concatenate(f) for f in zip(*forest, strict=True))
        nodes, roots = collapse(x, y)
        x, y = nodes[nodes != roots], roots[nodes != roots]
        linked, left = np.flatnonzero(count), np.flatnonzero(open_)
        return pa.table({
            "i": pa.array(np.full(len(linked) + len(x) + len(left), i, np.int32)), "j": pa.array(np.full(len(linked) + len(x) + len(left), j, np.int32)),
            "a": pa.array(np.concatenate([node[linked], node[x], node[left]]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(node[y], pa.int64()), pa.nulls(len(left), pa.int64())]),
            "n": pa.concat_arrays([pa.array(count[linked], pa.int64()), pa.nulls(len(x) + len(left), pa.int64())]),
        })

    return run


def link_vectors(ws: Workspace, vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Rows are linked by a cosine of at least `least`, computed in double precision. n_links counts the other rows that a row is
    linked with, component_id is the smallest id that links reach, kept marks the row that has it. Vectors that are
    null, empty or zero, or have null or non-finite components, are linked with nothing, as are vectors of different
    lengths with each other. Repeated rows are rows; a null id names no component unless it is alone. Other columns
    aren't read. An empty table gives no rows.

    Equal vectors are one node with a weight, whatever their number. Nodes are quantised once and dealt into blocks by
    hash; each pair of blocks is a tile of codes, done by one task within bounded memory. All pairs are compared, so time
    grows with the square of the nodes, divided by the tasks. A tile returns counts and a forest of the links that codes
    prove, never its pairs, and the nodes with pairs that codes leave open. Only for these do the vectors
    themselves come to a second pass over such tiles, where the open pairs are computed in double precision.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = ws.save(named.select("id", F.when(usable(F.col("vector")), F.col("vector")).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("first"), F.any_value("vector").alias("vector"))
    nodes = ws.save(nodes.withColumn("dim", F.size("vector")), "nodes")
    n, dim = nodes.agg(F.count("*"), F.max("dim")).first()
    plain = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if n:
        blocks = max(-(-n // max(256, BLOCK_VALUES // dim)), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)))
        codes = ws.save(map_batches(nodes.select("node", "weight", "dim", "vector"), _quantise, CODES), "codes")
        dealt = codes.withColumn("block", F.pmod(F.hash("node", F.lit(3)), F.lit(blocks)))
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
        tiles = dealt.select("*", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
        result = "i int, j int, a long, b long, n long"
        first = ws.save(tiles.groupBy("dim", "i", "j").applyInArrow(_tile(least, False), result), "found")
        undecided = first.where("b is null and n is null").select("i", "j", F.col("a").alias("node"))
        second = undecided.join(dealt, "node").join(nodes.select("node", "vector"), "node")
        second = ws.save(second.groupBy("dim", "i", "j").applyInArrow(_tile(least, True), result), "decided")
        found = first.where("b is not null or n is not null").unionByName(second)
        counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        label = components(ws, found.where("b is not null").select("a", "b"))
        known = nodes.join(label, "node", "left").select("node", "weight", "first", F.coalesce("component", "node").alias("component"))
        lowest = ws.save(known.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
        final = ws.save(known.join(lowest, "component").join(counts, "node", "left").select("node", "lowest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links")), "final")
        plain = rows.join(final, "node", "left").select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "id").alias("component_id"))
    return plain.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(Workspace(spark), table(spark, sf_dir, "embeddings"))
