"""Queries over a version log: one row (key, commit_ts, value, is_deleted) for each write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import range_of

#: Rows of a log or of a sorted file that one task numbers, and the most ranges that a file is cut into.
RANGE_ROWS, MOST_RANGES = 1_000_000, 1 << 16
#: Rows up to which a table of ranges is broadcast.
BROADCAST_ROWS = 200_000


def newest(log: DataFrame, keys: list[str], order: str = "commit_ts") -> DataFrame:
    """The newest row of each key. A partial maximum runs before the shuffle, so hot keys send one row per task."""
    rest = [c for c in log.columns if c not in keys and c != order]
    row = F.max(F.struct(order, *rest)).alias("_row")
    return log.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*log.columns)


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """The newest version of each key at or before ts, deletions included. The bound on ts reaches the scan."""
    return newest(log.where(F.col("commit_ts") <= ts), ["key"])


def snapshot(log: DataFrame, ts: int, low: object = None, high: object = None) -> DataFrame:
    """Live rows (key, value, commit_ts) at ts, with keys in low..high, both included."""
    if low is not None:
        log = log.where(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.where(F.col("key") <= F.lit(high))
    return as_of(log, ts).where(~F.col("is_deleted")).select("key", "value", "commit_ts")


def read_at(log: DataFrame, key: object, ts: int) -> DataFrame:
    """The value of one key at ts: no row where it is missing or deleted."""
    return snapshot(log.where(F.col("key") == F.lit(key)), ts).select("key", "value")


def overlay(log: DataFrame, staged: DataFrame, ts: int) -> DataFrame:
    """What a transaction sees: its snapshot at ts, with its own writes staged (key, value, is_deleted) on top."""
    base = log.where(F.col("commit_ts") <= ts).select("key", F.lit(0).alias("own"), "commit_ts", "value", "is_deleted")
    own = staged.select("key", F.lit(1).alias("own"), F.lit(None).cast("long").alias("commit_ts"), "value", "is_deleted")
    both = base.unionByName(own)
    top = both.groupBy("key").agg(F.max(F.struct("own", "commit_ts", "value", "is_deleted")).alias("r"))
    return top.where("not r.is_deleted").select("key", "r.value")


def conflicts(log: DataFrame, staged_keys: DataFrame, read_ts: int) -> DataFrame:
    """Staged keys that someone committed after read_ts, with the newest such commit: the first committer has won."""
    later = log.where(F.col("commit_ts") > read_ts).groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    return staged_keys.select("key").distinct().join(later, "key")


def vacuum(log: DataFrame, low_water: int) -> DataFrame:
    """The log without versions that no snapshot at or after low_water can see.

    At or below low_water the newest version of each key stays, a deletion too; above it all stay.
    """
    kept = newest(log.where(F.col("commit_ts") <= low_water), ["key"])
    return log.where(F.col("commit_ts") > low_water).unionByName(kept)


def compact(log: DataFrame) -> DataFrame:
    """The newest version of each key, without deleted ones: all levels merged into the last."""
    return newest(log, ["key"]).where(~F.col("is_deleted"))


def merge(sources: list[DataFrame]) -> DataFrame:
    """(key, value, is_deleted) of several sources, the first being the newest: for each key the newest source's row, if live."""
    tagged = [s.select("key", F.lit(-i).alias("age"), "value", "is_deleted") for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return newest(both, ["key"], "age").where(~F.col("is_deleted")).select("key", "value")


def store_stats(log: DataFrame, committed: Column) -> DataFrame:
    """Keys, versions, newest transaction, and how many transactions are open and committed."""
    return log.agg(
        F.countDistinct("key").alias("keys"), F.count("*").alias("versions"), F.max("commit_ts").alias("max_txid"),
        F.countDistinct(F.when(~committed, F.col("commit_ts"))).alias("active"), F.countDistinct(F.when(committed, F.col("commit_ts"))).alias("committed"))


def replay(entries: DataFrame) -> DataFrame:
    """Live (key, value) after replaying log entries (seq, op, key, val); op is SET, DELETE, BEGIN or COMMIT.

    A write counts unless the BEGIN or COMMIT before it is a BEGIN and the one after it isn't a COMMIT. The log is cut into
    ranges of seq. Within a range a window finds both; what reaches over a range's ends comes from one row a range,
    its first and last BEGIN or COMMIT. So the log is shuffled once, and no task has more than its range.
    """
    framing = F.col("op").isin("BEGIN", "COMMIT")
    span = entries.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n")).first()
    ranges = max(1, -(-span.n // RANGE_ROWS))
    width = max(1, -(-((span.high or 0) - (span.low or 0) + 1) // ranges))
    dealt = entries.withColumn("_range", F.floor((F.col("seq") - (span.low or 0)) / width))
    frame = F.when(framing, F.col("op"))
    prior, later = F.lit(None).cast("string"), F.lit(None).cast("string")
    if ranges > 1:
        ends = dealt.where(framing).groupBy("_range").agg(F.max_by("op", "seq").alias("last"), F.min_by("op", "seq").alias("first"))
        ends = entries.sparkSession.range(ranges).select(F.col("id").alias("_range")).join(ends, "_range", "left")
        # One row a range, over the few columns that reach into the others.
        w = Window.orderBy("_range")
        ends = ends.withColumn("_prior", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        back = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_later", F.last("first", True).over(back)).select("_range", "_prior", "_later")
        dealt = dealt.join(F.broadcast(ends) if ranges <= BROADCAST_ROWS else ends, "_range")
        prior, later = F.col("_prior"), F.col("_later")
    at = Window.partitionBy("_range")
    # Both windows begin at an end and grow: one that shrinks is read anew for each row, so costs the square of a range.
    near = lambda *order: F.last(frame, True).over(at.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    seen = dealt.withColumn("_before", F.coalesce(near("seq"), prior))
    seen = seen.withColumn("_after", F.coalesce(near(F.desc("seq")), later))
    counted = seen.where(F.col("op").isin("SET", "DELETE") & (~F.col("_before").eqNullSafe("BEGIN") | F.col("_after").eqNullSafe("COMMIT")))
    last = counted.groupBy("key").agg(F.max(F.struct("seq", "op", "val")).alias("r"))
    return last.where("r.op = 'SET'").select("key", F.col("r.val").alias("value"))


def sparse_index(rows: DataFrame, key: str, every: int) -> DataFrame:
    """Every so manieth key of a sorted file, from the first, with its place.

    The file is cut into ranges of keys, by a sample; places come from the counts of the ranges before, so no task sorts more
    than a range, however the keys begin.
    """
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    scale, cuts = 1 << 40, []
    if ranges > 1:
        drawn = rows.select(key).where(F.pmod(F.xxhash64(key), F.lit(scale)) < F.lit(min(scale, scale * 32 * ranges // n))).orderBy(key).collect()
        cuts = [drawn[i * len(drawn) // ranges][0] for i in range(1, ranges)] if len(drawn) >= ranges else [r[0] for r in drawn]
    dealt = rows.select(key).withColumn("_range", range_of(F.col(key), [F.lit(c) for c in cuts]))
    counts, bases, total = {r._range: r.n for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}, [], 0
    for k in sorted(counts):
        bases.append((k, total))
        total += counts[k]
    # At most MOST_RANGES rows.
    known = rows.sparkSession.createDataFrame(bases, "_range int, _base long")
    placed = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(key))).join(F.broadcast(known), "_range")
    return placed.withColumn("position", F.col("_base") + F.col("_k") - 1).where(F.col("position") % every == 0).select(key, "position")


def locks(requests: DataFrame, held: DataFrame) -> DataFrame:
    """requests (txn, key, mode) with granted, given held locks (txn, key, mode); mode is S or X.

    S is granted unless another transaction holds X, X unless another one holds anything. A transaction may so raise its own
    S to X where it is alone.
    """
    x = F.when(F.col("mode") == "X", F.col("txn"))
    by = held.groupBy("key").agg(F.min("txn").alias("_low"), F.max("txn").alias("_high"), F.min(x).alias("_xlow"), F.max(x).alias("_xhigh"))
    free = lambda low, high: F.col(low).isNull() | ((F.col(low) == F.col("txn")) & (F.col(high) == F.col("txn")))
    granted = F.when(F.col("mode") == "S", free("_xlow", "_xhigh")).otherwise(free("_low", "_high"))
    return requests.join(by, "key", "left").select("txn", "key", "mode", granted.alias("granted"))


def hybrid_clock(events: DataFrame, node: str, order: str, wall: str) -> DataFrame:
    """events with hlc: each node's clock gives the wall time, or one more than what it gave last if that isn't later.

    The j-th reading is the largest of wall_i + (j - i) over all i up to j, and at least j: a running maximum.
    """
    by = Window.partitionBy(node).orderBy(order)
    ranked = events.withColumn("_j", F.row_number().over(by))
    ahead = F.max(F.col(wall) - F.col("_j")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("hlc", F.col("_j") + F.greatest(ahead, F.lit(0))).drop("_j")


def memtable_size(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Characters of all keys and values."""
    return rows.agg(F.coalesce(F.sum(F.length(key) + F.coalesce(F.length(value), F.lit(0))), F.lit(0)).cast("long").alias("size"))
