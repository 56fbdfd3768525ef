"""Metrics, slow-query logs and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of histogram buckets in milliseconds; fixed values. A last bucket without bound follows.
HISTOGRAM_BOUNDS = (0.5, 1, 2, 5, 10, 25, 50, 100, 250, 500, 1000)
#: Bounds of timer buckets in milliseconds; fixed values.
TIMER_BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises: some 4096 to an e-fold, so the values of a bucket are close. NaN is last."""
    logs = F.floor(F.signum(value) * F.log1p(F.least(F.abs(value), F.lit(1e300)) * 1048576.0) * 4096.0).cast("long")
    return F.when(F.isnan(value), F.lit(1 << 62)).otherwise(logs)


def at_ranks(samples: DataFrame, series: str, value: str, ranks: list[tuple[object, Column]]) -> DataFrame:
    """(series, name, value): the sample at each rank (name, rank from 0 as a column of _total) in ascending order.

    Samples are counted by bucket, and the buckets of a series summed up to find those that hold the ranks. Only their
    samples are put in order, so no task orders a series.
    """
    known = samples.where(F.col(value).isNotNull()).select(series, F.col(value).alias("_v"), _bucket(F.col(value).cast("double")).alias("_b"))
    counts = known.groupBy(series, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(series)
    up = counts.withColumn("_total", F.sum("_n").over(w)).withColumn("_to", F.sum("_n").over(w.orderBy("_b")))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks])
    held = up.withColumn("_w", F.explode(wanted)).select("*", "_w.*").where("_rank >= _to - _n and _rank < _to")
    inside = known.join(held.select(series, "_b", "_name", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank")), [series, "_b"])
    each = inside.groupBy(series, "_b", "_name", "_rank", "_v").agg(F.count("*").alias("_n"))
    run = each.withColumn("_to", F.sum("_n").over(Window.partitionBy(series, "_b", "_name").orderBy("_v")))
    return run.where("_rank >= _to - _n and _rank < _to").select(series, F.col("_name").alias("name"), F.col("_v").alias("value"))


def percentiles(samples: DataFrame, series: str, value: str, wanted: list[float], newest: tuple[str, int] | None = None) -> DataFrame:
    """(series, p, value): the sample of rank min(floor(n p / 100), n - 1), from 0, of each series.

    newest (column, n): only the n rows of each series with the largest values of a column that has no ties.
    """
    if newest:
        order, n = newest
        first = at_ranks(samples, series, order, [(0, F.greatest(F.col("_total") - n, F.lit(0)))]).select(series, F.col("value").alias("_first"))
        samples = samples.join(first, series).where(F.col(order) >= F.col("_first"))
    total = F.col("_total")
    return at_ranks(samples, series, value, [(float(p), F.least(F.floor(total * p / 100), total - 1)) for p in wanted]).withColumnRenamed("name", "p")


def bucket_of(value: Column, bounds: tuple) -> Column:
    """The first bound that is not below the value; null beyond the last."""
    out = F.lit(None).cast("double")
    for b in reversed(bounds):
        out = F.when(value <= float(b), F.lit(float(b))).otherwise(out)
    return out


def histogram(samples: DataFrame, series: str, value: str, bounds: tuple = HISTOGRAM_BOUNDS) -> DataFrame:
    """(series, le, n): samples by bucket, each in one; le is null beyond the last bound. Empty buckets have no row."""
    return samples.groupBy(series, bucket_of(F.col(value), bounds).alias("le")).agg(F.count("*").alias("n"))


def histogram_cumulative(samples: DataFrame, series: str, value: str, bounds: tuple = HISTOGRAM_BOUNDS) -> DataFrame:
    """(series, le, n): samples that are at most le, for every bound."""
    sums = [F.count_if(F.col(value) <= float(b)).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(series).agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select(series, F.inline(rows))


def percentile_by_bucket(samples: DataFrame, series: str, value: str, p: float, bounds: tuple = TIMER_BOUNDS) -> DataFrame:
    """(series, value): the first bound with at least ceil(p n) samples at or under it; the largest sample beyond the last."""
    sums = [F.count_if(F.col(value) <= float(b)).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(series).agg(F.ceil(F.count("*") * F.lit(p)).alias("_need"), F.max(value).alias("_max"), *sums)
    out = F.col("_max")
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(F.col(f"_{i}") >= F.col("_need"), F.lit(float(b))).otherwise(out)
    return wide.select(series, out.alias("value"))


def selectivity(returned: Column, examined: Column) -> Column:
    """Rows returned of those examined; 1 where none was examined."""
    return F.when(examined == 0, F.lit(1.0)).otherwise(returned.cast("double") / examined)


def slow_summary(log: DataFrame) -> DataFrame:
    """Total, largest and mean duration and plans of a slow log (duration_ms, plan)."""
    return log.agg(
        F.count("*").alias("total"), F.max("duration_ms").alias("max_ms"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"),
        F.count_if(F.col("plan") == "FULL_SCAN").alias("full_scans"), F.count_if(F.col("plan") == "INDEX_SCAN").alias("index_scans"))


def trace_durations(spans: DataFrame) -> DataFrame:
    """(trace, spans, start_us, duration_us): from the first start to the last end."""
    return spans.groupBy("trace").agg(F.count("*").alias("spans"), F.min("start_us").alias("start_us"), (F.max("end_us") - F.min("start_us")).alias("duration_us"))


def span_offsets(spans: DataFrame) -> DataFrame:
    """(trace, span, offset_us, duration_us, total_us): each span from its trace's first start, and how long the trace is."""
    w = Window.partitionBy("trace")
    start, end = F.min("start_us").over(w), F.max("end_us").over(w)
    return spans.select("trace", "span", (F.col("start_us") - start).alias("offset_us"), (F.col("end_us") - F.col("start_us")).alias("duration_us"), (end - start).alias("total_us"))


def waterfall(offsets: DataFrame, width: int = 40) -> DataFrame:
    """offsets with a bar of up to width characters: blanks up to the span's start, blocks for its length, one at least."""
    total = F.when(F.col("total_us") == 0, F.lit(1)).otherwise(F.col("total_us"))
    part = lambda c: F.floor(F.col(c) / total * width).cast("int")
    return offsets.withColumn("bar", F.concat(F.repeat(F.lit(" "), part("offset_us")), F.repeat(F.lit("\u2588"), F.greatest(F.lit(1), part("duration_us")))))
