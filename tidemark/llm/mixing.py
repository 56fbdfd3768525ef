"""Mixing sources to target weights by systematic sampling over a prefix sum of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, table

#: A word of a text; fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources weigh these in turn, in order of their names.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
CAP = 3
#: A document of over target / LEVELS[i] words is of level i.
LEVELS = (4, 16, 64, 256)
#: Rows that one bucket of the prefix sum aims at, and the fewest buckets that large inputs are cut into.
BUCKET_ROWS, BUCKETS = 200_000, 512


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tie_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size): the words that each source is to give.

    Together they give all words; none gives over cap times its size, and what the capped ones leave is shared out by
    weight. In order of cap * size / weight the first sources are the capped ones; the level of the others is what is left
    for one unit of weight. The windows run over one row a source.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("_src")) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "_src").rowsBetween(Window.unboundedPreceding, -1)
    ratio = weighed.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    total = ratio.withColumns({"total": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole)})
    gone = total.withColumns({"gone": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)), "out": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = gone.withColumn("own", (F.col("total") - F.col("gone")).cast("double") / (F.col("weights") - F.col("out")).cast("double"))
    free = F.when(F.col("own") <= F.col("ratio"), F.struct("ratio", "_src", "own"))
    met = level.withColumn("first", F.min(free).over(whole))
    target = F.when(F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first.own"))
    return met.select("_src", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, from 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), source)), 1, 8), 16, 10).cast("double") / 4294967296.0


def level_of(size: Column, target: Column) -> Column:
    """0 for documents of over 1/4 of their source's target, 1 over 1/16, and so on; len(LEVELS) for the rest."""
    out = F.lit(len(LEVELS))
    for i, part in reversed(list(enumerate(LEVELS))):
        out = F.when(size * part > target, i).otherwise(out)
    return out


def crossed(rate: Column, rank: Column, off: Column) -> Column:
    """Whole numbers that the prefix sum of expected copies crosses over the document of a rank."""
    upto = lambda k: F.floor(rate * k.cast("double") + off)
    return (upto(rank) - upto(rank - 1)).cast("long")


def draw(ws: Workspace, docs: DataFrame, columns: list[str], seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, size, tie and the named columns) with source_size, target and copies.

    A source's documents fall into levels by their share of its target. Within a level they are put in the order (size
    class, md5 of doc_id and tie, size, doc_id), each is expected so many times, and is emitted once per whole number that
    the prefix sum of these, plus the source's random offset, crosses over it. Levels are drawn from the largest
    documents to the smallest and each aims at what those before it have left, so the words taken stay near the target
    where few documents make up much of a source.

    The prefix sum runs in two steps, so a source of any size is dealt over many tasks: rows are counted by (source,
    level, size class, leading digits of the md5), with as many digits as the class is large; these counts are summed
    up; then rows are numbered within these buckets. tie (of the text) deals rows of one doc_id, or of none, over buckets.
    Nothing of a document comes to the driver, and what is broadcast is counted first.
    """
    bits = F.bin("size")
    keys = {
        "_src": F.when(F.col("source").isNull(), "~").otherwise(F.concat(F.lit("="), "source")),
        "_cls": F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)),
        "_md5": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "tie"))}
    slim = ws.save(docs.select("doc_id", "source", "size", "tie").withColumns(keys), "sizes")
    total = slim.count()
    goals = ws.hinted(ws.save(targets(slim.groupBy("_src").agg(F.sum("size").alias("source_size"))), "targets"), 64)
    leveled = lambda df: df.join(goals, "_src").withColumn("_level", level_of(F.col("size"), F.col("target")))
    most = max(1.0, total / max(BUCKETS, total / BUCKET_ROWS))
    digits = F.when(F.col("n") > most, F.ceil(F.log(16.0, F.col("n") / most) - 1e-9)).otherwise(0).cast("int")
    # So many leading digits are looked at as there are; 32 digits tell any two documents apart.
    kinds = leveled(slim).groupBy("_src", "_level", "_cls").agg(F.count("*").alias("n"))
    sooner = Window.partitionBy("_src", "_level").orderBy("_cls").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(sooner), F.lit(0))
    plan = ws.hinted(ws.save(kinds.select("_src", "_level", "_cls", F.least(digits, F.lit(32)).alias("_digits"), first.alias("_first")), "plan"), 64)
    by = ["_src", "_level", "_cls", "_bucket"]
    bucketed = lambda df: leveled(df).join(plan, ["_src", "_level", "_cls"]).withColumn("_bucket", F.expr("left(_md5, _digits)"))
    counts = bucketed(slim).groupBy(*by, "_first").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src", "_level", "_cls").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = ws.hinted(ws.save(counts.select(*by, (F.col("_first") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_base")), "bases"), 96)
    within = Window.partitionBy(*by).orderBy("_md5", "size", "doc_id")
    ranked = lambda df: df.withColumn("_k", F.row_number().over(within)).join(bases, by).withColumn("_rank", F.col("_k") + F.col("_base"))

    # Ranks don't depend on rates, so the levels' rates follow from the large documents' ranks, one aggregate a level.
    last = len(LEVELS)
    large = ws.save(ranked(bucketed(slim).where(F.col("_level") < last)).select("_src", "_level", "_rank", F.col("size").alias("_words")), "large")
    state = goals.select("_src", F.col("target").alias("_left"), F.col("source_size").alias("_size"), offset(F.col("_src"), seed).alias("_off"))
    for i in range(last + 1):
        rate = F.when(F.col("_size") > 0, F.least(F.greatest(F.col("_left") / F.col("_size"), F.lit(0.0)), F.lit(float(CAP)))).otherwise(0.0)
        state = state.withColumn(f"_rate{i}", rate)
        if i < last:
            met = state.join(large.where(F.col("_level") == i).drop("_level"), "_src", "left").groupBy(*state.columns)
            took = F.sum(crossed(F.col(f"_rate{i}"), F.col("_rank"), F.col("_off")) * F.col("_words")).cast("double")
            sums = met.agg(F.coalesce(took, F.lit(0.0)).alias("_took"), F.coalesce(F.sum("_words"), F.lit(0)).alias("_gone"))
            state = sums.withColumns({"_left": F.col("_left") - F.col("_took"), "_size": F.col("_size") - F.col("_gone")}).drop("_took", "_gone")
    rates = ws.save(state.select("_src", "_off", F.array(*[F.col(f"_rate{i}") for i in range(last + 1)]).alias("_rates")), "rates")
    drawn = ranked(bucketed(docs.withColumns(keys))).join(ws.hinted(rates, 96), "_src")
    copies = crossed(F.element_at("_rates", F.col("_level") + 1), F.col("_rank"), F.col("_off"))
    return drawn.select(*columns, "size", "source_size", "target", copies.alias("copies"))


def mix(ws: Workspace, docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed documents: every row of docs, with all its columns, as often as the draw says.

    A null text has no words, and a null source is a source, the last. Rows of equal doc_id count as so many
    documents. An empty table gives an empty one. Columns of docs may have any name that doesn't start with
    "__mix_": the draw runs on renamed columns.
    """
    names = [f"__mix_{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    sized = inner.select(*names, F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), size_of(F.col(at["text"])).alias("size"), tie_of(F.col(at["text"])).alias("tie"))
    drawn = draw(ws, sized, names, seed)
    return drawn.where("copies > 0").withColumn("_c", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"), tie_of(F.col("text")).alias("tie"))
    drawn = draw(ws, ws.save(docs, "words"), ["doc_id"])
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _sql(seed: str = "mix") -> str:
    """The same draw over whole tables, without buckets: levels one after the other."""
    head = r"""
WITH s AS (SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS src,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents),
t AS (SELECT src, sum(size)::BIGINT AS source_size FROM s GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM t),
o AS (SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, coalesce(sum(3 * source_size) OVER q, 0) AS gone, coalesce(sum(weight) OVER q, 0) AS out FROM o
      WINDOW q AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - gone)::DOUBLE / (weights - out)::DOUBLE AS level FROM l),
f AS (SELECT (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, src LIMIT 1) AS level, (SELECT min(ratio) FROM v WHERE level <= ratio) AS from_ratio),
g AS (SELECT src, source_size, CASE WHEN f.level IS NULL OR ratio < f.from_ratio THEN (3 * source_size)::DOUBLE ELSE weight * f.level END AS target FROM v, f),
k AS (SELECT *, row_number() OVER (PARTITION BY src, lvl ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || left(bin(size), 3), md5(coalesce(doc_id::VARCHAR, '') || '|' || tie), size, doc_id) AS rank
      FROM (SELECT doc_id, src, size, tie, source_size, target, CASE LEVELS ELSE LAST END AS lvl FROM s JOIN g USING (src))),
r0 AS (SELECT src, target AS remaining, source_size AS size_left FROM g)"""
    head = head.replace("LEVELS", " ".join(f"WHEN size * {p} > target THEN {i}" for i, p in enumerate(LEVELS))).replace("LAST", str(len(LEVELS)))
    for i in range(len(LEVELS) + 1):
        head += f""",
e{i} AS (SELECT k.*, remaining, size_left, CASE WHEN size_left > 0 THEN least(greatest(remaining / size_left, 0), {CAP}) ELSE 0 END AS rate,
  ('0x' || substr(md5('{seed}|' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM k JOIN r{i} USING (src) WHERE lvl = {i}),
d{i} AS (SELECT *, (floor(rate * rank::DOUBLE + off) - floor(rate * (rank - 1)::DOUBLE + off))::BIGINT * size AS taken FROM e{i}),
r{i + 1} AS (SELECT r{i}.src, remaining - coalesce(x.taken, 0) AS remaining, size_left - coalesce(x.size, 0) AS size_left
  FROM r{i} LEFT JOIN (SELECT src, sum(taken)::DOUBLE AS taken, sum(size)::BIGINT AS size FROM d{i} GROUP BY src) x USING (src))"""
    return head + "\n" + " UNION ALL ".join(f"SELECT doc_id, size, source_size, target, taken FROM d{i}" for i in range(len(LEVELS) + 1))


OP9_SQL = _sql()
