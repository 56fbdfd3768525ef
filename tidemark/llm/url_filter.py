"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of filter for a listed URL, bits set for each, and the most filter that is broadcast.
BITS_PER_URL, PROBES, MAX_BROADCAST_MB = 16, 4, 64
#: The most distinct (labels in host, characters in path) of listed URLs; a list beyond it is refused.
MAX_SHAPES = 4096


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host follows the first :// and is lower-cased in A-Z; the path ends before ? or #."""
    at = F.coalesce(F.locate("://", url), F.lit(0)) if isinstance(url, str) else F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A list of (verdict, rule) as rows; a rule reads host/path."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "verdict string, rule string")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key_host", "key_path"), F.lit(blocks))


def _mask() -> Column:
    """The bits of a key within the 64-bit word of its block."""
    h = F.xxhash64("key_path", "key_host", F.lit(7))
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of pages: the longest rule that fits, else null and default.

    rules: (verdict, rule); a rule fits its host and all subdomains where the path starts with the rule's. Keys that
    could be listed are made from each URL (suffixes of its host, prefixes of its path, in the shapes that the list
    has). The Bloom filter drops nearly all that aren't listed; an exact hash join drops the rest. The filter and the
    list are broadcast below MAX_BROADCAST_MB, by their counted sizes, and joined by a shuffle beyond.

    A null URL, or one without ://, has an empty host and path and fits no rule. Repeated rows each give a row; a
    null id is kept. Of equal rules the largest verdict (block) holds. Only the two named columns are read, so others
    can't clash. Empty tables give no rows; an empty list gives default everywhere.
    """
    base_host, base_path = canonical(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), base_host.alias("host"), base_path.alias("path"))
    parts = rules.select("verdict", "rule", F.locate("/", "rule").alias("at")).where("rule is not null and at > 0").select(
        "verdict", "rule", F.translate(F.expr("substring(rule, 1, at - 1)"), UPPER, LOWER).alias("key_host"), F.expr("substring(rule, at)").alias("key_path"))
    shape = F.struct(F.size(F.split("key_host", "\\.")).alias("labels"), F.length("key_path").alias("chars"))
    n, shapes = parts.agg(F.count("*"), F.collect_set(shape)).first()
    if not n:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"the listed URLs have {len(shapes)} shapes; at most {MAX_SHAPES} are supported")
    blocks = max(1, -(-n * BITS_PER_URL // 64))
    small = lambda df, rows, each: F.broadcast(df) if rows * each <= MAX_BROADCAST_MB << 20 else df
    words = parts.select(_block(blocks).alias("block"), _mask().alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))

    literal = F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(shapes)])
    fits = F.filter(literal, lambda s: (s["labels"] <= F.size(F.split("host", "\\."))) & (s["chars"] <= F.length("path")))
    keys = F.transform(fits, lambda s: F.struct(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]).alias("key_host"), F.substring(F.col("path"), F.lit(1), s["chars"]).alias("key_path")))
    tried = base.select("id", "host", "path", F.explode(keys).alias("k")).select("id", "host", "path", "k.*")
    possible = tried.withColumns({"block": _block(blocks), "mask": _mask()}).join(small(words, min(n, blocks), 16), "block").where("word & mask = mask")
    exact = small(parts.groupBy("key_host", "key_path").agg(F.max(F.struct("verdict", "rule")).alias("r")), n, 512)
    hits = possible.join(exact, ["key_host", "key_path"]).select("id", "host", "path", F.lit(0).alias("n"), F.struct(F.length("r.rule").alias("chars"), "r.rule", "r.verdict").alias("best"))
    alone = base.select("id", "host", "path", F.lit(1).alias("n"), F.lit(None).cast("struct<chars:int,rule:string,verdict:string>").alias("best"))
    met = alone.unionByName(hits).groupBy("id", "host", "path").agg(F.sum("n").cast("int").alias("n"), F.max("best").alias("best"))
    each = met.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    return each.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules that op3's contract fixes.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), listed(spark, RULES))


OP3_SQL = """
WITH rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
r AS (SELECT verdict, rule, substr(rule, 1, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
b AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT b.*, r.rule, r.verdict, row_number() OVER (PARTITION BY b.n ORDER BY length(r.rule) DESC) AS k
      FROM b LEFT JOIN r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
