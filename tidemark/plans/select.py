"""Scans, projections, predicates, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksum, filter_positions, modulo_placement, ring_hash, ring_hash_signed, row_encoding, sortable_float, sortable_int, sortable_text
from .base import Registry, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _simple(name: str, source: str, columns: list[str], where: str | None = None, sql_where: str | None = None) -> None:
    """A projection with a filter; both reach the scan."""
    sql = f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {sql_where or where}" if where else "")

    @_R.add(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return (df.where(where) if where else df).select(*columns)


_simple("scan_full", "orders", ["*"])
_simple("project_star", "customer", ["*"])
_simple("project_cols", "lineitem", LINE)
_simple("index_range_gt", "lineitem", LINE, "l_quantity > 45")
_simple("index_eq", "lineitem", LINE, "l_quantity = 17")
_simple("filter_eq", "customer", ["c_custkey", "c_name"], "c_mktsegment = 'BUILDING'")
_simple("filter_neq", "orders", ["o_orderkey", "o_orderstatus"], "o_orderstatus != 'F'")
_simple("filter_range", "part", ["p_partkey", "p_size", "p_retailprice"], "p_size >= 10 AND p_size < 20 AND p_retailprice <= 2000")
_simple("filter_and", "lineitem", LINE, "l_discount > 0.05 AND l_quantity < 24 AND l_returnflag = 'R'")
_simple("filter_or", "orders", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'P' OR o_totalprice > 250000")
_simple("filter_not", "orders", ["o_orderkey", "o_orderstatus"], "NOT o_orderstatus = 'O'")
_simple("filter_paren", "lineitem", LINE, "(l_quantity > 40 OR l_quantity < 5) AND NOT (l_linestatus = 'F' OR l_tax > 0.04)")
_simple("filter_colcol", "lineitem", LINE, "l_partkey < l_suppkey * 10 AND l_orderkey > l_partkey")
_simple("filter_like", "part", ["p_partkey", "p_name", "p_type"], "p_name LIKE '%a%' AND p_brand LIKE 'Brand#_3'")
_simple("filter_coerce", "orders", ["o_orderkey", "o_orderpriority"], "try_cast(substring(o_orderpriority, 1, 1) AS DOUBLE) <= 2")
def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


@_R.add("kv_scan", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000900' ORDER BY 1")
def kv_scan(spark, sf_dir):
    return _pairs(spark, sf_dir).where("key BETWEEN 'Customer#000000010' AND 'Customer#000000900'").orderBy("key")


@_R.add("kv_findval", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
def kv_findval(spark, sf_dir):
    return _pairs(spark, sf_dir).where("value BETWEEN 'B' AND 'G'")


@_R.add("kv_get", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def kv_get(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_name") == c.agg(F.min("c_name")).first()[0]).select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


#: Nulls come last in ascending and first in descending order; ties are broken by all selected columns.
@_R.add("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey")
def sort_asc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").asc_nulls_last(), "o_orderkey")


@_R.add("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey")
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_first(), "o_orderkey")


@_R.add("sort_hidden_col", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 50")
def sort_hidden_col(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc_nulls_first(), "c_custkey").limit(50).select("c_custkey", "c_name")


@_R.add("limit_n", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 7")
def limit_n(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey").limit(7)


@_R.add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 49 ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 10")
def topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.col("l_extendedprice").desc_nulls_first(), "l_orderkey", "l_linenumber").limit(10)


@_R.add("ring_hash", "SELECT c_name, ('0x' || substr(md5(c_name), 25, 8))::BIGINT AS position FROM customer")
def ring_hash_query(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", ring_hash("c_name").alias("position"))


@_R.add("ring_hash_signed", "SELECT c_name, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS position FROM (SELECT c_name, ('0x' || substr(md5(c_name), 1, 8))::BIGINT::HUGEINT * 4294967296 + ('0x' || substr(md5(c_name), 9, 8))::BIGINT AS h FROM customer)")
def ring_hash_signed_query(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", ring_hash_signed("c_name").alias("position"))


@_R.add("modulo_placement", "SELECT c_name, ((((h1 % 3 * 1 + h2) % 3 * 1 + h3) % 3 * 1 + h4) % 3)::BIGINT AS node3, (h4 % 4)::BIGINT AS node4 FROM (SELECT c_name, ('0x' || substr(md5(c_name), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(c_name), 9, 8))::BIGINT AS h2, ('0x' || substr(md5(c_name), 17, 8))::BIGINT AS h3, ('0x' || substr(md5(c_name), 25, 8))::BIGINT AS h4 FROM customer)")
def modulo_query(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", modulo_placement("c_name", 3).alias("node3"), modulo_placement("c_name", 4).alias("node4"))


@_R.add("encode_int_sortable", "SELECT c_custkey, lower(lpad(printf('%x', (c_custkey::HUGEINT + 9223372036854775808)::UBIGINT), 16, '0')) AS code FROM customer")
def encode_int(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sortable_int("c_custkey").alias("code"))


@_R.add("encode_float_sortable", "SELECT c_custkey, lower(lpad(printf('%x', (CASE WHEN b >= 9223372036854775808 THEN 18446744073709551615 - b ELSE b + 9223372036854775808 END)::UBIGINT), 16, '0')) AS code FROM (SELECT c_custkey, c_acctbal::BIT::UBIGINT::HUGEINT AS b FROM customer)")
def encode_float(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sortable_float("c_acctbal").alias("code"))


@_R.add("encode_text_sortable", "SELECT c_custkey, coalesce(c_mktsegment, '') AS code FROM customer")
def encode_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sortable_text("c_mktsegment").alias("code"))


#: CRC32 of names from three seeds, by a table of 256 remainders, as DuckDB has no function for it.
_CRC_SQL = """
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) t(i)),
remainders AS (SELECT list(v ORDER BY i) AS r FROM steps),
names AS (SELECT c_name, list_transform(range(octet_length(encode(c_name))), lambda i: ('0x' || substr(hex(encode(c_name)), 2 * i + 1, 2))::BIGINT) AS bytes FROM customer),
sums AS (SELECT c_name, k, xor(list_reduce(list_prepend(xor(k * 2654435769 % 4294967296, 4294967295), bytes), lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS crc FROM names, remainders, range(3) t(k))
"""


@_R.add("filter_positions", _CRC_SQL + "SELECT c_name, k::INTEGER AS hash, crc % 10000 AS position FROM sums")
def filter_positions_query(spark, sf_dir):
    """A row for each key and hash."""
    return table(spark, sf_dir, "customer").select("c_name", F.posexplode(filter_positions("c_name")).alias("hash", "position"))


@_R.add("encode_row", "SELECT c_custkey, length(c_custkey::VARCHAR) || ':' || c_custkey || length(c_name) || ':' || c_name AS row_text FROM customer")
def encode_row(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", row_encoding("c_custkey", "c_name").alias("row_text"))


@_R.add("crc_check", _CRC_SQL + "SELECT c_name, crc FROM sums WHERE k = 0")
def crc_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", checksum("c_name").alias("crc"))


# Beyond the single-table dialect: joins, groups, windows and set operations.
@_R.add("join_group", "SELECT n_name, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_group(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_R.add("group_having", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
def group_having(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 2).alias("price")).where("n > 10")


@_R.add("window_rank", "SELECT o_custkey, o_orderkey, r::BIGINT AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def window_rank(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@_R.add("set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_ops(spark, sf_dir):
    c, s, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    return both.exceptAll(n.where("n_regionkey = 0").select("n_nationkey"))
