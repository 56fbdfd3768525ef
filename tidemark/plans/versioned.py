"""Queries over version logs, write-ahead logs and changes of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import versions as V
from ..session import Session
from ..sources.store import Store, forget_at_exit, shared_folder
from ..streaming.replication import applied, replicate
from .base import HALF_SQL, LOG_SQL, Registry, half, last_event, table, version_log

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_NEWEST = "row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS rn"
_SNAPSHOT = f"SELECT key, value, commit_ts FROM (SELECT *, {_NEWEST} FROM {LOG_SQL} WHERE commit_ts <= {HALF_SQL}) WHERE rn = 1 AND NOT is_deleted"


@_R.add("mvcc_snapshot", _SNAPSHOT)
def mvcc_snapshot(spark, sf_dir):
    return V.snapshot(version_log(spark, sf_dir), half(spark, sf_dir))


@_R.add("mvcc_scan_range", f"SELECT * FROM ({_SNAPSHOT}) WHERE key BETWEEN 3 AND 40")
def mvcc_scan_range(spark, sf_dir):
    return V.snapshot(version_log(spark, sf_dir), half(spark, sf_dir), 3, 40)


@_R.add("mvcc_read_at", f"SELECT key, value FROM ({_SNAPSHOT}) WHERE key = (SELECT min(key) FROM ({_SNAPSHOT}))")
def mvcc_read_at(spark, sf_dir):
    """The value of the smallest live key."""
    log, at = version_log(spark, sf_dir), half(spark, sf_dir)
    return V.read_at(log, V.snapshot(log, at).agg(F.min("key")).first()[0], at)


_STAGED = f"SELECT user_id AS key, max(event_id) AS seq FROM events WHERE event_type = 'purchase' AND event_id >= (SELECT max(event_id) // 10 * 9 FROM events) GROUP BY user_id"


def _staged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where((F.col("event_type") == "purchase") & (F.col("event_id") >= last_event(spark, sf_dir) // 10 * 9)).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("seq"))


@_R.add("mvcc_overlay", f"WITH own AS (SELECT key, 'own' AS value, key % 2 = 0 AS is_deleted FROM ({_STAGED})), base AS ({_SNAPSHOT}) SELECT key, value FROM own WHERE NOT is_deleted UNION ALL SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM own)")
def mvcc_overlay(spark, sf_dir):
    own = _staged(spark, sf_dir).select("key", F.lit("own").alias("value"), (F.col("key") % 2 == 0).alias("is_deleted"))
    return V.overlay(version_log(spark, sf_dir), own, half(spark, sf_dir))


@_R.add("mvcc_conflicts", f"SELECT key, max(commit_ts) AS commit_ts FROM {LOG_SQL} WHERE commit_ts > {HALF_SQL} AND key IN (SELECT key FROM ({_STAGED})) GROUP BY key")
def mvcc_conflicts(spark, sf_dir):
    return V.conflicts(version_log(spark, sf_dir), _staged(spark, sf_dir), half(spark, sf_dir))


@_R.add("mvcc_vacuum", f"SELECT key, commit_ts, value, is_deleted FROM {LOG_SQL} WHERE commit_ts > {HALF_SQL} UNION ALL SELECT key, commit_ts, value, is_deleted FROM (SELECT *, {_NEWEST} FROM {LOG_SQL} WHERE commit_ts <= {HALF_SQL}) WHERE rn = 1")
def mvcc_vacuum(spark, sf_dir):
    return V.vacuum(version_log(spark, sf_dir), half(spark, sf_dir))


@_R.add("mvcc_committed_only", f"SELECT key, commit_ts, value FROM {LOG_SQL} WHERE commit_ts % 7 <> 0")
def mvcc_committed_only(spark, sf_dir):
    log = version_log(spark, sf_dir).withColumn("committed", F.col("commit_ts") % 7 != 0)
    return log.where("committed").select("key", "commit_ts", "value")


@_R.add("lsm_compact", f"SELECT key, commit_ts, value, is_deleted FROM (SELECT *, {_NEWEST} FROM {LOG_SQL}) WHERE rn = 1 AND NOT is_deleted")
def lsm_compact(spark, sf_dir):
    return V.compact(version_log(spark, sf_dir))


@_R.add("lsm_merge", f"WITH t AS (SELECT * FROM (SELECT *, commit_ts > {HALF_SQL} AS fresh, {_NEWEST} FROM {LOG_SQL}) WHERE rn = 1) SELECT key, value FROM t WHERE NOT is_deleted")
def lsm_merge(spark, sf_dir):
    """Two sources, each the newest rows of one half of the log; the later half wins."""
    log, at = version_log(spark, sf_dir), half(spark, sf_dir)
    return V.merge([V.newest(log.where(F.col("commit_ts") > at), ["key"]), V.as_of(log, at)])


def _entries(spark, sf_dir):
    """Events as a write-ahead log of batches of ten; the last batch has no COMMIT."""
    last = last_event(spark, sf_dir)
    e, at = table(spark, sf_dir, "events"), F.col("event_id") % 10
    closing = (at == 9) & (F.col("event_id") < last - 9)
    op = F.when(at == 0, "BEGIN").when(closing, "COMMIT").when(F.col("event_type") == "error", "DELETE").otherwise("SET")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), F.col("event_type").alias("val"))


@_R.add("wal_replay", """
WITH e AS (SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'BEGIN' WHEN event_id % 10 = 9 AND event_id < (SELECT max(event_id) FROM events) - 9 THEN 'COMMIT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'SET' END AS op, user_id AS key, event_type AS val FROM events),
b AS (SELECT *, sum(CASE WHEN op = 'BEGIN' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS batch FROM e),
c AS (SELECT batch FROM b WHERE op = 'COMMIT'),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM b WHERE op IN ('SET', 'DELETE') AND batch IN (SELECT batch FROM c))
SELECT key, val AS value FROM w WHERE rn = 1 AND op = 'SET'""")  # fmt: skip
def wal_replay(spark, sf_dir):
    return V.replay(_entries(spark, sf_dir))


@_R.add("log_apply", "SELECT key, arg_max(value, commit_ts) AS value, max(commit_ts) AS commit_ts FROM " + LOG_SQL + " WHERE commit_ts % 3 <> 0 GROUP BY key")
def log_apply(spark, sf_dir):
    """Committed commands folded in log order: the last one of each key."""
    log = version_log(spark, sf_dir).where("commit_ts % 3 <> 0").select("key", "commit_ts", "value")
    return V.newest(log, ["key"]).select("key", "value", "commit_ts")


@_R.add("agg_count", "SELECT count(*)::BIGINT AS versions FROM events")
def agg_count(spark, sf_dir):
    return version_log(spark, sf_dir).agg(F.count("*").alias("versions"))


@_R.add("agg_count_by_key", "SELECT user_id AS key, count(*)::BIGINT AS versions FROM events GROUP BY 1")
def agg_count_by_key(spark, sf_dir):
    return version_log(spark, sf_dir).groupBy("key").agg(F.count("*").alias("versions"))


@_R.add("agg_max_ts", "SELECT max(event_id) AS max_ts FROM events")
def agg_max_ts(spark, sf_dir):
    return version_log(spark, sf_dir).agg(F.max("commit_ts").alias("max_ts"))


@_R.add("agg_newest_ts", "SELECT user_id AS key, max(event_id) AS newest FROM events GROUP BY 1")
def agg_newest_ts(spark, sf_dir):
    return version_log(spark, sf_dir).groupBy("key").agg(F.max("commit_ts").alias("newest"))


@_R.add("store_stats", f"SELECT count(DISTINCT key)::BIGINT AS keys, count(*)::BIGINT AS versions, max(commit_ts) AS max_txid, count(DISTINCT CASE WHEN commit_ts % 7 = 0 THEN commit_ts END)::BIGINT AS active, count(DISTINCT CASE WHEN commit_ts % 7 <> 0 THEN commit_ts END)::BIGINT AS committed FROM {LOG_SQL}")
def store_stats(spark, sf_dir):
    return V.store_stats(version_log(spark, sf_dir), F.col("commit_ts") % 7 != 0)


@_R.add("memtable_size", "SELECT sum(length(c_name) + length(c_mktsegment))::BIGINT AS size FROM customer")
def memtable_size(spark, sf_dir):
    return V.memtable_size(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment")


@_R.add("sst_sparse_index", "SELECT c_name, position FROM (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer) WHERE position % 16 = 0")
def sst_sparse_index(spark, sf_dir):
    return V.sparse_index(table(spark, sf_dir, "customer"), "c_name", 16).withColumn("position", F.col("position").cast("long"))


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_O = ", ".join(ORDERS)


@_R.add("dml_insert", f"SELECT {_O} FROM orders UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) + 1, o_custkey, 'N', 0.0 FROM orders WHERE o_orderstatus = 'P'")
def dml_insert(spark, sf_dir):
    """Rows to insert pass an anti-join on the primary key."""
    o = table(spark, sf_dir, "orders").select(*ORDERS)
    top = o.agg(F.max("o_orderkey")).first()[0]
    new = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + top + 1).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return o.unionByName(new.join(o.select("o_orderkey"), "o_orderkey", "left_anti").select(*ORDERS))


def _loaded(spark, sf_dir):
    """A session over a new store, with the orders as one commit."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", passing=True)
    rows, txn = table(spark, sf_dir, "orders").select(*ORDERS), store.begin()
    txn.change(op="create", table="orders", schema=rows.schema.jsonValue())
    txn.stage("orders", rows.withColumn("_is_deleted", F.lit(False)))
    txn.commit()
    return Session(store)


@_R.add("dml_update", f"SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def dml_update(spark, sf_dir):
    """The table after an UPDATE that has been committed to a version log."""
    session = _loaded(spark, sf_dir)
    session.run("UPDATE orders SET o_orderstatus = 'X' WHERE o_totalprice > 100000")
    return session.run(f"SELECT {_O} FROM orders").rows


@_R.add("dml_delete", f"SELECT {_O} FROM orders WHERE NOT coalesce(o_orderstatus = 'F', FALSE)")
def dml_delete(spark, sf_dir):
    """The table after a DELETE, which appends tombstones."""
    session = _loaded(spark, sf_dir)
    session.run("DELETE FROM orders WHERE o_orderstatus = 'F'")
    return session.run(f"SELECT {_O} FROM orders").rows


@_R.add("dml_affected", "SELECT count(*)::BIGINT AS affected FROM orders WHERE o_totalprice > 100000")
def dml_affected(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 100000").agg(F.count("*").alias("affected"))


@_R.add("repl_catchup", f"SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'SET' END AS op, user_id::VARCHAR AS key, event_type AS val FROM events WHERE event_id > {HALF_SQL}")
def repl_catchup(spark, sf_dir):
    """What a replica has after a stream from where it stopped."""
    root = f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("SET")
    e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("val")).write.parquet(f"{root}/log")
    replicate(spark, f"{root}/log", f"{root}/replica", f"{root}/checkpoint", half(spark, sf_dir)).awaitTermination()
    return applied(spark, f"{root}/replica")


@_R.add("lock_check", "WITH held AS (SELECT l_orderkey AS txn, l_partkey AS key, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE 'S' END AS mode FROM lineitem WHERE l_linenumber = 1), req AS (SELECT l_orderkey AS txn, l_partkey AS key, CASE WHEN l_quantity > 25 THEN 'X' ELSE 'S' END AS mode FROM lineitem WHERE l_linenumber = 2) SELECT r.txn, r.key, r.mode, NOT EXISTS (SELECT 1 FROM held h WHERE h.key = r.key AND h.txn <> r.txn AND (r.mode = 'X' OR h.mode = 'X')) AS granted FROM req r")
def lock_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    locks = lambda n, x: lines.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("txn"), F.col("l_partkey").alias("key"), F.when(x, "X").otherwise("S").alias("mode"))
    return V.locks(locks(2, F.col("l_quantity") > 25), locks(1, F.col("l_returnflag") == "R"))


@_R.add("hlc_now", "SELECT event_id, user_id, j + greatest(max(floor(value)::BIGINT - j) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS hlc FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j FROM events)")
def hlc_now(spark, sf_dir):
    """A clock for each user; the events' values stand for wall times that jump back and forth."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").alias("wall"))
    return V.hybrid_clock(e, "user_id", "event_id", "wall").drop("wall")


@_R.add("events_since", f"SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 4 * 3 FROM events)")
def events_since(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_id") > last_event(spark, sf_dir) // 4 * 3).select("event_id", "event_type")
