"""Placement, metrics, cluster state and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modulo_placement
from ..operators import access, cluster, observability, placement
from .base import HALF_SQL, Registry, half, last_event, table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

# ------------------------------------------------------------------------------------------------ placement
NODES, MORE, VNODES = ["node-A", "node-B", "node-C"], ["node-A", "node-B", "node-C", "node-D"], 64


def _ring_sql(nodes: list[str], vnodes: int = VNODES) -> str:
    named = ", ".join(f"({i}, '{n}')" for i, n in enumerate(nodes))
    hashed = f"SELECT rank, node, vnode, ('0x' || substr(md5(node || ':vnode:' || vnode), 25, 8))::BIGINT AS position FROM (VALUES {named}) n(rank, node), (SELECT range::INTEGER AS vnode FROM range({vnodes}))"
    return f"(SELECT position, node, vnode FROM ({hashed}) QUALIFY row_number() OVER (PARTITION BY position ORDER BY rank DESC, vnode DESC) = 1)"


def _assign_sql(nodes: list[str]) -> str:
    """Keys of customers with the node of the first position after their hash."""
    arcs = f"SELECT lag(position, 1, 0) OVER (ORDER BY position) AS low, position AS high, node FROM {_ring_sql(nodes)} UNION ALL SELECT max(position), 4294967296, arg_min(node, position) FROM {_ring_sql(nodes)}"
    return f"(SELECT k.key, a.node FROM (SELECT c_name AS key, ('0x' || substr(md5(c_name), 25, 8))::BIGINT AS h FROM customer) k JOIN ({arcs}) a ON k.h >= a.low AND k.h < a.high)"


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))


@_R.add("ring_build", f"SELECT * FROM {_ring_sql(NODES)}")
def ring_build(spark, sf_dir):
    return placement.build_ring(spark, NODES, VNODES)


@_R.add("ring_ranges", f"SELECT node, vnode, lag(position, 1, 0) OVER w AS range_start, position AS range_end, position - lag(position, 1, 0) OVER w AS size FROM {_ring_sql(NODES)} WINDOW w AS (ORDER BY position)")
def ring_ranges(spark, sf_dir):
    return placement.ranges(placement.build_ring(spark, NODES, VNODES))


@_R.add("ring_assign", f"SELECT key, node FROM {_assign_sql(NODES)}")
def ring_assign(spark, sf_dir):
    return placement.assign(_keys(spark, sf_dir), placement.build_ring(spark, NODES, VNODES))


@_R.add("ring_replicas", f"WITH r AS (SELECT * FROM {_ring_sql(NODES)}), t AS (SELECT a.position, b.node, min((b.position - a.position + 4294967296) % 4294967296) AS turn FROM r a, r b GROUP BY 1, 2) SELECT position, node, row_number() OVER (PARTITION BY position ORDER BY turn)::INTEGER AS rank FROM t")
def ring_replicas(spark, sf_dir):
    return placement.replicas(placement.build_ring(spark, NODES, VNODES), NODES)


@_R.add("ring_load", f"WITH s AS (SELECT node, position - lag(position, 1, 0) OVER (ORDER BY position) AS size FROM {_ring_sql(NODES)}) SELECT node, round(sum(size) * 100.0::DOUBLE / (SELECT sum(size) FROM s), 6) AS percent FROM s GROUP BY node")
def ring_load(spark, sf_dir):
    load = placement.load(placement.build_ring(spark, NODES, VNODES))
    return load.select("node", F.round("percent", 6).alias("percent"))


@_R.add("ring_vnode_count", f"SELECT node, count(*)::BIGINT AS vnodes FROM {_ring_sql(NODES)} GROUP BY node")
def ring_vnode_count(spark, sf_dir):
    return placement.build_ring(spark, NODES, VNODES).groupBy("node").agg(F.count("*").alias("vnodes"))


@_R.add("ring_moved_keys", f"SELECT a.key, a.node AS from_node, b.node AS to_node FROM {_assign_sql(NODES)} a JOIN {_assign_sql(MORE)} b USING (key) WHERE a.node <> b.node")
def ring_moved_keys(spark, sf_dir):
    return placement.moved(_keys(spark, sf_dir), placement.build_ring(spark, NODES, VNODES), placement.build_ring(spark, MORE, VNODES))


@_R.add("shard_sizes", f"SELECT node, count(*)::BIGINT AS keys FROM {_assign_sql(NODES)} GROUP BY node")
def shard_sizes(spark, sf_dir):
    return ring_assign(spark, sf_dir).groupBy("node").agg(F.count("*").alias("keys"))


@_R.add("shard_total_keys", "SELECT count(DISTINCT c_name)::BIGINT AS keys FROM customer")
def shard_total_keys(spark, sf_dir):
    """Keys over all replicas, each once: every key lies on two of three nodes."""
    placed = placement.placement(spark, 6, ["node-1", "node-2", "node-3"], 2).select("shard", "node")
    keys = _keys(spark, sf_dir).withColumn("shard", modulo_placement("key", 6).cast("int"))
    return keys.join(F.broadcast(placed), "shard").agg(F.countDistinct("key").alias("keys"))


@_R.add("placement", "SELECT i.range AS shard, j.range AS replica, ['node-1', 'node-2', 'node-3'][(i.range + j.range) % 3 + 1] AS node, j.range = 0 AS preferred FROM range(6) i, range(3) j")
def placement_query(spark, sf_dir):
    return placement.placement(spark, 6, ["node-1", "node-2", "node-3"], 3)


@_R.add("shards_per_node", "SELECT ['node-1', 'node-2', 'node-3'][(i.range + j.range) % 3 + 1] AS node, count(*)::BIGINT AS shards, sum(CASE WHEN j.range = 0 THEN 1 ELSE 0 END)::BIGINT AS led FROM range(6) i, range(2) j GROUP BY 1")
def shards_per_node(spark, sf_dir):
    placed = placement.placement(spark, 6, ["node-1", "node-2", "node-3"], 2)
    return placed.groupBy("node").agg(F.count("*").alias("shards"), F.count_if("preferred").alias("led"))


@_R.add("txn_cross_shard", "SELECT l_orderkey AS txn, count(DISTINCT l_partkey % 6)::BIGINT AS shards, count(DISTINCT l_partkey % 6) > 1 AS cross_shard FROM lineitem GROUP BY 1")
def txn_cross_shard(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), (F.col("l_partkey") % 6).alias("shard"))
    return keys.groupBy("txn").agg(F.countDistinct("shard").alias("shards")).withColumn("cross_shard", F.col("shards") > 1)


@_R.add("txn_keys_by_shard", "SELECT l_orderkey AS txn, l_partkey % 6 AS shard, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS keys FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1, 2")
def txn_keys_by_shard(spark, sf_dir):
    """The keys of each transaction, grouped by their shard: those of one shard are committed together."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), (F.col("l_partkey") % 6).alias("shard"), F.col("l_partkey").alias("key"))
    grouped = keys.groupBy("txn", "shard").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return grouped.select("txn", "shard", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


# -------------------------------------------------------------------------------------------------- metrics
def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("value").alias("ms"))


@_R.add("metric_mean", "SELECT event_type AS series, count(*)::BIGINT AS total, round(sum(value), 2) AS sum_ms, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1")
def metric_mean(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("series").agg(F.count("*").alias("total"), F.round(F.sum("ms"), 2).alias("sum_ms"), F.round(F.avg("ms"), 4).alias("mean_ms"))


@_R.add("metric_minmax", "SELECT event_type AS series, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY 1")
def metric_minmax(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy("series").agg(F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


_RANKED = "(SELECT event_type AS series, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@_R.add("metric_percentile", f"SELECT series, p.p, ms AS value FROM {_RANKED} r, (VALUES (50.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE), (99.9::DOUBLE)) p(p) WHERE k = least(floor(n * p.p / 100), n - 1)")
def metric_percentile(spark, sf_dir):
    return observability.percentiles(_samples(spark, sf_dir), "series", "ms", [50, 95, 99, 99.9])


@_R.add("metric_percentile_newest", f"WITH r AS (SELECT series, ms, row_number() OVER (PARTITION BY series ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM (SELECT event_type AS series, value AS ms FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 10000)) SELECT series, p.p, ms AS value FROM r, (VALUES (50.0::DOUBLE), (99.0::DOUBLE)) p(p) WHERE k = least(floor(n * p.p / 100), n - 1)")
def metric_percentile_newest(spark, sf_dir):
    """Of the newest 10,000 samples of each series."""
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("value").alias("ms"), "event_id")
    return observability.percentiles(samples, "series", "ms", [50, 99], ("event_id", 10_000))


@_R.add("metric_snapshot", f"SELECT series, n::BIGINT AS total, round(avg(ms), 3) AS mean_ms, " + ", ".join(f"round(max(CASE WHEN k = least(floor(n * {p}::DOUBLE / 100), n - 1) THEN ms END), 3) AS {c}" for p, c in ((50.0, "p50"), (95.0, "p95"), (99.0, "p99"), (99.9, "p999"))) + f" FROM {_RANKED} GROUP BY series, n")
def metric_snapshot(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    at = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 3)
    wide = observability.percentiles(samples, "series", "ms", [50, 95, 99, 99.9]).groupBy("series").agg(at(50.0).alias("p50"), at(95.0).alias("p95"), at(99.0).alias("p99"), at(99.9).alias("p999"))
    return samples.groupBy("series").agg(F.count("*").alias("total"), F.round(F.avg("ms"), 3).alias("mean_ms")).join(wide, "series")


def _bound(value: str, bounds: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {float(b)} THEN {float(b)}::DOUBLE" for b in bounds) + " END"


def _values(bounds: tuple) -> str:
    return "(VALUES " + ", ".join(f"({float(b)}::DOUBLE)" for b in bounds) + ")"


@_R.add("metric_percentile_bucket", f"WITH c AS (SELECT event_type AS series, le, count(*) FILTER (WHERE value <= le) AS n, ceil(count(*) * 0.95::DOUBLE) AS need FROM events, {_values(observability.TIMER_BOUNDS)} b(le) GROUP BY 1, 2) SELECT series, coalesce(min(le) FILTER (WHERE n >= need), (SELECT max(value) FROM events e WHERE e.event_type = c.series)) AS value FROM c GROUP BY series")
def metric_percentile_bucket(spark, sf_dir):
    return observability.percentile_by_bucket(_samples(spark, sf_dir), "series", "ms", 0.95)


@_R.add("metric_hist_cumulative", f"SELECT event_type AS series, le, (count(*) FILTER (WHERE value <= le))::BIGINT AS n FROM events, {_values(observability.HISTOGRAM_BOUNDS)} b(le) GROUP BY 1, 2")
def metric_hist_cumulative(spark, sf_dir):
    return observability.histogram_cumulative(_samples(spark, sf_dir), "series", "ms")


@_R.add("metric_hist_disjoint", f"SELECT event_type AS series, {_bound('value', observability.TIMER_BOUNDS)} AS le, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def metric_hist_disjoint(spark, sf_dir):
    return observability.histogram(_samples(spark, sf_dir), "series", "ms", observability.TIMER_BOUNDS)


# ------------------------------------------------------------------------------------------------ slow log
_SLOW = "(SELECT event_id AS seq, user_id AS usr, event_type AS query, value AS duration_ms, CASE WHEN event_type IN ('view', 'click') THEN 'FULL_SCAN' ELSE 'INDEX_SCAN' END AS plan, json_extract(props, '$.k')::BIGINT AS examined, json_extract(props, '$.k')::BIGINT // 2 AS returned FROM events)"


def _slow(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    plan = F.when(F.col("event_type").isin("view", "click"), "FULL_SCAN").otherwise("INDEX_SCAN")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("usr"), F.col("event_type").alias("query"), F.col("value").alias("duration_ms"), plan.alias("plan"), k.alias("examined"), F.floor(k / 2).alias("returned"))


@_R.add("slowlog_record", f"SELECT * FROM {_SLOW} WHERE duration_ms >= 100")
def slowlog_record(spark, sf_dir):
    return _slow(spark, sf_dir).where("duration_ms >= 100")


@_R.add("slowlog_summary", f"SELECT count(*)::BIGINT AS total, max(duration_ms) AS max_ms, round(avg(duration_ms), 2) AS avg_ms, (count(*) FILTER (WHERE plan = 'FULL_SCAN'))::BIGINT AS full_scans, (count(*) FILTER (WHERE plan = 'INDEX_SCAN'))::BIGINT AS index_scans FROM {_SLOW} WHERE duration_ms >= 100")
def slowlog_summary(spark, sf_dir):
    return observability.slow_summary(slowlog_record(spark, sf_dir))


@_R.add("slowlog_selectivity", f"SELECT seq, CASE WHEN examined = 0 THEN 1.0::DOUBLE ELSE returned::DOUBLE / examined END AS selectivity FROM {_SLOW}")
def slowlog_selectivity(spark, sf_dir):
    return _slow(spark, sf_dir).select("seq", observability.selectivity(F.col("returned"), F.col("examined")).alias("selectivity"))


@_R.add("slowlog_recent", f"SELECT seq, duration_ms FROM {_SLOW} WHERE duration_ms >= 100 ORDER BY seq DESC LIMIT 20")
def slowlog_recent(spark, sf_dir):
    return slowlog_record(spark, sf_dir).select("seq", "duration_ms").orderBy(F.col("seq").desc()).limit(20)


@_R.add("slowlog_top", f"SELECT seq, duration_ms FROM {_SLOW} ORDER BY duration_ms DESC, seq LIMIT 10")
def slowlog_top(spark, sf_dir):
    return _slow(spark, sf_dir).select("seq", "duration_ms").orderBy(F.col("duration_ms").desc(), "seq").limit(10)


@_R.add("slowlog_full_scans", f"SELECT seq, query, duration_ms FROM {_SLOW} WHERE plan = 'FULL_SCAN' AND duration_ms >= 100")
def slowlog_full_scans(spark, sf_dir):
    return slowlog_record(spark, sf_dir).where("plan = 'FULL_SCAN'").select("seq", "query", "duration_ms")


_SPANS = "(SELECT event_id // 8 AS trace, event_id AS span, epoch_us(ts) AS start_us, epoch_us(ts) + floor(value * 1000)::BIGINT AS end_us FROM events)"


def _spans(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("trace"), F.col("event_id").alias("span"), start.alias("start_us"), (start + F.floor(F.col("value") * 1000).cast("long")).alias("end_us"))


@_R.add("trace_duration", f"SELECT trace, count(*)::BIGINT AS spans, min(start_us) AS start_us, max(end_us) - min(start_us) AS duration_us FROM {_SPANS} GROUP BY 1")
def trace_duration(spark, sf_dir):
    return observability.trace_durations(_spans(spark, sf_dir))


_OFFSETS = f"(SELECT trace, span, start_us - min(start_us) OVER w AS offset_us, end_us - start_us AS duration_us, max(end_us) OVER w - min(start_us) OVER w AS total_us FROM {_SPANS} WINDOW w AS (PARTITION BY trace))"


@_R.add("trace_spans", f"SELECT * FROM {_OFFSETS}")
def trace_spans(spark, sf_dir):
    return observability.span_offsets(_spans(spark, sf_dir))


@_R.add("trace_waterfall", f"SELECT *, repeat(' ', floor(offset_us / greatest(total_us, 1) * 40)::INTEGER) || repeat('\u2588', greatest(1, floor(duration_us / greatest(total_us, 1) * 40)::INTEGER)) AS bar FROM {_OFFSETS}")
def trace_waterfall(spark, sf_dir):
    return observability.waterfall(trace_spans(spark, sf_dir))


# ------------------------------------------------------------------------------------------------- cluster
_GOSSIP = "(SELECT user_id % 5 AS observer, user_id % 7 AS subject, event_id // 1000 AS generation, event_id AS heartbeat, ts FROM events)"


def _gossip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("observer"), (F.col("user_id") % 7).alias("subject"), F.floor(F.col("event_id") / 1000).alias("generation"), F.col("event_id").alias("heartbeat"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@_R.add("gossip_merge", f"SELECT subject, max(generation) AS generation, max(heartbeat) AS heartbeat FROM {_GOSSIP} GROUP BY subject")
def gossip_merge(spark, sf_dir):
    return cluster.gossip_merge(_gossip(spark, sf_dir))


_AGE = f"(SELECT user_id AS subject, ((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts))) / 1000000.0::DOUBLE AS age_s FROM events GROUP BY 1)"


@_R.add("liveness", f"SELECT subject, CASE WHEN age_s > 6 THEN 'dead' WHEN age_s > 3 THEN 'suspect' ELSE 'alive' END AS status FROM {_AGE}")
def liveness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = e.agg(F.max("us")).first()[0]
    ages = e.groupBy(F.col("user_id").alias("subject")).agg(((F.lit(now) - F.max("us")) / 1000000.0).alias("age_s"))
    return ages.select("subject", cluster.liveness(F.col("age_s")).alias("status"))


@_R.add("failure_verdict", f"WITH v AS (SELECT observer, subject, max(heartbeat) < (SELECT max(event_id) FROM events) - 60 AS dead FROM {_GOSSIP} GROUP BY 1, 2), b AS (SELECT subject, count(*)::BIGINT AS voters, (count(*) FILTER (WHERE dead))::BIGINT AS dead_votes FROM v GROUP BY 1) SELECT subject, voters, dead_votes, voters > 2.5 AND dead_votes > 2.0 AS failed FROM b")
def failure_verdict(spark, sf_dir):
    last = last_event(spark, sf_dir)
    votes = _gossip(spark, sf_dir).groupBy("observer", "subject").agg((F.max("heartbeat") < last - 60).alias("dead"))
    return cluster.failure_verdict(votes, 5)


@_R.add("reconcile_diff", f"WITH d AS (SELECT DISTINCT user_id % 6 AS shard, event_id % 3 AS node FROM events WHERE event_id > {HALF_SQL} AND event_type = 'view'), c AS (SELECT DISTINCT user_id % 6 AS shard, event_id % 4 AS node FROM events WHERE event_id <= {HALF_SQL} AND event_type = 'click') SELECT shard, node, 'add' AS action FROM (SELECT * FROM d EXCEPT SELECT * FROM c) UNION ALL SELECT shard, node, 'drop' FROM (SELECT * FROM c EXCEPT SELECT * FROM d)")
def reconcile_diff(spark, sf_dir):
    e, at = table(spark, sf_dir, "events"), half(spark, sf_dir)
    desired = e.where((F.col("event_id") > at) & (F.col("event_type") == "view")).select((F.col("user_id") % 6).alias("shard"), (F.col("event_id") % 3).alias("node"))
    current = e.where((F.col("event_id") <= at) & (F.col("event_type") == "click")).select((F.col("user_id") % 6).alias("shard"), (F.col("event_id") % 4).alias("node"))
    return cluster.reconcile(desired, current)


_DECISIONS = "(SELECT o_orderkey AS txn_id, CASE o_orderstatus WHEN 'F' THEN 'commit' ELSE 'abort' END AS decision FROM orders WHERE o_orderstatus <> 'O')"
_INTENTS = "(SELECT l_orderkey AS txn_id, l_partkey AS key FROM lineitem)"


def _intents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key"))


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return o.select(F.col("o_orderkey").alias("txn_id"), F.when(F.col("o_orderstatus") == "F", "commit").otherwise("abort").alias("decision"))


@_R.add("txn_outcome", f"SELECT txn_id, key, coalesce(decision, 'open') AS outcome FROM {_INTENTS} LEFT JOIN {_DECISIONS} USING (txn_id)")
def txn_outcome(spark, sf_dir):
    return cluster.txn_outcome(_intents(spark, sf_dir), _decisions(spark, sf_dir))


@_R.add("txn_locked_keys", f"SELECT key, min(txn_id) AS txn_id FROM {_INTENTS} WHERE txn_id NOT IN (SELECT txn_id FROM {_DECISIONS}) AND key IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY key")
def txn_locked_keys(spark, sf_dir):
    staged = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("key"))
    return cluster.locked_keys(staged, _intents(spark, sf_dir), _decisions(spark, sf_dir))


@_R.add("repl_lag", "SELECT user_id % 4 AS replica, (SELECT max(event_id) FROM events) - max(event_id) AS lag FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def repl_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return cluster.lag(e, e.where("event_type <> 'purchase'").withColumn("replica", F.col("user_id") % 4))


# ------------------------------------------------------------------------------------------------- access
_ROLE = "CASE c_nationkey % 4 WHEN 0 THEN 'SUPERUSER' WHEN 1 THEN 'READ_WRITE' WHEN 2 THEN 'READ_ONLY' ELSE 'NO_ACCESS' END"


@_R.add("rbac_check", f"SELECT c_name, {_ROLE} AS role, {_ROLE} IN ('SUPERUSER', 'READ_WRITE') AND NOT c_acctbal < 0 AS may_insert, {_ROLE} IN ('SUPERUSER', 'READ_WRITE', 'READ_ONLY') AND NOT c_acctbal < 0 AS may_select FROM customer")
def rbac_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("role", F.expr(_ROLE))
    locked = F.col("c_acctbal") < 0
    return c.select("c_name", "role", access.permitted(F.col("role"), "INSERT", locked).alias("may_insert"), access.permitted(F.col("role"), "SELECT", locked).alias("may_select"))


@_R.add("auth_lockout", "WITH l AS (SELECT user_id AS usr, event_id AS seq, event_type <> 'error' AS ok FROM events WHERE event_type IN ('error', 'signup')), k AS (SELECT usr, max(seq) FILTER (WHERE ok) AS last_ok FROM l GROUP BY 1) SELECT k.usr AS user, (count(l.seq))::BIGINT AS failures, count(l.seq) >= 5 AS locked FROM k LEFT JOIN l ON l.usr = k.usr AND NOT l.ok AND (k.last_ok IS NULL OR l.seq > k.last_ok) GROUP BY 1")
def auth_lockout(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return access.lockouts(e.select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))


@_R.add("audit_tail", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def audit_tail(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.col("event_id").desc()).limit(25)


@_R.add("rate_limit", """
WITH RECURSIVE q AS (SELECT user_id AS usr, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
b AS (SELECT usr, seq, at_s, k, 9.0::DOUBLE AS tokens, TRUE AS allowed FROM q WHERE k = 1
  UNION ALL SELECT usr, seq, at_s, k, CASE WHEN had >= 1 THEN had - 1.0::DOUBLE ELSE had END, had >= 1 FROM (SELECT q.usr, q.seq, q.at_s, q.k, least(10.0::DOUBLE, b.tokens + greatest(0.0::DOUBLE, q.at_s - b.at_s) * 0.0005::DOUBLE) AS had FROM b JOIN q ON q.usr = b.usr AND q.k = b.k + 1))
SELECT usr AS user, seq, allowed, round(tokens, 6) AS tokens FROM b""")
def rate_limit(spark, sf_dir):
    """A token bucket is a fold in order: each request depends on what the one before has left."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"))
    return access.rate_limited(e, 0.0005, 10.0)
