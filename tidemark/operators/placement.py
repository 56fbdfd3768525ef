"""Consistent-hash rings and shard placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ring_hash

RING = 2**32
#: The most virtual nodes of a ring that is broadcast; the ring is a parameter, not data.
MAX_RING = 100_000


def build_ring(spark: SparkSession, nodes: list[str], vnodes: int) -> DataFrame:
    """(position, node, vnode); where positions collide the node given last holds."""
    if len(nodes) * vnodes > MAX_RING:
        raise ValueError(f"a ring has at most {MAX_RING} virtual nodes")
    named = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("node")) for i, n in enumerate(nodes)])
    all_nodes = spark.range(vnodes).select(F.col("id").cast("int").alias("vnode"), F.inline(named))
    placed = all_nodes.withColumn("position", ring_hash(F.concat("node", F.lit(":vnode:"), F.col("vnode").cast("string"))))
    best = placed.groupBy("position").agg(F.max(F.struct("rank", "vnode", "node")).alias("r"))
    return best.select("position", "r.node", "r.vnode")


def ranges(ring: DataFrame) -> DataFrame:
    """(node, vnode, range_start, range_end, size): from the position before, 0 for the first, up to the own one."""
    w = Window.orderBy("position")
    start = F.lag("position", 1, 0).over(w)
    return ring.select("node", "vnode", start.alias("range_start"), F.col("position").alias("range_end"), (F.col("position") - start).alias("size"))


def arcs(ring: DataFrame) -> DataFrame:
    """(low, high, node) with low <= hash < high: a key belongs to the first position strictly after its hash, and past the last to the first."""
    w = Window.orderBy("position")
    own = ring.select(F.lag("position", 1, 0).over(w).alias("low"), F.col("position").alias("high"), "node")
    around = ring.agg(F.max("position").alias("low"), F.min(F.struct("position", "node")).alias("first"))
    return own.unionByName(around.select("low", F.lit(RING).alias("high"), F.col("first.node").alias("node")))


def assign(keys: DataFrame, ring: DataFrame, key: str = "key") -> DataFrame:
    """keys with the node that owns each: hashes are cut into slots, so the range join is a hash join on the slot.

    Every arc is listed under each of the slots that it touches; slots number about as many as arcs.
    """
    bits = 16
    by_slot = arcs(ring).withColumn("_slot", F.explode(F.sequence(F.shiftright("low", bits), F.shiftright(F.col("high") - 1, bits)))).where("high > low")
    hashed = keys.withColumn("_hash", ring_hash(key)).withColumn("_slot", F.shiftright("_hash", bits))
    owner = by_slot.select("_slot", "low", "high", "node")
    return hashed.join(F.broadcast(owner), "_slot").where("_hash >= low and _hash < high").select(*keys.columns, "node")


def replicas(ring: DataFrame, nodes: list[str]) -> DataFrame:
    """(position, node, rank) for each position: the distinct nodes clockwise from it, ranked from 1.

    One window column for each node finds that node's next position, so the ring is never paired with itself.
    """
    onward = Window.orderBy("position").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    turns = []
    for n in nodes:
        own = F.when(F.col("node") == n, F.col("position"))
        turn = F.coalesce(F.min(own).over(onward), F.min(own).over(whole) + RING) - F.col("position")
        turns.append(F.struct(turn.alias("turn"), F.lit(n).alias("owner")))
    each = ring.select("position", F.array_sort(F.filter(F.array(*turns), lambda t: t["turn"].isNotNull())).alias("order"))
    return each.select("position", F.posexplode("order").alias("at", "o")).select("position", F.col("o.owner").alias("node"), (F.col("at") + 1).alias("rank"))


def load(ring: DataFrame) -> DataFrame:
    """(node, percent): part of all token ranges that each node has."""
    by_node = ranges(ring).groupBy("node").agg(F.sum("size").alias("size"))
    return by_node.select("node", (F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy())).alias("percent"))


def moved(keys: DataFrame, before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose owner differs between two rings, with both owners. Both are looked up in one pass over the keys."""
    old = assign(keys, before, key).withColumnRenamed("node", "from_node")
    return assign(old, after, key).withColumnRenamed("node", "to_node").where("from_node <> to_node")


def placement(spark: SparkSession, shards: int, nodes: list[str], copies: int) -> DataFrame:
    """(shard, replica, node, preferred): copy j of shard i is on node (i + j) modulo the nodes; the first is preferred."""
    names = F.array(*[F.lit(n) for n in nodes])
    each = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(copies, len(nodes)) - 1).cast("long"))).alias("replica"))
    at = ((F.col("shard") + F.col("replica")) % len(nodes)).cast("int")
    return each.select("shard", "replica", F.get(names, at).alias("node"), (F.col("replica") == 0).alias("preferred"))
