"""What a cluster's state tables answer: membership, liveness, transactions, placement drift, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds without a heartbeat after which a node is suspect, and dead; fixed values.
SUSPECT_S, DEAD_S = 3.0, 6.0


def gossip_merge(views: DataFrame) -> DataFrame:
    """The newest (generation, heartbeat) of each subject over all observers' views."""
    return views.groupBy("subject").agg(F.max(F.struct("generation", "heartbeat")).alias("r")).select("subject", "r.*")


def liveness(age_s: Column) -> Column:
    return F.when(age_s > DEAD_S, "dead").when(age_s > SUSPECT_S, "suspect").otherwise("alive")


def failure_verdict(votes: DataFrame, active: int) -> DataFrame:
    """(subject, voters, dead_votes, failed): a subject has failed if more than half of the others call it dead, given
    that more than half of the active nodes have answered."""
    by = votes.groupBy("subject").agg(F.count("*").alias("voters"), F.count_if("dead").alias("dead_votes"))
    enough = F.col("voters") > active / 2
    return by.select("subject", "voters", "dead_votes", (enough & (F.col("dead_votes") > (active - 1) / 2)).alias("failed"))


def reconcile(desired: DataFrame, current: DataFrame) -> DataFrame:
    """(shard, node, action): pairs to add and to drop so that current becomes desired."""
    tagged = desired.select("shard", "node", F.lit(1).alias("w")).unionByName(current.select("shard", "node", F.lit(2).alias("w")))
    seen = tagged.groupBy("shard", "node").agg(F.bit_or("w").alias("w")).where("w <> 3")
    return seen.select("shard", "node", F.when(F.col("w") == 1, "add").otherwise("drop").alias("action"))


def txn_outcome(intents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every intent (txn_id, key) with its transaction's decision, or open where there is none."""
    return intents.join(decisions, "txn_id", "left").select("txn_id", "key", F.coalesce("decision", F.lit("open")).alias("outcome"))


def locked_keys(staged: DataFrame, intents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Staged keys that an intent of an undecided transaction holds, with the smallest such transaction."""
    held = intents.join(decisions, "txn_id", "left_anti").groupBy("key").agg(F.min("txn_id").alias("txn_id"))
    return staged.select("key").distinct().join(held, "key")


def lag(primary: DataFrame, applied: DataFrame) -> DataFrame:
    """(replica, lag): how many sequence numbers each replica is behind. The newest one is a single value, read first."""
    last = primary.agg(F.max("seq")).first()[0]
    return applied.groupBy("replica").agg((F.lit(last).cast("long") - F.max("seq")).alias("lag"))
