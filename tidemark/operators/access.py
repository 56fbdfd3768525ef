"""Access control: roles, lockout, audit, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permissions by role; fixed values.
ROLES = {
    "SUPERUSER": ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ADMIN"),
    "READ_WRITE": ("SELECT", "INSERT", "UPDATE", "DELETE"),
    "READ_ONLY": ("SELECT",),
    "NO_ACCESS": (),
}
#: Failed logins in a row that lock an account.
LOCKOUT = 5


def permitted(role: Column, permission: str, locked: Column) -> Column:
    """Whether a role has a permission; a locked user has none."""
    granting = [r for r, p in ROLES.items() if permission in p]
    return role.isin(*granting) & ~locked


def lockouts(logins: DataFrame) -> DataFrame:
    """(user, failures, locked): failed logins since the last success, from logins (user, seq, ok)."""
    last_ok = F.max(F.when(F.col("ok"), F.col("seq")))
    by = logins.groupBy("user").agg(last_ok.alias("last_ok"))
    since = logins.where(~F.col("ok")).join(by, "user").where("last_ok is null or seq > last_ok").groupBy("user").agg(F.count("*").alias("failures"))
    return by.join(since, "user", "left").select("user", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), (F.coalesce("failures", F.lit(0)) >= LOCKOUT).alias("locked"))


def rate_limited(requests: DataFrame, rate: float, capacity: float, schema_cols: tuple[str, str, str] = ("user", "seq", "at_s")) -> DataFrame:
    """(user, seq, allowed, tokens): a token bucket per user, filled at rate up to capacity, one token a request.

    The fold depends on order, so a user's requests are streamed in order through one task's state: rows are
    dealt by user and sorted, and only the bucket itself is held, however many requests a user has.
    """
    user, seq, at = schema_cols
    import pandas as pd

    def run(batches):
        who, tokens, then = None, capacity, None
        for pdf in batches:
            allowed, left = [], []
            for u, t in zip(pdf[user], pdf[at], strict=True):
                if u != who:
                    who, tokens, then = u, capacity, t
                tokens = min(capacity, tokens + max(0.0, t - then) * rate)
                then = t
                ok = tokens >= 1.0
                tokens -= 1.0 if ok else 0.0
                allowed.append(ok)
                left.append(round(tokens, 6))
            yield pd.DataFrame({user: pdf[user], seq: pdf[seq], "allowed": allowed, "tokens": left})

    ordered = requests.select(user, seq, at).repartition(user).sortWithinPartitions(user, at, seq)
    return ordered.mapInPandas(run, f"{user} long, {seq} long, allowed boolean, tokens double")
