"""Decisions on fixes: a state machine replayed over ordered requests inside one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The skip that rejects, its reason, and sessions after which a skip returns.
SKIPS, SKIPPED, RETURNS = 3, "Skipped 3 times", (10, 20)


def start() -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit("open").alias("decision"), none.cast("string").alias("decided_by"), none.cast("timestamp").alias("decided_at"),
        none.cast("string").alias("reason"), F.lit(0).alias("skip_count"), none.cast("long").alias("sessions_at_skip"),
    )


def step(state: Column, ask: Column) -> Column:
    """The state after one request (decision, reason, by, at, sessions).  Asking for what is, or anything
    of a rejected fix, changes nothing; every skip counts, and the third rejects."""
    skips = state["skip_count"] + 1
    skipping, rejecting = ask["decision"] == "skipped", ask["decision"] == "rejected"
    final = skipping & (skips >= SKIPS)
    after = F.struct(
        F.when(final, "rejected").otherwise(ask["decision"]).alias("decision"),
        ask["by"].alias("decided_by"), ask["at"].alias("decided_at"),
        F.when(final, SKIPPED).when(rejecting, ask["reason"]).alias("reason"),
        F.when(skipping, skips).otherwise(state["skip_count"]).alias("skip_count"),
        F.when(skipping, ask["sessions"]).otherwise(state["sessions_at_skip"]).alias("sessions_at_skip"),
    )
    return F.when((ask["decision"] == state["decision"]) | (state["decision"] == "rejected"), state).otherwise(after)


def replay(requests: DataFrame) -> DataFrame:
    """(fix_id, state columns, returns_at) after all requests (fix_id, at, decision, reason, by, sessions)."""
    asked = F.array_sort(F.collect_list(F.struct("at", "decision", "reason", "by", "sessions")))
    out = requests.groupBy("fix_id").agg(F.aggregate(asked, start(), step).alias("s")).select("fix_id", "s.*")
    return out.withColumn("returns_at", returns_at())


def returns_at() -> Column:
    """Sessions at which a skipped fix comes back to open; null if it does not."""
    after = F.element_at(F.array(*[F.lit(n) for n in RETURNS]), F.greatest(F.least(F.col("skip_count"), F.lit(len(RETURNS))), F.lit(1)))
    return F.when((F.col("decision") == "skipped") & (F.col("skip_count") <= len(RETURNS)), F.col("sessions_at_skip") + after)
