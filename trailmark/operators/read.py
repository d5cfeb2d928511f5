"""Read models: session rows, session details, roll-ups of projects and members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import first_by

#: Fixed value: characters of a derived title.
TITLE = 120


def derived_title(text: Column) -> Column:
    """First line of a text, trimmed, at most TITLE characters."""
    return F.substring(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))), 1, TITLE)


def session_rows(messages: DataFrame) -> DataFrame:
    """(id, message_count, last_active_at, title, status) from messages (session_id, line, at, role, text).

    The title is the first line of the first user message that is not blank; one aggregate, no sort.
    """
    typed = (F.col("role") == "user") & (F.trim("text") != "")
    out = messages.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("message_count"), F.max("at").alias("last_active_at"),
        F.min_by(F.when(typed, F.col("text")), F.when(typed, F.col("line"))).alias("_first"),
    )
    status = F.when(F.col("message_count") == 0, "empty").otherwise("complete")
    return out.withColumns({"title": derived_title(F.col("_first")), "status": status}).drop("_first")


def session_details(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Every session with counts over its tool calls (session_id, line, tool_name, failed)."""
    counted = calls.groupBy("session_id").agg(
        F.count("*").alias("tool_calls"), F.count_if("failed").alias("failures"), F.count_distinct("tool_name").alias("kinds"),
        F.min("line").alias("first_line"), F.max("line").alias("last_line"),
    )
    return sessions.join(counted, "session_id", "left").fillna(0, ["tool_calls", "failures", "kinds"])


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the status and text of their first result.

    Ids of calls are unique within a session only, so the session is part of the key; a second result
    neither multiplies rows nor replaces the first.
    """
    first = first_by(results, ["session_id", "tool_id"], F.col("line")).select(
        "session_id", "tool_id", "status", F.col("text").alias("result")
    )
    return calls.join(first, ["session_id", "tool_id"], "left")


def roll_up(parents: DataFrame, children: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Parents with aggregates over their children; those without any have nulls."""
    made = children.groupBy(key).agg(*[c.alias(name) for name, c in sums.items()])
    return parents.join(made, key, "left")


def user_project_status(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, project_id) pairs with sightings (user_id, version, at) rolled up: how many, the version
    seen last (ties to the smaller), when that version was first and last seen."""
    by = seen.groupBy("user_id", "version").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n"))
    last = F.struct(F.col("last_seen"))
    current = first_by(by, ["user_id"], last.desc(), F.col("version")).drop("n")
    total = by.groupBy("user_id").agg(F.sum("n").alias("session_count"))
    out = pairs.join(total, "user_id", "left").join(current, "user_id", "left")
    return out.select("user_id", "project_id", F.coalesce("session_count", F.lit(0)).alias("session_count"), "version", "first_seen", "last_seen")


def settled_owner(df: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Keys that all rows give the same owner."""
    return df.groupBy(*keys).agg(F.min(owner).alias(owner), F.count_distinct(owner).alias("_n")).where("_n = 1").drop("_n")


def parents_of(subagents: DataFrame, calls: DataFrame) -> DataFrame:
    """Helpers (session_id, agent_id, spawn_tool_use_id) with ``parent_agent_id``, the agent whose call
    (session_id, tool_id, agent_id) spawned them; null for those of the main track."""
    spawned = calls.select("session_id", F.col("tool_id").alias("spawn_tool_use_id"), F.col("agent_id").alias("parent_agent_id"))
    return subagents.join(spawned.dropDuplicates(["session_id", "spawn_tool_use_id"]), ["session_id", "spawn_tool_use_id"], "left")


def branch_anchors(records: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches (session_id, branch, start) with ``anchor``: the first record (session_id, pos, at) after
    the start; null if none follows.

    Both sides lie in one window by session, newest first, so no pairs are made.
    """
    from pyspark.sql.window import Window

    both = records.select("session_id", F.col("at").alias("t"), F.col("pos"), F.lit(None).cast(branches.schema["branch"].dataType).alias("branch"))
    both = both.unionByName(branches.select("session_id", F.col("start").alias("t"), F.lit(None).cast(records.schema["pos"].dataType).alias("pos"), "branch"))
    after = Window.partitionBy("session_id").orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    in_time = both.where("t is not null").withColumn("t", F.col("t").cast("double"))
    anchored = in_time.withColumn("anchor", F.min("pos").over(after)).where("branch is not null")
    return branches.join(anchored.select("session_id", "branch", "anchor"), ["session_id", "branch"], "left")


def version_key(version: Column) -> Column:
    """Sort key of a version x.y.z[-pre][+build]: numbers first, a pre-release below its release, build
    ignored, what cannot be read below everything; null stays null."""
    shape = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    number = [F.regexp_extract(version, shape, k).try_cast("long") for k in (1, 2, 3)]
    pre = F.regexp_extract(version, shape, 4)
    parts = F.transform(
        F.filter(F.split(pre, r"\."), lambda x: x != ""),
        lambda x: F.struct(x.rlike(r"^\d+$").cast("int").alias("w"), F.when(x.rlike(r"^\d+$"), x.try_cast("long")).alias("n"), x.alias("s")),
    )
    # of identifiers, numbers come before words
    parts = F.transform(parts, lambda p: F.struct((1 - p["w"]).alias("w"), p["n"].alias("n"), p["s"].alias("s")))
    return F.when(version.isNotNull(), F.struct(
        F.coalesce(number[0], F.lit(-1)).alias("major"), F.coalesce(number[1], F.lit(-1)).alias("minor"),
        F.coalesce(number[2], F.lit(-1)).alias("patch"), (pre == "").cast("int").alias("release"), parts.alias("pre"),
    ))


def in_domain_order(value: Column, domain: Sequence[str]) -> list[Column]:
    """Sort keys by place in a list of values; what is not in it, and null, last."""
    place = F.array_position(F.array(*[F.lit(v) for v in domain]), value)
    return [F.when(place > 0, place).asc_nulls_last(), value.asc_nulls_last()]
