"""Fixes and the problems behind them: saving groups, finding projects, lists of events, batches of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: New fixes of a run by priority, problems of a batch, events listed, pull requests checked.
CAPS = {"high": 5, "medium": 8}
BATCH, LISTED, CHECKED = 100, 200, 200


def save_groups(groups: DataFrame, problems: DataFrame, learnings: DataFrame) -> DataFrame:
    """(group_id, action, learning_id, problem_ids): what saving each group does.

    Groups have group_id, learning_id (null: new), verdict (learning, link, drop) and problem_ids.  Problems
    that are gone or marked by a run are left out, and a group without any is skipped; groups of a rejected
    fix, and such with verdict link, only link.
    """
    asked = groups.select("group_id", F.explode("problem_ids").alias("problem_id")).distinct()
    free = problems.where("learning_run_id is null").select("problem_id")
    present = asked.join(free, "problem_id").groupBy("group_id").agg(F.array_sort(F.collect_list("problem_id")).alias("present"))
    known = learnings.select("learning_id", F.col("decision").alias("_decision"))
    met = groups.drop("problem_ids").join(present, "group_id", "left").join(known, "learning_id", "left")
    linking = (F.col("_decision") == "rejected") | (F.col("verdict") == "link")
    linking = F.coalesce(linking, F.lit(False))
    action = (
        F.when(F.col("present").isNull(), "skipped").when(linking, "linked").when(F.col("verdict") == "drop", "dropped")
        .when(F.col("learning_id").isNull(), "created").otherwise("updated")
    )
    keeps = action.isin("linked", "updated")
    return met.select("group_id", action.alias("action"), F.when(keeps, F.col("learning_id")).alias("learning_id"), F.coalesce("present", F.array()).alias("problem_ids"))


def within_caps(ranked: DataFrame, taken: dict[str, int], *order: Column) -> DataFrame:
    """Proposed fixes that still fit in a run's caps by priority, the first by ``order``; priorities without a
    cap all fit."""
    place = F.row_number().over(Window.partitionBy("priority").orderBy(*order))
    left = F.lit(None).cast("int")
    for name, most in CAPS.items():
        left = F.when(F.col("priority") == name, most - taken.get(name, 0)).otherwise(left)
    return ranked.withColumn("_n", place).where(left.isNull() | (F.col("_n") <= left)).drop("_n")


def unmarked(problems: DataFrame, limit: int = BATCH) -> DataFrame:
    """The oldest problems that no run has marked."""
    return problems.where("learning_run_id is null").orderBy("created_at", "problem_id").limit(limit)


def find_or_create(asked: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, org_slug, slug, project_id, owner_kind, owner_id, created): the project of each request.

    The owner is the organisation (slug compared without case) if the user is a member of it, else the user.
    """
    orgs = members.select("user_id", F.lower("org_slug").alias("_org"), F.col("org_id").alias("_org_id")).distinct()
    named = asked.join(orgs, (asked["user_id"] == orgs["user_id"]) & (F.lower(asked["org_slug"]) == orgs["_org"]), "left").select(asked["*"], "_org_id")
    owned = named.withColumns({
        "owner_kind": F.when(F.col("_org_id").isNotNull(), "org").otherwise("user"), "owner_id": F.coalesce("_org_id", "user_id"),
    }).drop("_org_id")
    known = projects.select("slug", "owner_kind", "owner_id", "project_id")
    out = owned.join(known, ["slug", "owner_kind", "owner_id"], "left")
    return out.withColumn("created", F.col("project_id").isNull())


def visible_events(events: DataFrame, own: str, visible_projects: DataFrame) -> DataFrame:
    """Events of a user's own or of projects they see; project columns of others are masked."""
    seen = visible_projects.select("project_id", F.lit(True).alias("_seen")).distinct()
    met = events.join(seen, "project_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    met = met.where((F.col("user_id") == own) | F.col("_seen"))
    masked = {c: F.when(F.col("_seen"), F.col(c)) for c in events.columns if c.startswith("project_")}
    return met.withColumns(masked).drop("_seen").select(events.columns)


def newest_events(events: DataFrame, limit: int = LISTED) -> DataFrame:
    return events.orderBy(F.col("timestamp").desc(), "event_id").limit(limit)


def pull_requests_to_check(pulls: DataFrame, before: Column, limit: int = CHECKED) -> DataFrame:
    """Open pull requests that were not checked since ``before``, never checked ones first."""
    due = pulls.where((F.col("state") == "open") & (F.col("checked_at").isNull() | (F.col("checked_at") < before)))
    return due.orderBy(F.col("checked_at").asc_nulls_first(), "repo_id", "number").limit(limit)


def review_batch(sessions: DataFrame, runs: DataFrame, news: DataFrame, analyzer: str) -> DataFrame:
    """(session_id, queue): what asking for reviews of sessions does: ``full`` for those never reviewed,
    ``newPart`` where messages came since, ``skip`` otherwise or while a run is active."""
    own = runs.where(F.col("analyzer") == analyzer).groupBy("session_id").agg(
        F.bool_or(F.col("status").isin("waiting", "running")).alias("_active"), F.bool_or(F.col("status") == "done").alias("_done")
    )
    met = sessions.select("session_id").join(own, "session_id", "left").join(news.select("session_id", F.lit(True).alias("_new")).distinct(), "session_id", "left")
    no = F.lit(False)
    queue = (
        F.when(F.coalesce("_active", no), "skip").when(~F.coalesce("_done", no), "full").when(F.coalesce("_new", no), "newPart").otherwise("skip")
    )
    return met.select("session_id", queue.alias("queue"))


def fix_run_ready(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """The oldest waiting run whose project has no review waiting or running."""
    busy = reviews.where("status in ('waiting', 'running')").select("project_id").distinct()
    return queue.where("status = 'waiting'").join(busy, "project_id", "left_anti").orderBy("created_at", "id").limit(1)


def last_read(messages: DataFrame) -> DataFrame:
    """(session_id, message_id): the latest message of a session by time (of equals the later one), else the
    last of its main track."""
    timed = F.when(F.col("ts").isNotNull(), F.struct("ts", "pos"))
    lined = F.when(F.col("track_id") == "main", F.col("line"))
    return messages.groupBy("session_id").agg(
        F.coalesce(F.max_by("message_id", timed), F.max_by("message_id", lined)).alias("message_id")
    )


def knowledge(lessons: DataFrame) -> DataFrame:
    """(audience, markdown): lessons (audience, category, title, body) as one text an audience, in order."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("category", "title", part.alias("p"))))
    return lessons.groupBy("audience").agg(F.array_join(F.transform(rows, lambda x: x["p"]), "\n\n").alias("markdown"))
