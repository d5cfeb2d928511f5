"""Work queues as transitions of tables at an explicit instant ``as_of``; one writer applies them."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .upsert import first_by

#: Fixed value: kinds of message that nobody reads as news.
SILENT = ("usage", "turnEvent")


def due_at(as_of: datetime, zone: str, at: str) -> datetime:
    """Today's local time ``at`` (HH:MM) as an instant."""
    local = as_of.astimezone(ZoneInfo(zone))
    hour, minute = map(int, at.split(":"))
    return datetime(local.year, local.month, local.day, hour, minute, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC"))


def due_for_pick(projects: DataFrame, as_of: datetime, zone: str, at: str) -> DataFrame:
    """Projects with automatic review whose daily time has come and that were not picked since."""
    due = due_at(as_of, zone, at)
    if as_of < due:
        return projects.where(F.lit(False))
    last = F.col("last_nightly_pick_at")
    return projects.where(F.col("auto_review") & (last.isNull() | (last < F.lit(due))))


def nightly_pick(
    projects: DataFrame, sessions: DataFrame, runs: DataFrame, messages: DataFrame, pull_requests: DataFrame,
    *, as_of: datetime, zone: str = "UTC", at: str = "00:00", analyzer: str, limit: int = 5,
    quiet_hours: int = 4, within_days: int = 7, new_messages: int = 1,
) -> DataFrame:
    """Reviews to queue: session_id, project_id, rank, based_on, new_part_only.

    Sessions of due projects that were active lately and may be reviewed: never reviewed, or done with
    new user messages since, or failed with any message stored since.  They must be quiet or have a pull
    request that ended after their last run.  Per project the never reviewed come first, then ended pull
    requests, then the longest idle.
    """
    sessions = sessions.join(due_for_pick(projects, as_of, zone, at).select("project_id"), "project_id", "left_semi")
    sessions = sessions.where(F.col("activity_at") > F.lit(as_of - timedelta(days=within_days)))
    own = runs.where(F.col("analyzer") == analyzer)
    last = first_by(own, ["session_id"], F.col("created_at").desc(), F.col("run_id").desc()).select(
        "session_id", F.col("run_id").alias("_last"), F.col("status").alias("_status"),
        F.col("updated_at").alias("_at"), F.col("last_message_at").alias("_read"),
    )
    done = own.where("status = 'done'").groupBy("session_id").agg(F.max_by("run_id", "created_at").alias("based_on"))
    base = sessions.join(last, "session_id", "left").join(done, "session_id", "left")
    # only the candidates' messages are read on
    asked = last.join(sessions.select("session_id"), "session_id", "left_semi")
    news = messages.join(asked, "session_id").groupBy("session_id").agg(
        F.count_if((F.col("role") == "user") & (F.col("msg_type") == "message") & (F.col("ts") > F.col("_read"))).alias("_typed"),
        F.count_if(~F.col("msg_type").isin(*SILENT) & (F.col("created_at") > F.col("_at"))).alias("_stored"),
    )
    ended = pull_requests.where(F.col("state").isin("merged", "closed")).groupBy("session_id").agg(F.max("closed_at").alias("_ended"))
    base = base.join(news, "session_id", "left").join(ended, "session_id", "left")
    fresh = F.col("_last").isNull()
    pickable = fresh | ((F.col("_status") == "done") & (F.col("_typed") >= new_messages)) | ((F.col("_status") == "failed") & (F.col("_stored") > 0))
    pr_ended = F.coalesce(F.col("_ended").isNotNull() & (fresh | (F.col("_ended") > F.col("_at"))), F.lit(False))
    ready = base.withColumns({"_fresh": fresh, "_pr": pr_ended}).where(F.coalesce(pickable, F.lit(False)))
    ready = ready.where(F.col("_pr") | (F.col("activity_at") <= F.lit(as_of - timedelta(hours=quiet_hours))))
    order = Window.partitionBy("project_id").orderBy(F.col("_fresh").desc(), F.col("_pr").desc(), "activity_at", "session_id")
    return ready.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "session_id", "project_id", "rank", "based_on", F.col("based_on").isNotNull().alias("new_part_only")
    )


def claim(queue: DataFrame, ready: Column | None = None, slots: int = 1) -> DataFrame:
    """The queue after the oldest waiting rows were claimed: running, one more attempt."""
    waiting = queue.where(F.col("status") == "waiting")
    waiting = waiting if ready is None else waiting.where(ready)
    taken = waiting.orderBy("created_at", "id").limit(slots).select("id", F.lit(True).alias("_taken"))
    met = queue.join(taken, "id", "left")
    return met.withColumns({
        "status": F.when(F.col("_taken"), "running").otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.when(F.col("_taken"), 1).otherwise(0),
    }).select(queue.columns)


def settle_failures(queue: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """The queue after attempts failed: waiting again, or failed for good after ``most`` attempts."""
    met = queue.join(failed.select("id", F.lit(True).alias("_failed")).distinct(), "id", "left")
    again = F.when(F.col("attempts") >= most, "failed").otherwise("waiting")
    return met.withColumn("status", F.when(F.col("_failed"), again).otherwise(F.col("status"))).select(queue.columns)


def due_fix_runs(projects: DataFrame, problems: DataFrame, fix_runs: DataFrame, as_of: datetime) -> DataFrame:
    """Projects with unread problems, a rhythm in days, no open run and none started within the rhythm."""
    new = problems.where("learning_run_id is null").select("project_id").distinct()
    since = F.lit(as_of) - F.make_dt_interval(F.col("fix_run_every_days"))
    busy = fix_runs.join(projects.select("project_id", "fix_run_every_days"), "project_id").where(
        F.col("status").isin("waiting", "running") | (F.col("started_at") > since)
    )
    return projects.where("fix_run_every_days is not null").join(new, "project_id", "left_semi").join(busy.select("project_id").distinct(), "project_id", "left_anti")


def backoff_seconds(attempts: Column, first: int = 5, most: int | None = None) -> Column:
    """first * 2^(attempts-1), at most ``most``."""
    wait = F.lit(first) * F.pow(F.lit(2), attempts - 1)
    return F.least(wait, F.lit(float(most))) if most is not None else wait
