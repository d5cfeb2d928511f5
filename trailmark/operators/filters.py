"""Who may see what, windows of activity, and filters of the session list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from uuid import UUID
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scopes from the least to the most.
SCOPES = ("viewer", "editor", "admin")


def visible(items: DataFrame, key: str, paths: Sequence[DataFrame]) -> DataFrame:
    """Items whose ``key`` any of ``paths`` (one-column frames of ids) grants; each item once."""
    ids = None
    for p in paths:
        p = p.toDF("_id")
        ids = p if ids is None else ids.unionByName(p)
    return items.join(ids.distinct(), items[key] == F.col("_id"), "left_semi")


def authority(grants: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id, scope): the highest scope of grants (with a scope) and organisation
    membership, which is worth editor."""
    order = F.array(*[F.lit(s) for s in SCOPES])
    both = grants.select("user_id", "project_id", F.array_position(order, F.col("scope")).alias("rank"))
    both = both.unionByName(members.select("user_id", "project_id", F.lit(2).cast("long").alias("rank")))
    best = both.groupBy("user_id", "project_id").agg(F.max("rank").alias("rank")).where("rank > 0")
    return best.select("user_id", "project_id", F.element_at(order, F.col("rank").cast("int")).alias("scope"))


def local_midnight(day: datetime, zone: str) -> datetime:
    """The first instant of a local day; where midnight is skipped, the first one after it."""
    tz, utc = ZoneInfo(zone), ZoneInfo("UTC")
    start = datetime(day.year, day.month, day.day, tzinfo=tz)
    instant = start.astimezone(utc)
    while instant.astimezone(tz).date() < start.date():
        instant += timedelta(minutes=15)
    return instant


def date_window(kind: str, now: datetime, zone: str = "UTC", since: str | None = None, until: str | None = None) -> tuple[datetime | None, datetime | None]:
    """[from, to) of hour, today, week, month or custom (ISO days, the last one included) in a zone."""
    local = now.astimezone(ZoneInfo(zone))
    if kind == "hour":
        return now - timedelta(hours=1), None
    if kind == "today":
        return local_midnight(local, zone), None
    if kind in ("week", "month"):
        return local_midnight(local - timedelta(days=7 if kind == "week" else 30), zone), None
    if kind != "custom":
        raise ValueError(kind)
    start = local_midnight(datetime.fromisoformat(since), zone) if since else None
    end = local_midnight(datetime.fromisoformat(until) + timedelta(days=1), zone) if until else None
    return start, end


def within(at: Column, since=None, until=None) -> Column:
    """Half-open [since, until); a missing bound does not limit."""
    out = F.lit(True)
    if since is not None:
        out = out & (at >= F.lit(since))
    if until is not None:
        out = out & (at < F.lit(until))
    return out


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted]))


def commits_named(commits: DataFrame, prefix: str, column: str = "sha") -> DataFrame:
    """The rows of the one visible commit that a prefix means: an exact one wins, none gives no rows, and several
    fail the query that reads them."""
    low = prefix.lower()
    found = commits.where(F.col(column).startswith(low)).agg(
        F.bool_or(F.col(column) == low).alias("exact"), F.min(column).alias("least"), F.max(column).alias("most")
    )  # one row
    several = F.raise_error(F.lit(f"{prefix} names more than one commit"))
    one = F.when(F.col("exact"), F.lit(low)).when(F.col("least") == F.col("most"), F.col("least")).when(F.col("least").isNotNull(), several)
    return commits.join(F.broadcast(found.select(one.alias(column))), column, "left_semi")


def on_branch(sessions: DataFrame, key: str, messages: DataFrame, commits: DataFrame, pulls: DataFrame, branch: str) -> DataFrame:
    """Sessions that a branch shows up in: of a message, of a commit, or as base or head of a pull request."""
    here = F.lit(branch)
    paths = [
        messages.where(F.col("branch") == here), commits.where(F.col("branch") == here),
        pulls.where((F.col("base_branch") == here) | (F.col("head_branch") == here)),
    ]
    return visible(sessions, key, [p.select("session_id") for p in paths])


def of_pull_request(sessions: DataFrame, key: str, pulls: DataFrame, number: int) -> DataFrame:
    """Sessions linked to a pull request of that number, in any repository."""
    return visible(sessions, key, [pulls.where(F.col("number") == number).select("session_id")])


def holding(rows: DataFrame, user: str = "", project: str = "") -> DataFrame:
    """Rows whose user and project names hold what was typed, in any case; nothing typed does not limit."""
    for column, typed in (("user_name", user), ("project_name", project)):
        if typed.strip():
            rows = rows.where(F.contains(F.lower(column), F.lit(typed.strip().lower())))
    return rows


#: The domains of a list's parameters.
MOST_PULL, MOST_TAGS, MOST_TAG, MOST_BRANCH, MOST_PAGE, MOST_LIMIT = 2**31 - 1, 50, 32, 255, 100_000, 100


def parameters(**given: str) -> dict:
    """The parameters of a session list in their types: project, branch, tags, pr, commit, since, until, page, limit
    and zone.  What is outside its domain raises ``ValueError`` with the parameter's name."""
    def whole(text: str, least: int, most: int) -> int:
        if not (text.isascii() and text.isdigit() and least <= int(text) <= most):
            raise ValueError
        return int(text)

    def hexadecimal(text: str) -> str:
        if not 7 <= len(text) <= 40:
            raise ValueError
        int("0x" + text if text.isalnum() else "-", 16)
        return text.lower()

    def tag_list(text: str) -> list[str]:
        tags = list(dict.fromkeys(t.strip().lower() for t in text.split(",")))
        if len(text.split(",")) > MOST_TAGS or not all(0 < len(t) <= MOST_TAG and len(t.split()) == 1 for t in tags):
            raise ValueError
        return tags

    def identifier(text: str) -> str:
        text = text.strip()
        if [len(x) for x in text.split("-")] != [8, 4, 4, 4, 12]:
            raise ValueError
        return str(UUID(text))

    def branch_name(text: str) -> str:
        if not text.strip() or len(text) > MOST_BRANCH:
            raise ValueError
        return text

    def zone_name(text: str) -> str:
        return ZoneInfo(text.strip()).key

    domain = {
        "project": identifier, "branch": branch_name, "tags": tag_list, "pr": lambda x: whole(x, 1, MOST_PULL), "commit": hexadecimal,
        "since": lambda x: datetime.strptime(x, "%Y-%m-%d").date(), "until": lambda x: datetime.strptime(x, "%Y-%m-%d").date(),
        "page": lambda x: whole(x, 1, MOST_PAGE), "limit": lambda x: whole(x, 1, MOST_LIMIT), "zone": zone_name,
    }
    out = {}
    for name, text in given.items():
        try:
            out[name] = domain[name](text)
        except (ValueError, KeyError, OSError) as e:
            raise ValueError(f"{name}: {text!r}") from e
    return out


def shown_runs(runs: DataFrame) -> DataFrame:
    """Finished runs that no newer finished full run of the session and analyzer replaces."""
    w = Window.partitionBy("session_id", "analyzer")
    newest = F.max(F.when((F.col("status") == "done") & ~F.col("new_part_only"), F.col("created_at"))).over(w)
    return runs.where("status = 'done'").withColumn("_n", newest).where("_n is null or created_at >= _n").drop("_n")


def distinct_facets(parts: dict[str, Column], df: DataFrame) -> DataFrame:
    """(facet, value): the distinct values of several columns, distinct before they are united."""
    out = None
    for name, column in parts.items():
        one = df.select(column.cast("string").alias("value")).where("value is not null").distinct()
        one = one.select(F.lit(name).alias("facet"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def unsafe_path(path: Column) -> Column:
    """Why a path must not be uploaded: outside, secret or noise, the gravest first; null if it may be."""
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.split(path, "/")
    outside = path.startswith("/") | F.array_contains(folders, "..")
    secret = name.rlike(r"(?i)^(\.env(\..*)?|id_(rsa|dsa|ecdsa|ed25519)|.*\.(pem|key|p12|pfx))$") | F.arrays_overlap(folders, F.array(F.lit(".ssh"), F.lit(".aws"), F.lit(".gnupg")))
    noise = F.arrays_overlap(folders, F.array(F.lit("node_modules"), F.lit(".git"), F.lit("dist"), F.lit("__pycache__")))
    return F.when(outside, "outside").when(secret, "secret").when(noise, "noise")
