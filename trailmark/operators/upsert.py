"""Idempotent writes as DataFrame -> DataFrame functions.

A table is a DataFrame; each function returns its next version.  Matching is by joins on the keys, so
a batch of any size works; conflicts inside a batch are settled by an explicit arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows, counts): rows of ``batch`` whose key is neither in ``target`` nor earlier in the batch,
    and one row of how many were ingested and deduped."""
    fresh = first_by(batch, keys, *order).join(target.select(*keys), list(keys), "left_anti").select(batch.columns)
    total = batch.agg(F.count("*").alias("total"))
    counts = fresh.agg(F.count("*").alias("ingested")).crossJoin(total)  # one row each
    return fresh, counts.select("ingested", (F.col("total") - F.col("ingested")).alias("deduped"))


def coalesce_upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], *, frozen: Sequence[str] = (),
    earliest: Sequence[str] = (), latest: Sequence[str] = (),
) -> DataFrame:
    """Enriching upsert: a value of the batch wins unless null; ``frozen`` columns keep what the row was
    created with; ``earliest`` and ``latest`` columns widen.  One batch row a key."""
    old, new = target.alias("o"), batch.alias("n")
    met = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    known = F.col(f"o.{keys[0]}").isNotNull()
    out = []
    for c in target.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in earliest:
            value = F.least(a, b)
        elif c in latest:
            value = F.greatest(a, b)
        elif c in frozen:
            value = F.when(known, a).otherwise(b)
        else:
            value = F.coalesce(b, a)
        out.append(value.alias(c))
    return met.select(*out)


def replace_set(target: DataFrame, batch: DataFrame, owner: Sequence[str]) -> DataFrame:
    """All rows of the owners in ``batch`` are replaced by the batch's."""
    rest = target.join(batch.select(*owner).distinct(), list(owner), "left_anti")
    return rest.select(target.columns).unionByName(batch.select(target.columns))


def last_write(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Last write wins: the batch's first row by ``order`` replaces a key's row."""
    return replace_set(target, first_by(batch, keys, *order), keys)


def reparent(sessions: DataFrame, source: int | str, to: int | str, owner: int | str | None = None) -> DataFrame:
    """``sessions`` with those of project ``source`` moved to ``to``: the ``owner``'s own, or everybody's."""
    moves = F.col("project_id") == source
    if owner is not None:
        moves &= F.col("user_id") == owner
    return sessions.withColumn("project_id", F.when(moves, F.lit(to)).otherwise(F.col("project_id")))


def replace_problems(target: DataFrame, reviews: DataFrame) -> DataFrame:
    """``target`` (review_id, position, title, ...) with the problems of ``reviews`` (review_id, problems: an array of
    structs) in place of those their reviews had; a position is the place in the array, and no problems leave none."""
    fresh = reviews.select("review_id", F.posexplode("problems").alias("position", "p")).select("review_id", "position", "p.*")
    return replace_problem_rows(target, reviews, fresh)


def replace_problem_rows(target: DataFrame, reviews: DataFrame, problems: DataFrame) -> DataFrame:
    """:func:`replace_problems` where the problems of ``reviews`` (review_id) are rows as in ``target``, so none is gathered."""
    rest = target.join(reviews.select("review_id"), "review_id", "left_anti")
    return rest.select(target.columns).unionByName(problems.select(target.columns))


def observe_commits(target: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`insert_ignore` of commits by repository and hash: the first observation stays."""
    return insert_ignore(target, batch, ["repo_id", "sha"], F.col("observed_at"))


def insert_opened(pulls: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pull requests, links) after a batch of sightings: requests by repository and number are enriched with what is
    not null, first observations keep their time, and a session is linked to a request once."""
    key = ["repo_id", "number"]
    told = [c for c in pulls.columns if c not in key]
    latest = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("observed_at", "session_id"))).alias(c) for c in told}
    folded = batch.groupBy(*key).agg(*[F.min(c).alias(c) if c == "observed_at" else latest[c] for c in told])
    merged = coalesce_upsert(pulls, folded.select(pulls.columns), key, earliest=[c for c in told if c == "observed_at"])
    fresh, _ = insert_ignore(links, batch.select(*links.columns), links.columns)
    return merged, links.unionByName(fresh)


def first_last_seen(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Keys with first and last sighting."""
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def cascade_delete(children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every child table (with its foreign key) without the rows of deleted parents."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {
        name: df.join(ids, df[fk] == ids["_gone"], "left_anti") for name, (df, fk) in children.items()
    }


def null_pointers(child: DataFrame, pointer: str, gone: DataFrame, key: str) -> DataFrame:
    """``child`` with pointers to deleted rows set to null."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    met = child.join(ids, child[pointer] == ids["_gone"], "left")
    return met.withColumn(pointer, F.when(F.col("_gone").isNull(), F.col(pointer))).select(child.columns)


def sync_membership(current: DataFrame, scope: Column, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ``scope`` become exactly ``wanted``; those that stay keep their columns."""
    inside = current.where(scope)
    kept = inside.join(wanted.select(*keys).distinct(), list(keys), "left_semi").select(current.columns)
    new = wanted.join(inside.select(*keys), list(keys), "left_anti")
    outside = current.where(~F.coalesce(scope, F.lit(False)))
    return outside.unionByName(kept).unionByName(new, allowMissingColumns=True)


def one_active(existing: DataFrame, batch: DataFrame, keys: Sequence[str], active: Column, *order: Column) -> DataFrame:
    """Batch rows that may become active: the first of a key, where none of the key is active yet."""
    busy = existing.where(active).select(*keys).distinct()
    return first_by(batch, keys, *order).join(busy, list(keys), "left_anti").select(batch.columns)


def rebuild_tags(tags: Column, add: Sequence[str], remove: Sequence[str]) -> Column:
    """Sorted distinct lower-case tags after removing and adding."""
    def array(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")

    return F.array_sort(F.array_distinct(F.concat(F.array_except(tags, array(remove)), array(add))))


def pull_request_states(stored: DataFrame, answers: DataFrame, checked_at: Column) -> DataFrame:
    """Stored pull requests (repo_id, number, state, closed_at, checked_at) after a lookup: an answer
    without a state keeps state and closing time, and every answer stamps the check."""
    new = answers.select("repo_id", "number", F.col("state").alias("_state"), F.col("closed_at").alias("_closed"), F.lit(True).alias("_asked"))
    met = stored.join(new, ["repo_id", "number"], "left")
    answered = F.col("_state").isNotNull()
    return met.withColumns({
        "closed_at": F.when(answered, F.col("_closed")).otherwise(F.col("closed_at")),
        "state": F.coalesce("_state", "state"),
        "checked_at": F.when(F.col("_asked"), checked_at).otherwise(F.col("checked_at")),
    }).select(stored.columns)


def fold_artifacts(uploads: DataFrame) -> DataFrame:
    """(session_id, path, base, content, change_kind, edit_count) of uploads in order ``ord``: base and
    kind are the first upload's, content the last's."""
    return uploads.groupBy("session_id", "path").agg(
        F.min_by("base", "ord").alias("base"), F.max_by("content", "ord").alias("content"),
        F.min_by("change_kind", "ord").alias("change_kind"), F.count("*").alias("edit_count"),
    )
