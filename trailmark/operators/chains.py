"""Chains and forests of rows by doubling: what is reached from a start, and what comes down from above.

Each round reaches twice as far as the one before, by equi-joins on the rows' keys, so a chain of a million rows takes
twenty rounds, and no task holds a chain.  Rounds are written down (``tables.settled``) and removed when the next is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import forget, settled


class LoopError(ValueError):
    """A chain that comes back to a row it has passed."""


def reached(links: DataFrame, by: Sequence[str], key: str, to: str, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, loops) of following ``key`` to ``to`` from ``starts`` (by, key) in each group.

    Marks: by, key, ``step`` (0 at the start).  Loops: the groups whose chain comes back to a row that it passed; they have no
    marks.  One start a group and one ``to`` a key; null ends a chain, as does a key that has no row.  A null in
    ``by`` is a value like others.
    """
    group = F.struct(*by)
    jump = settled(links.where(F.col(to).isNotNull() & F.col(key).isNotNull()).select(group.alias("_g"), F.col(key).alias("_k"), F.col(to).alias("_t")))
    known = settled(links.select(group.alias("_g"), F.col(key).alias("_k")).distinct())
    parts = [settled(starts.select(group.alias("_g"), F.col(key).alias("_k"), F.lit(0).cast("long").alias("step")))]
    loops: list[DataFrame] = []
    reach = 1
    while True:
        marks = reduce(DataFrame.unionByName, parts)
        ahead = marks.join(jump, ["_g", "_k"]).select("_g", F.col("_t").alias("_k"), (F.col("step") + reach).alias("step")).join(known, ["_g", "_k"], "left_semi")
        ahead = settled(ahead.join(marks.select("_g", "_k", F.lit(True).alias("_passed")), ["_g", "_k"], "left"))
        found, passed = ahead.agg(F.count("*"), F.count("_passed")).first()
        if not found:
            break
        if passed:  # those groups go no further
            loops.append(settled(ahead.where("_passed").select("_g").distinct()))
            stopped, jump = jump, settled(jump.join(loops[-1], "_g", "left_anti"))
            forget(stopped)
        parts.append(ahead.drop("_passed"))
        further = jump.join(jump.select("_g", F.col("_k").alias("_t"), F.col("_t").alias("_n")), ["_g", "_t"]).select("_g", "_k", F.col("_n").alias("_t"))
        stopped, jump = jump, settled(further)
        forget(stopped)
        reach *= 2
    forget(ahead, jump, known)
    if not loops:
        return marks.select("_g.*", F.col("_k").alias(key), "step"), marks.limit(0).select("_g.*")
    looped = reduce(DataFrame.unionByName, loops).distinct()
    return marks.join(looped, "_g", "left_anti").select("_g.*", F.col("_k").alias(key), "step"), looped.select("_g.*")


def inherited(nodes: DataFrame, key: str, parent: str, flag: Column, rounds: int | None = None) -> DataFrame:
    """(key, depth, inherited): whether ``flag`` holds for any node above, and how many there are.

    One row a key; a parent without a row is none.  Nodes in a ring, or below one, have no depth: they inherit.
    """
    rows = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_u"), F.coalesce(flag, F.lit(False)).alias("_f"))
    above = rows.select(F.col("_k").alias("_u"), F.col("_f").alias("_uf"), F.lit(True).alias("_there"))
    met = rows.join(above, "_u", "left")
    there = F.col("_there").isNotNull()
    state = settled(met.select("_k", F.when(there, F.col("_u")).alias("_u"), F.coalesce("_uf", F.lit(False)).alias("_f"), there.cast("long").alias("_d")))
    rounds = rounds if rounds is not None else max(1, state.count()).bit_length()
    for _ in range(rounds):  # after this many only rings go on
        if state.where("_u is not null").isEmpty():
            break
        up = state.select(F.col("_k").alias("_u"), F.col("_u").alias("_n"), F.col("_f").alias("_uf"), F.col("_d").alias("_ud"))
        before = state
        state = settled(
            state.join(up, "_u", "left").select(
                "_k", F.col("_n").alias("_u"), (F.col("_f") | F.coalesce("_uf", F.lit(False))).alias("_f"), (F.col("_d") + F.coalesce("_ud", F.lit(0))).alias("_d")
            )
        )
        forget(before)
    ring = F.col("_u").isNotNull()
    return state.select(F.col("_k").alias(key), F.when(~ring, F.col("_d")).alias("depth"), (F.col("_f") | ring).alias("inherited"))


def pages_in_order(pages: DataFrame, by: Sequence[str], cursor: str, following: str) -> DataFrame:
    """``pages`` with ``page`` (from 0): those that the cursors lead to from the first page (null cursor), each once.

    Raises :class:`LoopError` where a cursor comes back; pages that no cursor leads to are left out, and of a page
    that was landed twice any one stays.
    """
    named = pages.dropDuplicates([*by, cursor])
    key = F.coalesce(F.concat(F.lit("."), F.col(cursor).cast("string")), F.lit(""))  # the first page's is empty
    to = F.concat(F.lit("."), F.nullif(F.col(following).cast("string"), F.lit("")))
    links = settled(named.withColumns({"_key": key, "_to": to}))
    marks, loops = reached(links, by, "_key", "_to", links.where("_key = ''").select(*by, "_key"))
    bad = loops.limit(3).collect()  # three at most, for the message
    if bad:
        raise LoopError(f"a page cursor came back: {[tuple(r) for r in bad]}")
    on = [links[c].eqNullSafe(marks[c]) for c in (*by, "_key")]
    return links.join(marks, on).select(*[links[c] for c in pages.columns], F.col("step").alias("page"))
