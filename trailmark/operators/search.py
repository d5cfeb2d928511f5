"""Search over documents of several kinds: what is indexed, Boolean match of token arrays, best source, order and pages.

Stored documents are searched through :mod:`postings`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.query import Operand, parse

#: What a match in each kind of document weighs.
WEIGHTS = {"session": 4.0, "message": 1.5, "pullRequest": 3.0, "toolCall": 1.0, "toolResult": 0.75}
#: Characters indexed of a text, and characters of a token that are not indexed.
CAP, LONG_TOKEN = 32_768, 2_040


def cap(text: Column) -> Column:
    """What is indexed of a text: without over-long tokens, CAP characters, without a token cut at the end."""
    # a run is tried where it begins, and only texts that are long enough to need it are looked through
    short = F.when(F.octet_length(text) < LONG_TOKEN, text).otherwise(F.regexp_replace(text, rf"(?<!\S)\S{{{LONG_TOKEN},}}", ""))
    cut = F.substring(short, 1, CAP)
    broken = F.substring(short, CAP, 2).rlike(r"^\S\S$")
    whole = F.when(broken, F.regexp_replace(cut, r"(?<!\S)\S+$", "")).otherwise(cut)
    return F.when(F.octet_length(text) < LONG_TOKEN, text).otherwise(whole)


#: What is searched of each kind of row, in this order, with a space between.
SEARCHED = {
    "session": ("name", "description", "title", "id"), "message": ("id", "content", "details"), "pullRequest": ("title",),
    "toolCall": ("tool_id", "tool_input"), "toolResult": ("tool_id", "result"),
}


def search_text(kind: str, have: dict[str, Column]) -> Column:
    """What is indexed of a row of a kind: its columns in order, null as empty, capped.  JSON columns come as text."""
    return cap(F.array_join(F.array(*[F.coalesce(have[c].cast("string"), F.lit("")) for c in SEARCHED[kind]]), " "))


def tokens(text: Column) -> Column:
    """Lower-case words in order: runs of letters, marks and decimal digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0))


def _operand(words: Column, operand: Operand) -> Column:
    lexemes = operand.lexemes
    if len(lexemes) == 1:
        if operand.prefix:
            return F.exists(words, lambda w: w.startswith(lexemes[0]))
        return F.array_contains(words, lexemes[0])
    if not operand.phrase:
        out = F.lit(True)
        for lexeme in lexemes:
            out = out & F.array_contains(words, lexeme)
        return out
    # neighbours: texts and phrase between separators that no token holds
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {' '.join(lexemes)} ")


def matches(words: Column, query: str | list[list[Operand]]) -> Column:
    """Whether token array ``words`` fulfils the query."""
    branches = parse(query) if isinstance(query, str) else query
    out = F.lit(False)
    for branch in branches:
        all_of = F.lit(True)
        for operand in branch:
            hit = _operand(words, operand)
            all_of = all_of & (~hit if operand.excluded else hit)
        out = out | all_of
    return out


def best_source(hits: DataFrame, by: str = "id") -> DataFrame:
    """One row for each session: its best hit, and in how many rows it was found.

    Hits: ``by``, source_kind, source_row, score.  Equal scores go by kind as listed in WEIGHTS, then by
    row id.
    """
    kinds = F.array(*[F.lit(k) for k in WEIGHTS])
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), F.array_position(kinds, F.col("source_kind")), "source_row")
    every = Window.partitionBy(by)
    return hits.withColumns({"_r": F.row_number().over(best), "matched_rows": F.count("*").over(every)}).where("_r = 1").drop("_r")


def sort_keys(order: str | None, searching: bool) -> list[Column]:
    """Sort keys of a session list.  ``oldest`` is ``recent`` exactly reversed; relevance needs a query
    and is the default with one."""
    order = order or ("relevance" if searching else "recent")
    if order == "relevance" and not searching:
        order = "recent"
    active, key = F.col("last_active_at"), F.col("id")
    return {
        "recent": [active.desc_nulls_first(), key.asc()],
        "oldest": [active.asc_nulls_last(), key.desc()],
        "project": [F.col("project_name").asc(), key.asc()],
        "relevance": [F.col("score").desc(), F.col("matched_rows").desc(), active.desc_nulls_first(), key.asc()],
    }[order]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50) -> DataFrame:
    """One page: at most 100 rows, pages from 1."""
    limit = max(1, min(limit, 100))
    return df.orderBy(*order).offset((max(number, 1) - 1) * limit).limit(limit)


def counted_page(df: DataFrame, order: list[Column], number: int = 1, limit: int = 50) -> DataFrame:
    """A page's rows with ``total`` rows and ``total_pages`` of the whole list; a page behind the last has no rows.

    The total is an aggregate of its own, combined before the shuffle, not a window over all rows in one task.
    """
    limit = max(1, min(limit, 100))
    total = df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit).cast("int"))
    return page(df, order, number, limit).crossJoin(F.broadcast(total))  # one row
