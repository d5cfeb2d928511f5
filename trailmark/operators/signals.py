"""Review signals of sessions from their event streams, without reading prose.

Events: session_id, seq, kind (userMessage, turn, toolCall, toolResult, edit, compaction, commit,
pullRequest, tokens), status, call_id, name, path, is_meta, input, output, cached, thinking.  A session
is one ordered window; running counts take the place of a pass over its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .runs import number_runs

#: Failures in a row that make a loop, and that make a prompt a correction.
LOOP, CORRECTION = 3, 2
#: Counts from which a signal becomes a lesson.
REWORK, REPROMPTS, ABORTS, COMPACTIONS = 3, 2, 2, 2

def _session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("seq")


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def named_results(events: DataFrame) -> DataFrame:
    """Tool results with the tool's name: their own, else that of the latest earlier call of that id."""
    calls = Window.partitionBy("session_id", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    called = F.last(F.when(_is("toolCall"), F.col("name")), ignorenulls=True).over(calls)
    tool = F.coalesce("name", F.when(F.col("call_id").isNotNull(), called), F.lit("unknown tool"))
    # dealt by session, which also serves the windows over calls and whatever follows by session
    both = events.where(F.col("kind").isin("toolCall", "toolResult")).repartition("session_id")
    return both.withColumn("tool", tool).where(_is("toolResult"))


def error_loops(events: DataFrame, least: int = LOOP) -> DataFrame:
    """(session_id, tool, failures, first_seq, last_seq): failures of one tool in a row.  Another tool's
    failure or any other result ends a row; events of other kinds don't."""
    results = named_results(events)
    failed = F.coalesce(F.col("status") == "failure", F.lit(False))
    prior = F.lag(F.when(failed, F.col("tool"))).over(_session())
    runs = number_runs(results, ["session_id"], ["seq"], ~(failed & prior.eqNullSafe(F.col("tool"))))
    return (
        runs.where(failed)
        .groupBy("session_id", "run", "tool")
        .agg(F.count("*").alias("failures"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .where(F.col("failures") >= least)
        .drop("run")
    )


def prompts(events: DataFrame) -> DataFrame:
    """(session_id, seq, correction, reprompt) of every real prompt.  A correction follows two failures or
    more since the prompt before; a re-prompt follows that prompt with nothing but meta messages between."""
    real = _is("userMessage") & ~F.coalesce("is_meta", F.lit(False))
    kept = events.where(real | ~_is("userMessage"))
    kept = kept.withColumns({
        "_asked": F.sum(real.cast("int")).over(_session().rowsBetween(Window.unboundedPreceding, -1)),
        "_failed": (_is("toolResult") & (F.col("status") == "failure")).cast("int"),
        "_previous": F.lag("kind").over(_session()),
    })
    since = Window.partitionBy("session_id", "_asked").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_failures", F.sum(F.coalesce("_failed", F.lit(0))).over(since))
    return kept.where(real).select(
        "session_id", "seq",
        (F.col("_failures") >= CORRECTION).alias("correction"),
        F.coalesce(F.col("_previous") == "userMessage", F.lit(False)).alias("reprompt"),
    )


def churn(events: DataFrame) -> DataFrame:
    """(session_id, path, edit_count, place): edits by path, the most edited first, ties by first edit."""
    by = events.where(_is("edit")).groupBy("session_id", "path").agg(F.count("*").alias("edit_count"), F.min("seq").alias("first"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("edit_count").desc(), "first"))
    return by.withColumn("place", place).drop("first")


def analyze(events: DataFrame) -> DataFrame:
    """One row a session: counters, rates, loops, churn, outcome and summary."""
    def n(condition: Column) -> Column:
        return F.count_if(condition)

    failure = _is("toolResult") & (F.col("status") == "failure")
    def total(name):
        return F.coalesce(F.sum(F.when(_is("tokens"), F.col(name))), F.lit(0)).alias(f"{name}_tokens")

    counted = events.groupBy("session_id").agg(
        n(_is("turn")).alias("turns"), n(_is("turn") & (F.col("status") == "aborted")).alias("aborted_turns"),
        n(_is("userMessage") & ~F.coalesce("is_meta", F.lit(False))).alias("user_prompts"),
        n(_is("toolCall")).alias("tool_calls"), n(failure).alias("tool_failures"),
        n(_is("compaction")).alias("compactions"), n(_is("commit")).alias("commits"),
        n(_is("pullRequest")).alias("pull_requests"), total("input"), total("output"), total("cached"), total("thinking"),
        F.max_by(F.when(_is("turn"), F.coalesce("status", F.lit(""))), F.when(_is("turn"), F.col("seq"))).alias("_last_turn"),
    )
    asked = prompts(events).groupBy("session_id").agg(
        F.count_if("correction").alias("corrections"), F.count_if("reprompt").alias("rapid_reprompts"),
        F.array_sort(F.collect_list(F.when(F.col("correction"), F.col("seq")))).alias("correction_seqs"),
        F.array_sort(F.collect_list(F.when(F.col("reprompt"), F.col("seq")))).alias("reprompt_seqs"),
    )
    loop = F.struct("first_seq", "last_seq", "tool", "failures")
    loops = error_loops(events).groupBy("session_id").agg(F.array_sort(F.collect_list(loop)).alias("error_loops"))
    edits = churn(events).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "path", "edit_count"))).alias("edits")
    )
    out = counted.join(asked, "session_id", "left").join(loops, "session_id", "left").join(edits, "session_id", "left")
    out = out.withColumns({
        "corrections": F.coalesce("corrections", F.lit(0)), "rapid_reprompts": F.coalesce("rapid_reprompts", F.lit(0)),
        "tool_failure_rate": F.when(F.col("tool_calls") == 0, 0.0).otherwise(F.round(F.col("tool_failures") / F.col("tool_calls"), 3)),
    })
    struggled = (F.coalesce(F.size("error_loops"), F.lit(0)) > 0) | (F.col("tool_failure_rate") > 0.25) | (F.col("corrections") >= 2)
    outcome = (
        F.when((F.col("_last_turn") == "aborted") & (F.col("commits") == 0), "aborted")
        .when((F.col("commits") > 0) | (F.col("pull_requests") > 0), "shipped")
        .when(struggled, "struggled")
        .otherwise("productive")
    )
    def counted_as(column, word):
        return F.concat(F.col(column).cast("string"), F.lit(f" {word}"), F.when(F.col(column) == 1, "").otherwise("s"))

    out = out.withColumn("outcome", outcome).drop("_last_turn")
    said = [counted_as(c, w) for c, w in (("turns", "turn"), ("tool_calls", "tool call"), ("tool_failures", "failure"), ("commits", "commit"))]
    return out.withColumn("summary", F.concat(F.col("outcome"), F.lit(": "), F.concat_ws(", ", *said)))


def fingerprint(audience: str, category: str, subject: Column) -> Column:
    """Identity of a lesson: its subject, without any counts."""
    return F.substring(F.sha2(F.concat(F.lit(f"{audience}:{category}:"), subject), 256), 1, 16)


def lessons(events: DataFrame) -> DataFrame:
    """(session_id, audience, category, subject, n, fingerprint, evidence): what a session suggests to
    learn; evidence holds the first four sequence numbers and the last."""
    loops = error_loops(events)
    failed = named_results(events).where("status = 'failure'").select("session_id", "seq", "tool")
    in_loop = loops.join(failed, ["session_id", "tool"]).where("seq between first_seq and last_seq")
    parts = [
        in_loop.select("session_id", F.lit("agent").alias("audience"), F.lit("tool-retry").alias("category"), F.col("tool").alias("subject"), F.col("first_seq").alias("part"), "seq", F.lit(LOOP).alias("least")),
    ]
    def rule(rows, audience, category, subject, least):
        parts.append(rows.select(
            "session_id", F.lit(audience).alias("audience"), F.lit(category).alias("category"),
            (subject if subject is not None else F.lit(category)).alias("subject"), F.lit(0).cast("long").alias("part"), "seq", F.lit(least).alias("least"),
        ))

    asked = prompts(events)
    rule(events.where(_is("edit")), "agent", "rework", F.col("path"), REWORK)
    rule(asked.where("correction"), "human", "supervision", None, 1)
    rule(asked.where("reprompt"), "human", "prompt-shape", None, REPROMPTS)
    rule(events.where(_is("turn") & (F.col("status") == "aborted")), "human", "task-shape", None, ABORTS)
    rule(events.where(_is("compaction")), "agent", "context-hygiene", None, COMPACTIONS)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    seqs = F.array_sort(F.collect_list("seq"))
    out = rows.groupBy("session_id", "audience", "category", "subject", "part", "least").agg(seqs.alias("seqs"))
    n = F.size("seqs")
    ends = F.concat(F.slice("seqs", 1, 4), F.slice("seqs", -1, 1))
    name = F.concat_ws(":", "audience", "category", "subject")
    return out.where(n >= F.col("least")).select(
        "session_id", "audience", "category", "subject", n.alias("n"),
        F.substring(F.sha2(name, 256), 1, 16).alias("fingerprint"),
        F.when(n <= 5, F.col("seqs")).otherwise(ends).alias("evidence"),
    )
