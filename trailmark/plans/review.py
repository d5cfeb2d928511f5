"""Review queries: the events table is the stream of a user's session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import runs, signals
from .registry import load, query

_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
#: The stream in SQL: errors are failed results, views and clicks good ones, signups prompts.
_STREAM = f"""
stream AS (
  SELECT user_id AS session_id, row_number() OVER ({_ORDER}) AS seq, event_type,
         CASE event_type WHEN 'signup' THEN 'userMessage' WHEN 'purchase' THEN 'commit' ELSE 'toolResult' END AS kind,
         event_type = 'error' AS failed, (value::BIGINT % 2)::INT AS tool FROM events)
"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a review stream; an event's tool is the parity of its rounded value."""
    kind = F.when(F.col("event_type") == "signup", "userMessage").when(F.col("event_type") == "purchase", "commit").otherwise("toolResult")
    status = F.when(F.col("event_type") == "error", "failure").when(kind == "toolResult", "success")
    none = F.lit(None)
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        kind.alias("kind"), status.alias("status"), none.cast("string").alias("call_id"),
        F.when(kind == "toolResult", (F.rint("value").cast("long") % 2).cast("string")).alias("name"),
        none.cast("string").alias("path"), F.lit(False).alias("is_meta"),
        *[none.cast("long").alias(c) for c in ("input", "output", "cached", "thinking")],
    )


@query(f"""
WITH {_STREAM}, results AS (SELECT *, lag(CASE WHEN failed THEN tool END) OVER (PARTITION BY session_id ORDER BY seq) AS prior FROM stream WHERE kind = 'toolResult'),
marked AS (SELECT *, sum(CASE WHEN failed AND prior IS NOT DISTINCT FROM tool THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM results)
SELECT session_id, tool::VARCHAR AS tool, count(*) AS failures, min(seq) AS first_seq, max(seq) AS last_seq
FROM marked WHERE failed GROUP BY session_id, run, tool HAVING count(*) >= 3
""")
def error_loops(spark, sf_dir):
    """Three failures or more of one tool in a row."""
    return signals.error_loops(stream(spark, sf_dir))


_PROMPTS = f"""
{_STREAM}, numbered AS (SELECT *, coalesce(sum((kind = 'userMessage')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS asked,
  lag(kind) OVER (PARTITION BY session_id ORDER BY seq) AS previous FROM stream),
counted AS (SELECT *, sum(failed::INT) OVER (PARTITION BY session_id, asked ORDER BY seq) AS failures FROM numbered),
prompts AS (SELECT session_id, seq, failures >= 2 AS correction, coalesce(previous = 'userMessage', false) AS reprompt FROM counted WHERE kind = 'userMessage')
"""


@query(f"WITH {_PROMPTS} SELECT session_id, seq FROM prompts WHERE correction")
def corrections(spark, sf_dir):
    """Prompts after two failures or more since the prompt before."""
    return signals.prompts(stream(spark, sf_dir)).where("correction").select("session_id", "seq")


@query(f"WITH {_PROMPTS} SELECT session_id, seq FROM prompts WHERE reprompt")
def rapid_reprompts(spark, sf_dir):
    """Prompts that directly follow a prompt."""
    return signals.prompts(stream(spark, sf_dir)).where("reprompt").select("session_id", "seq")


@query(f"""
WITH {_PROMPTS},
results AS (SELECT *, lag(CASE WHEN failed THEN tool END) OVER (PARTITION BY session_id ORDER BY seq) AS prior FROM stream WHERE kind = 'toolResult'),
marked AS (SELECT *, sum(CASE WHEN failed AND prior IS NOT DISTINCT FROM tool THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM results),
loops AS (SELECT session_id, count(*) AS loops FROM (SELECT session_id FROM marked WHERE failed GROUP BY session_id, run, tool HAVING count(*) >= 3) GROUP BY 1),
asked AS (SELECT session_id, count(*) FILTER (correction) AS corrections, count(*) FILTER (reprompt) AS rapid_reprompts FROM prompts GROUP BY 1),
sums AS (SELECT session_id, count(*) FILTER (kind = 'userMessage') AS user_prompts, count(*) FILTER (failed) AS tool_failures,
  count(*) FILTER (kind = 'commit') AS commits FROM stream GROUP BY 1)
SELECT c.session_id, user_prompts, tool_failures, commits, coalesce(corrections, 0) AS corrections, coalesce(rapid_reprompts, 0) AS rapid_reprompts,
  coalesce(loops, 0)::INT AS loops,
  CASE WHEN commits > 0 THEN 'shipped' WHEN coalesce(loops, 0) > 0 OR coalesce(corrections, 0) >= 2 THEN 'struggled' ELSE 'productive' END AS outcome
FROM sums c LEFT JOIN asked a ON a.session_id = c.session_id LEFT JOIN loops l ON l.session_id = c.session_id
""")
def session_signals(spark, sf_dir):
    """Counters, loops and outcome of each session."""
    return signals.analyze(stream(spark, sf_dir)).select(
        "session_id", "user_prompts", "tool_failures", "commits", "corrections", "rapid_reprompts",
        F.coalesce(F.size("error_loops"), F.lit(0)).alias("loops"), "outcome",
    )


@query(f"""
WITH {_PROMPTS},
rows AS (SELECT session_id, 'supervision' AS category, 1 AS least, seq FROM prompts WHERE correction
  UNION ALL SELECT session_id, 'prompt-shape', 2, seq FROM prompts WHERE reprompt),
grouped AS (SELECT session_id, category, count(*) AS n, list(seq ORDER BY seq) AS seqs FROM rows GROUP BY session_id, category, least HAVING count(*) >= least)
SELECT session_id, category, n::INT AS n, substr(sha256('human:' || category || ':' || category), 1, 16) AS fingerprint,
  array_to_string(CASE WHEN n <= 5 THEN seqs ELSE list_concat(seqs[1:4], seqs[-1:]) END, ',') AS evidence FROM grouped
""")
def lesson_candidates(spark, sf_dir):
    """What sessions suggest people to learn, with the first four places and the last."""
    out = signals.lessons(stream(spark, sf_dir)).where("audience = 'human'")
    return out.select("session_id", "category", "n", "fingerprint", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@query(f"""
WITH timed AS (SELECT user_id, event_id AS after, lag(event_id) OVER ({_ORDER}) AS before,
  epoch_ms(date_trunc('second', ts)) // 1000 - epoch_ms(date_trunc('second', lag(ts) OVER ({_ORDER}))) // 1000 AS gap_s FROM events)
SELECT user_id, before, after, gap_s FROM timed WHERE gap_s > 300
""")
def gaps_over_5min(spark, sf_dir):
    """Quiet times of over five minutes and the events around them."""
    return runs.time_gaps(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 300)


@query("""
SELECT user_id, event_type, props, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids
FROM events GROUP BY ALL HAVING count(*) >= 3
""")
def repeated_calls(spark, sf_dir):
    """The same call with the same input three times or more in a session."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n"), ids.alias("ids")).where("n >= 3")


@query("""
WITH marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM conversations),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text
FROM numbered GROUP BY conv_id, run, role
""")
def merge_runs(spark, sf_dir):
    """Neighbouring messages of one speaker as one."""
    return runs.merge_runs(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role"], "text")


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seq, 'msg-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, turn
FROM conversations WHERE role <> 'system'
""")
def export_seq(spark, sf_dir):
    """Dense numbers and ids of the records that an export keeps."""
    kept = runs.dense_ids(load(spark, sf_dir, "conversations").where("role <> 'system'"), ["conv_id"], ["turn"])
    return kept.select("conv_id", "seq", F.concat(F.lit("msg-"), "seq").alias("id"), "turn")


@query("""
WITH RECURSIVE sized AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
filled AS (SELECT conv_id, i, coalesce(chars, 0) AS held, 0 AS pack FROM sized WHERE i = 1
  UNION ALL SELECT s.conv_id, s.i, CASE WHEN f.held > 0 AND f.held + coalesce(s.chars, 0) > 2000 THEN coalesce(s.chars, 0) ELSE f.held + coalesce(s.chars, 0) END,
    f.pack + (f.held > 0 AND f.held + coalesce(s.chars, 0) > 2000)::INT FROM filled f JOIN sized s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, turn, chars::INT AS chars, pack FROM filled JOIN sized USING (conv_id, i)
""")
def pack_pieces(spark, sf_dir):
    """Messages packed greedily into pieces of at most 2,000 characters."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return runs.pack(rows, ["conv_id"], ["turn"], "chars", 2_000)


@query("""
SELECT user_id, greatest(count(*) FILTER (event_type = 'error'), 0) AS failures,
  string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (event_type IN ('error', 'purchase')) AS path
FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 3
""")
def tool_failures(spark, sf_dir):
    """Sessions with three failures or more, and the order of failures and commits in them."""
    listed = F.col("event_type").isin("error", "purchase")
    path = F.array_sort(F.collect_list(F.when(listed, F.struct("ts", "event_id", "event_type"))))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failures"),
        F.array_join(F.transform(path, lambda x: x["event_type"]), ",").alias("path"),
    ).where("failures >= 3")
