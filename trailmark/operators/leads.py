"""Leads: places of a session export worth a closer look, numbered L1, L2, .. over all sections.

Records: session_id, seq, id ('msg-N'), track, msg_type, role, origin, tool_name, status, text, input,
output, ts (milliseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least repeats, longest quiet time, length of a quoted line.
REPEATS, GAP_MS, LINE = 3, 5 * 60_000, 200
QUESTION_TOOLS = ("askuserquestion",)


def one_line(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, LINE)


def is_human(prefix: str = "") -> Column:
    """Typed by the person: a plain user message of the main track."""
    c = lambda name: F.col(prefix + name)
    return F.coalesce(
        (c("track") == "main") & (c("msg_type") == "message") & (c("role") == "user")
        & (c("origin").isNull() | (c("origin") == "human")) & (F.coalesce(c("text"), F.lit("")) != ""),
        F.lit(False),
    )


def find_leads(records: DataFrame) -> DataFrame:
    """(session_id, lead, section, line, msg_id): every lead in order of section, then of the session."""
    interrupt = F.coalesce(F.col("text").rlike(r"(?i)\[Request interrupted"), F.lit(False))
    tool = F.coalesce("tool_name", F.lit("tool"))

    def section(rows, place, title, line, order="seq"):
        return rows.select("session_id", F.lit(place).alias("place"), F.lit(title).alias("section"), F.col(order).alias("order"), line.alias("line"))

    plain = records.where(F.col("tool_name").isNull() & (F.col("track") == "main") & (F.col("msg_type") == "message") & (F.col("role") == "assistant") & F.col("text").rlike(r"\?\s*$"))
    asking = records.where(F.lower("tool_name").isin(*QUESTION_TOOLS))
    answer = F.when(F.coalesce("output", F.lit("")) != "", F.concat(F.lit(" → "), one_line(F.col("output")))).otherwise("")
    failed = records.where("status = 'failure'").withColumn("tool", tool)
    calls = records.where("msg_type = 'toolCall' and tool_name is not null").withColumn("input", F.coalesce("input", F.lit("")))

    def grouped(rows, *keys):
        ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ", ")
        return rows.groupBy("session_id", *keys).agg(F.count("*").alias("n"), ids.alias("ids"), F.min("seq").alias("seq")).where(F.col("n") >= REPEATS)

    in_time = Window.partitionBy("session_id").orderBy("ts", "seq")
    timed = records.where("ts is not null").withColumns({"gap": F.col("ts") - F.lag("ts").over(in_time), "before": F.lag("id").over(in_time), "nth": F.row_number().over(in_time).cast("long")})
    why = F.when(is_human(), "waiting for the person").otherwise("nothing running — check it")
    parts = [
        section(records.where(is_human() & ~interrupt), 1, "Human messages", F.concat("id", F.lit(": "), one_line(F.col("text")))),
        section(records.where(interrupt), 2, "Interrupts", F.col("id")),
        section(plain, 3, "Questions the agent asked", F.concat("id", F.lit(": "), one_line(F.col("text")))),
        section(asking, 3, "Questions the agent asked", F.concat("id", F.lit(": "), F.col("tool_name"), answer)),
        section(grouped(failed, "tool"), 4, "Tool failures", F.concat("tool", F.lit(" failed "), "n", F.lit(" times: "), "ids")),
        section(failed, 5, "Tool failures", F.concat("id", F.lit(": "), "tool", F.lit(" "), one_line(F.col("input")))),
        section(grouped(calls, "tool_name", "input"), 6, "Repeated calls", F.concat("tool_name", F.lit(" ×"), "n", F.lit(": "), "ids", F.lit(" — "), one_line(F.col("input")))),
        section(timed.where(F.col("gap") > GAP_MS), 7, "Gaps over 5 minutes", F.concat("before", F.lit(" to "), "id", F.lit(": "), F.floor(F.col("gap") / 60000 + 0.5).cast("string"), F.lit("m, "), why), "nth"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("place", "order", "line"))
    msg = F.when(F.col("section") == "Human messages", F.regexp_extract("line", r"^msg-\d+", 0))
    return rows.withColumn("lead", F.concat(F.lit("L"), number)).select("session_id", "lead", "section", "line", msg.alias("msg_id"))
