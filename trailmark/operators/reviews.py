"""Reviews written as Markdown: problems with their fields, or why one cannot be kept.

A review has a header with its outcome, a summary and a section of problems, each under a ### title with lines
``- **Name:** value``.  Texts are cut by expressions; a row is a review, then a problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.content import evidence
from ..tables import settled
from .upsert import replace_problems

#: The domains of a problem's fields and of a review's outcome.
CLASSES = ("missed", "blocked", "slow", "caught")
SEVERITIES = ("high", "medium", "low")
FIX_TYPES = ("skill", "code", "project_guidelines", "knowledge_base", "human")
OUTCOMES = ("shipped", "productive", "struggled", "aborted")
#: The longest texts, and the most problems and pieces of evidence.
LIMITS = {
    "title": 120, "summary": 600, "description": 600, "learning": 300, "severity_reason": 200, "quote": 300, "why": 300,
    "extra_value": 200, "problems": 100, "evidence": 20, "extra_fields": 10,
}


def section(markdown: Column, name: str) -> Column:
    """What stands under ``## name``, up to the next ## heading; null without it."""
    pattern = rf"(?is)(?:^|\n)[ \t]*##[ \t]+{name}[ \t]*(?:\n(.*?))?(?=\n##\s|\z)"
    text = F.replace(markdown, F.lit("\r\n"), F.lit("\n"))
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def field(body: Column, name: str) -> Column:
    """The first value of a field, its continuation lines joined by blanks; null if missing or empty."""
    pattern = rf"(?is)(?:^|\n)\s*-\s+\*\*{name}:\*\*[ \t]*(.*?)(?=\n\s*\n|\n\s*[-*]\s|\n\s*#{{1,6}}\s|\s*\z)"
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(body, pattern, 1), r"\s*\n\s*", " ")), F.lit(""))


def evidence_lines(body: Column) -> Column:
    """Values of Evidence fields, and items of the list below one."""
    own = F.regexp_extract_all(body, F.lit(r"(?im)^-\s+\*\*evidence:\*\*[ \t]*(\S.*)$"), F.lit(1))
    items = F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]+[-*][ \t]+(?!\*\*)(\S.*)$"), F.lit(1))
    return F.concat(own, items)


def extras(value: Column) -> Column:
    """``a: x; b: y`` as a map; names in lower case, the last of a name counts; pieces without one are left out."""
    pairs = F.filter(F.split(F.coalesce(value, F.lit("")), r";(?=[^;:]*:)"), lambda p: F.regexp_like(p, F.lit(r"^\s*[^:\s][^:]*:")))
    entries = F.transform(pairs, lambda p: F.struct(
        F.lower(F.trim(F.regexp_extract(p, r"^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)).alias("v")
    ))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"]))


def _domain(value: Column, allowed: tuple[str, ...]) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*allowed), word)


def parse(reviews: DataFrame, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(heads, problems) of reviews (review_id, markdown).

    Heads: review_id, outcome, summary (cut to its limit), error: why the whole review is unusable.  Problems
    of usable reviews: review_id, position, title, class, severity, severity_reason, fix_type, description,
    learning, evidence, extra, drops: why this one cannot be kept, empty if it can.  ``required`` extra
    fields must be there.  Null text is a review without anything.
    """
    text = F.coalesce("markdown", F.lit(""))
    header = F.regexp_replace(text, r"(?s)(?:^|\n)##\s.*$", "")
    body = section(text, "problems")
    heads = reviews.select(
        "review_id", _domain(field(header, "outcome"), OUTCOMES).alias("outcome"),
        F.regexp_replace(F.coalesce(section(text, "summary"), F.lit("")), r"^\s+|\s+$", "").alias("summary"), body.alias("_body"),
    )
    blocks = F.slice(F.split(F.concat(F.lit("\n"), "_body"), r"\n[ \t]*###[ \t]+"), 2, LIMITS["problems"])
    none = F.regexp_like("_body", F.lit(r"(?is)^\s*nothing to change\b"))
    error = (
        F.when(F.col("outcome").isNull(), "outcome").when(F.col("summary") == "", "summary").when(F.col("_body").isNull(), "problems")
        .when((F.size(blocks) == 0) & ~none, "no problem and not said so")
    )
    heads = heads.withColumn("error", error)
    rows = heads.where("error is null").select("review_id", F.posexplode(blocks).alias("position", "block"))
    b = F.col("body")
    rows = rows.select(
        "review_id", "position", F.trim(F.substring_index("block", "\n", 1)).alias("title"),
        F.concat(F.lit("\n"), F.regexp_replace("block", r"^[^\n]*\n?", "")).alias("body"),
    )
    severity = field(b, "severity")
    split = r"(?s)^(\S+)\s+[—–-]\s+(.+)$"
    cited = evidence_lines(b)
    made = rows.select(
        "review_id", "position", "title", _domain(field(b, "class"), CLASSES).alias("class"),
        _domain(F.coalesce(F.nullif(F.regexp_extract(severity, split, 1), F.lit("")), severity), SEVERITIES).alias("severity"),
        F.nullif(F.trim(F.regexp_extract(severity, split, 2)), F.lit("")).alias("severity_reason"),
        _domain(field(b, "fix type"), FIX_TYPES).alias("fix_type"), field(b, "description").alias("description"), field(b, "learning").alias("learning"),
        F.size(cited).alias("_cited"), F.array_compact(F.transform(cited, evidence)).alias("evidence"), extras(field(b, "extra")).alias("extra"),
    )
    checks = [F.when(F.col(c).isNull(), c) for c in ("class", "severity", "severity_reason", "fix_type", "description", "learning")]
    checks += [F.when(F.length(c) > LIMITS[c], f"{c} too long") for c in ("title", "description", "learning", "severity_reason")]
    checks += [
        F.when(F.col("_cited") == 0, "no evidence").when(F.col("_cited") > LIMITS["evidence"], "too much evidence").when(F.size("evidence") < F.col("_cited"), "evidence cannot be read"),
        F.when(F.exists("evidence", lambda e: (F.length(e["quote"]) > LIMITS["quote"]) | (F.length(e["why"]) > LIMITS["why"])), "evidence too long"),
        F.when(F.exists(F.map_values("extra"), lambda v: F.length(v) > LIMITS["extra_value"]), "extra too long"),
        *[F.when(~F.map_contains_key("extra", n) | (F.element_at("extra", n) == ""), f"extra {n} missing") for n in required],
    ]
    problems = made.withColumn("drops", F.array_compact(F.array(*checks))).drop("_cited")
    return heads.withColumn("summary", F.substring("summary", 1, LIMITS["summary"])).drop("_body"), problems


def histograms(problems: DataFrame, by: list[str]) -> DataFrame:
    """Per group: problems, sessions, pieces of evidence, and problems by severity and class."""
    counts = [F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES]
    counts += [F.count_if(F.col("class") == c).alias(f"class_{c}") for c in CLASSES]
    return problems.groupBy(*by).agg(
        F.count("*").alias("problems"), F.count_distinct("session_id").alias("sessions"), F.sum(F.size("evidence")).alias("times"), *counts
    )


#: Fixed value: attempts of a review before it fails for good.
ATTEMPTS = 3


def judged(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` with the ``reason`` why one is refused, null if it counts; see :func:`finish`."""
    now = runs.select("run_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"), F.lit(True).alias("_there"))
    met = results.join(now, "run_id", "left")
    reason = (
        F.when(F.col("_there").isNull(), "unknown").when(~F.col("_status").eqNullSafe(F.lit("running")), "not running")
        .when(~F.col("attempt").eqNullSafe(F.col("_attempts")), "other attempt")
    )
    told = met.withColumn("_reason", reason)
    first = F.row_number().over(Window.partitionBy("run_id", F.col("_reason").isNull()).orderBy("arrival"))
    return told.withColumn("reason", F.when(F.col("_reason").isNull() & (first > 1), "repeated").otherwise(F.col("_reason")))


def refused(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The results that :func:`finish` refuses, with the reason."""
    return judged(runs, results).where("reason is not null").select("run_id", "attempt", "arrival", "reason")


def finish(runs: DataFrame, problems: DataFrame, results: DataFrame, most: int = ATTEMPTS, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, problems, refused) after results of reviews came back; one transition of both tables.

    ``runs``: run_id, status, attempts, outcome, summary, last_message_id.  ``results``: run_id, attempt, arrival, error, outcome,
    summary, last_message_id, problems (an array of structs).  A result counts only if its run is running that very
    attempt, and only the first to arrive: the rest is refused with a reason (``unknown``, ``not running``, ``other attempt``,
    ``repeated``), so a worker that was given up and comes back late changes nothing.

    A result without an error makes its run done, and its problems replace those that the run had; one with an
    error sends it back to wait, or fails it after ``most`` attempts, and its problems stay as they were.  Results that count
    are found once and written down; with ``parts``, runs, problems and those are dealt over that many partitions.
    """

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, key) if parts else df

    told = judged(runs, results)
    taken = settled(told.where("reason is null").select("run_id", "error", "outcome", "summary", "last_message_id", "problems"))
    r = taken.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("error", "outcome", "summary", "last_message_id")], F.lit(True).alias("_taken"))
    good = F.col("_taken") & F.col("_error").isNull()
    after = dealt(runs, "run_id").join(dealt(r, "run_id"), "run_id", "left").withColumns({
        "status": F.when(good, "done").when(F.col("_taken"), F.when(F.col("attempts") >= most, "failed").otherwise("waiting")).otherwise(F.col("status")),
        **{c: F.when(good, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("outcome", "summary", "last_message_id")},
    })
    done = taken.where("error is null").select(F.col("run_id").alias("review_id"), F.coalesce("problems", F.array()).alias("problems"))
    lost = told.where("reason is not null").select("run_id", "attempt", "arrival", "reason")
    return after.select(runs.columns), replace_problems(dealt(problems, "review_id"), dealt(done, "review_id")), lost
