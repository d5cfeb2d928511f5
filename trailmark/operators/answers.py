"""Whether a reviewer accounted for every lead: as a problem it wrote, or dropped for a reason that may be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import QUOTE_MIN, quote_pieces, squash

#: The cases in which a lead may be dropped.
CASES = ("did not happen", "no kind", "exception:repeated-failures", "exception:repeated-command", "exception:idle-gap")

_DASH = r"\s+[—–]\s+"


def answers_of(markdown: Column) -> Column:
    """Array of structs (lead, answer): the lines ``- L4: ...`` of a text, of a lead named twice the last."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))
    rest = F.transform(lines, lambda x: F.ltrim(F.substr(x, F.lit(2))))
    named = F.filter(rest, lambda x: x.rlike(r"^L\d+:"))
    pairs = F.transform(named, lambda x: F.struct(F.substring_index(x, ":", 1).alias("lead"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("answer")))
    leads = F.transform(pairs, lambda p: p["lead"])
    return F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(leads, i + 2, F.greatest(F.size(leads) - i, F.lit(0))), p["lead"]))


def _head(answer: Column) -> Column:
    """What stands before the first dash, and in its brackets: ``dropped (no kind)`` is (dropped, no kind)."""
    head = F.trim(F.element_at(F.split(answer, _DASH, 2), 1))
    word = F.trim(F.substring_index(head, "(", 1))
    inner = F.when(head.endswith(")"), F.trim(F.substr(head, F.instr(head, "(") + 1, F.length(head) - F.instr(head, "(") - 1)))
    return F.struct(word.alias("word"), inner.alias("inner"))


def unaccounted(leads: DataFrame, reviews: DataFrame, titles: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, lead, why): leads without an answer that holds.

    ``leads``: session_id, lead, msg_id (set for what a person said); ``reviews``: session_id, markdown with the answers;
    ``titles``: session_id, title of the problems that were written; ``records``: session_id, id, text.  An answer holds if it
    names a problem that was written, or drops the lead for one of CASES and says more; what a person said is
    dropped only with a quote of that message, long enough and really in it, and a reason after it.
    """
    given = reviews.select("session_id", F.explode(answers_of(F.col("markdown"))).alias("a")).select("session_id", "a.*")
    met = leads.join(given, ["session_id", "lead"], "left").withColumn("_h", _head(F.col("answer")))
    rest = F.when(F.size(F.split("answer", _DASH, 2)) == 2, F.trim(F.element_at(F.split("answer", _DASH, 2), 2)))
    met = met.withColumn("_rest", F.nullif(rest, F.lit("")))
    word, inner = F.col("_h.word"), F.regexp_replace(F.coalesce("_h.inner", F.lit("")), r":\s+", ":")
    kind = inner.startswith("kind:") & (F.length(inner) > len("kind:"))
    written = titles.select("session_id", squash(F.col("title")).alias("_title"), F.lit(True).alias("_there")).distinct()
    met = met.withColumn("_title", F.when((word == "problem") & kind, squash(F.col("_rest")))).join(written, ["session_id", "_title"], "left")
    said = records.select("session_id", F.col("id").alias("msg_id"), squash(F.col("text")).alias("_said"))
    met = met.join(said.dropDuplicates(["session_id", "msg_id"]), ["session_id", "msg_id"], "left")
    # msg-3 — "quote" — why: the message, what stands between the outer quote marks, and something behind
    cited = F.element_at(F.split("_rest", _DASH, 2), 1) == F.col("msg_id")
    behind = F.element_at(F.split("_rest", _DASH, 2), -1)
    quote = F.regexp_extract(behind, rf'^["“](.+)["”]{_DASH}\S', 1)
    pieces = quote_pieces(quote)
    quoted = cited & (F.length(F.array_join(pieces, "")) >= QUOTE_MIN) & F.forall(pieces, lambda p: F.contains(F.col("_said"), p))
    dropped = (word == "dropped") & inner.isin(*CASES)
    why = (
        F.when(F.col("answer").isNull(), "no answer")
        .when(word == "problem", F.when(~F.coalesce("_there", F.lit(False)), "no such problem"))
        .when(~F.coalesce(dropped, F.lit(False)) | F.col("_rest").isNull(), "no case")
        .when(F.col("msg_id").isNotNull() & ~F.coalesce(quoted, F.lit(False)), "quote is not there")
    )
    return met.withColumn("why", why).where("why is not null").select("session_id", "lead", "why")
