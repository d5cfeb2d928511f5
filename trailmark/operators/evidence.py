"""Whether quotes are really where they are said to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.content import QUOTE_MIN, RANGE_MAX, quote_pieces, squash

#: Blanks of a key: quotes and texts meet by the first KEY + 1 words of a quote.
KEY = 4
#: Keys of quotes up to which texts are searched for them in place; more are met by a join.
HELD = 2_048


def contained(quotes: DataFrame, quote: str, texts: DataFrame, text: str, by: list[str], key: int = KEY) -> DataFrame:
    """Rows of ``quotes`` joined to the rows of ``texts`` that contain them; both squashed before.

    A quote's first words but its very first (which may begin inside a word) are its key.  Texts are cut
    in runs of as many words, only runs that are a key stay, and what meets is compared in full.  Quotes too
    short for a key, few words each, are looked for by their longest inner word, else by their characters.
    Up to HELD keys are looked for within each text, and only texts that have one go on; beyond that runs travel with
    ``by`` (columns of ``texts`` that name a row) alone to a join, and texts join what was met.
    """
    words = F.split(quote, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = quotes.withColumn("_inner", inner)
    many = F.size("_inner")
    kinds = keyed.agg(F.count_if(many >= key), F.count_if((many > 0) & (many < key)), F.count_if(many == 0)).first()

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - key + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, key), " ")))
        return F.when(F.size(w) >= key, found)

    def grams(_: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - QUOTE_MIN + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(QUOTE_MIN)))

    # the longest inner word of a quote of a few words must be a word of the text
    longest = F.array_max(F.transform("_inner", lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    ways = (
        (kinds[0], many >= key, F.xxhash64(F.array_join(F.slice("_inner", 1, key), " ")), runs),
        (kinds[1], (many > 0) & (many < key), longest, lambda w: w),
        (kinds[2], many == 0, F.substring(quote, 1, QUOTE_MIN), grams),
    )
    columns = [*quotes.columns, *texts.columns]
    out = None
    for count, which, of_quote, of_text in ways:
        if not count and out is not None:
            continue
        asked = keyed.where(which).withColumn("_key", of_quote).drop("_inner")
        keys = [r[0] for r in asked.select("_key").distinct().limit(HELD + 1).collect()]
        if len(keys) <= HELD:
            listed = F.array(*map(F.lit, keys)) if keys else F.array().cast(asked.select(F.array("_key").alias("k")).schema["k"].dataType)
            # the words are bound to a variable, else each run would split the text again
            here = F.flatten(F.transform(F.array(F.split(text, " ")), lambda w: F.array_intersect(of_text(w), listed)))
            rows = texts.select("*", F.explode_outer(here).alias("_key")).where("_key is not null")
            met = rows.join(F.broadcast(asked), "_key")  # few keys
            found = met.where(F.contains(F.col(text), F.col(quote))).select(columns)
            out = found if out is None else out.unionByName(found)
            continue
        # explode_outer, since explode would compute the runs again to filter empty ones
        rows = texts.withColumn("_w", F.split(text, " ")).select(*by, F.explode_outer(F.array_distinct(of_text(F.col("_w")))).alias("_key"))
        met = rows.join(asked, "_key").drop("_key").distinct()
        found = met.join(texts, by).where(F.contains(F.col(text), F.col(quote))).select(columns)
        out = found if out is None else out.unionByName(found)
    return out


def record_text() -> Column:
    """Everything a record says."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("text", "tool_name", "input", "output")])


def check(cited: DataFrame, records: DataFrame, most: int = RANGE_MAX) -> DataFrame:
    """``cited`` (session_id, item, from, to, quote) with ``failure``, null where the quote holds.

    Both ids must exist, the range run forward and not be wider than ``most``, the quote be long enough,
    and all its pieces be in what the range says.  Records have session_id, seq, id and texts.
    """
    ids = records.select("session_id", "id", "seq")
    met = cited.join(ids.withColumnsRenamed({"id": "from", "seq": "_a"}), ["session_id", "from"], "left")
    met = met.join(ids.withColumnsRenamed({"id": "to", "seq": "_b"}), ["session_id", "to"], "left")
    label = F.when(F.col("from") == F.col("to"), F.col("from")).otherwise(F.concat("from", F.lit(" to "), "to"))
    pieces = quote_pieces(F.col("quote"))
    failure = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "no such message")
        .when(F.col("_b") < F.col("_a"), "range runs backwards")
        .when(F.col("_b") - F.col("_a") + 1 > most, "range is too wide")
        .when(F.length(F.array_join(pieces, "")) < QUOTE_MIN, "quote is too short")
    )
    judged = met.withColumns({"_early": failure, "_pieces": pieces})
    said = records.select("session_id", "seq", squash(record_text()).alias("_said"))
    spans = judged.where("_early is null").select("session_id", "item", F.explode(F.sequence("_a", "_b")).alias("seq"))
    heard = spans.join(said, ["session_id", "seq"]).groupBy("session_id", "item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_said"))), lambda x: x["_said"]), " ").alias("_heard")
    )
    out = judged.join(heard, ["session_id", "item"], "left")
    there = F.forall("_pieces", lambda p: F.contains(F.col("_heard"), p))
    late = F.when(~F.coalesce(there, F.lit(False)), "quote is not there")
    reason = F.coalesce("_early", late)
    return out.withColumn("failure", F.when(reason.isNotNull(), F.concat(label, F.lit(": "), reason))).select(*cited.columns, "failure")


def proven(problems: DataFrame, checked: DataFrame) -> DataFrame:
    """Problems (session_id, problem) none of whose evidence failed; ``checked`` also has ``problem``."""
    failed = checked.where("failure is not null").select("session_id", "problem").distinct()
    return problems.join(failed, ["session_id", "problem"], "left_anti")


def seen_at(cited: DataFrame, records: DataFrame) -> DataFrame:
    """(session_id, problem, seen_at): the time of the earliest message a problem cites.

    ``cited`` has problem, from and to as record numbers; records session_id, seq and ts.
    """
    spans = cited.select("session_id", "problem", F.explode(F.sequence("from", "to")).alias("seq"))
    return spans.join(records.select("session_id", "seq", "ts"), ["session_id", "seq"]).groupBy("session_id", "problem").agg(F.min("ts").alias("seen_at"))


def reaches_new(evidence_to: Column, context: int) -> Column:
    """Whether any cited range (an array of end ids msg-N) reaches the part after ``context`` records."""
    return F.exists(evidence_to, lambda i: F.regexp_extract(i, r"^msg-(\d+)$", 1).try_cast("int") >= context)


def excerpts(cited: DataFrame, records: DataFrame, reach: int = 3, budget: int = 20_000) -> DataFrame:
    """(session_id, problem, block, first, last, n, chars, text, cut): what a writer sees of the records around a problem.

    ``cited`` (session_id, problem, first, last): record numbers that its evidence names; each range is widened by
    ``reach`` within the session, and ranges that overlap or touch are one block.  ``records`` (session_id, seq, line):
    a record's block of text, already cut as a reader's.  Blocks come in order; once a problem's lines reach
    ``budget`` characters the rest is left out, and ``cut`` says so; the record that crosses it is still whole.
    """
    ends = records.groupBy("session_id").agg(F.max("seq").alias("_end"))
    wide = cited.where("first <= last").join(ends, "session_id").select(
        "session_id", "problem", F.greatest(F.lit(0), F.col("first") - reach).alias("a"), F.least(F.col("_end"), F.col("last") + reach).alias("b")
    ).where("a <= b")
    sweep = Window.partitionBy("session_id", "problem").orderBy("a", "b")
    furthest = F.max("b").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.coalesce(furthest, F.lit(-2)) + 1 < F.col("a")).cast("int")
    numbered = wide.withColumn("_new", opens).withColumn("block", F.sum("_new").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.groupBy("session_id", "problem", "block").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    lines = blocks.select("*", F.explode(F.sequence("first", "last")).alias("seq")).join(records.select("session_id", "seq", "line"), ["session_id", "seq"])
    read = Window.partitionBy("session_id", "problem").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = lines.withColumn("_before", F.coalesce(F.sum(F.length("line")).over(read), F.lit(0)))
    kept = F.col("_before") < budget
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("seq", "line")))), lambda x: x["line"]), "\n\n")
    return held.groupBy("session_id", "problem", "block", "first", "last").agg(
        F.count_if(kept).alias("n"), F.sum(F.when(kept, F.length("line")).otherwise(0)).alias("chars"), text.alias("text"), F.bool_or(~kept).alias("cut")
    )


def with_excerpts(problems: DataFrame, reviews: DataFrame, records: DataFrame, project: int | str, **options) -> DataFrame:
    """``problems`` (problem, review_id, evidence: array of structs with first and last) with ``excerpt``, their blocks joined.

    ``reviews``: review_id, session_id, project_id, numbered (whether it kept its records' order).  A review that kept none, or
    whose session is another project's now, gives no excerpt, and nor do problems without evidence.
    """
    own = reviews.where(F.col("numbered") & (F.col("project_id") == project)).select("review_id", "session_id")
    cited = problems.join(own, "review_id").select("session_id", "problem", F.explode("evidence").alias("e")).select("session_id", "problem", "e.first", "e.last")
    made = excerpts(cited, records, **options).where("n > 0").groupBy("problem").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n\n...\n\n").alias("excerpt")
    )
    return problems.join(made, "problem", "left").select(*problems.columns, "excerpt")
