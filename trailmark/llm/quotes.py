"""Quotation linking: which earlier message a message answers, and conversations without quotes.

Native: SQL functions, windows and joins.  Lines that start with > are quotes, one level for each >.
Neighbouring lines of one level are a passage.  Its normalised text is hashed and looked up among the
hashes of what earlier messages of the conversation say themselves: all of it, a paragraph or a line.
A passage of several lines is also looked up among all runs of as many own lines, blank lines left out;
a run's hash is the difference of two running sums, so runs cost a row each and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

_MARK = r"^[ \t]*(>[> \t]*)"
_BLANKS = " \t\n\x0b\f\r"
_WIDE = "decimal(38,0)"


def level(line: Column) -> Column:
    """Quote level of a line: the number of > it starts with, blanks between them allowed."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), "[^>]", ""))


def own_text(text: Column) -> Column:
    """The text without quoted lines, trimmed; null stays null."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(_MARK))
    return F.trim(F.array_join(lines, "\n"), F.lit(_BLANKS))


def normal(text: Column) -> Column:
    """Quote marks gone, lower case, runs of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?m)" + _MARK, "")), r"\s+", " "))


def _digest(text: Column) -> Column:
    return F.md5(normal(text).cast("binary"))


def _sums(lines: DataFrame, by: list[str]) -> DataFrame:
    """``lines`` (by, pos, said) with their place k among those of ``by`` that are not empty, and running sums of
    their hashes, plain and times k.

    Sums at the ends of a run of lines tell what the run holds and in which order: see :func:`_run_digest`.
    """
    in_order = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = F.xxhash64("said").cast(_WIDE)
    numbered = lines.where("said <> ''").withColumn("k", F.count("*").over(in_order)).withColumn("h", h)
    return numbered.withColumn("a", F.sum("h").over(in_order)).withColumn("w", F.sum(F.col("h") * F.col("k")).over(in_order))


def _run_digest(n: Column, before: Column, a: Column, w: Column) -> Column:
    """A digest of a run of n lines that stand behind ``before`` others, by the growth of the running sums."""
    placed = (w - a * before).cast("string")
    return F.md5(F.concat_ws("|", F.lit("run"), n.cast("string"), a.cast("string"), placed).cast("binary"))


def passages(messages: DataFrame) -> DataFrame:
    """(id, conv_id, turn, at, level, n, digests) of every quoted passage; ``at`` is its first line, ``n`` the number
    of its lines that are not empty, ``digests`` those of its text and, of several lines, of its lines.

    ``messages`` has id, conv_id, turn and text.  Windows run over the lines of one message.
    """
    lines = messages.select("id", "conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("level", level(F.col("line")))
    in_order = Window.partitionBy("id").orderBy("pos")
    new = F.coalesce(F.lag("level").over(in_order) != F.col("level"), F.lit(True)).cast("int")
    lines = lines.withColumn("new", new)
    lines = lines.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.where("level > 0").withColumn("said", normal(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    kept = F.col("said") != ""
    in_passage = Window.partitionBy("id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("k", F.count(F.when(kept, 1)).over(in_passage))
    lines = lines.withColumn("h", F.when(kept, F.xxhash64("said")).cast(_WIDE))
    found = lines.groupBy("id", "conv_id", "turn", "run", "level").agg(
        F.min("pos").alias("at"), joined.alias("text"), F.max("k").cast("int").alias("n"), F.sum("h").alias("a"),
        F.sum(F.col("h") * F.col("k")).alias("w"),
    )
    runs = F.when(F.col("n") > 1, F.array(_run_digest(F.col("n"), F.lit(0), F.col("a"), F.col("w"))))
    return found.where("n > 0").select(
        "id", "conv_id", "turn", "at", "level", "n",
        F.concat(F.array(_digest(F.col("text"))), F.coalesce(runs, F.array().cast("array<string>"))).alias("digests"),
    )


def runs_said(messages: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, turn, digest): every run of own lines of ``messages`` (id, conv_id, turn, own_text) that is as long
    as one of ``lengths`` (conv_id, n)."""
    lines = messages.join(lengths.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "id", "conv_id", "turn", F.posexplode(F.split("own_text", "\n")).alias("pos", "line")
    )
    ends = _sums(lines.withColumn("said", normal(F.col("line"))), ["id"]).select("id", "conv_id", "turn", "k", "a", "w")
    starts = ends.select("id", F.col("k").alias("before"), F.col("a").alias("a0"), F.col("w").alias("w0"))
    whole = ends.join(lengths, "conv_id").where("k >= n").withColumn("before", F.col("k") - F.col("n"))
    met = whole.join(starts, ["id", "before"], "left").where("before = 0 or a0 is not null")
    zero = F.lit(0).cast(_WIDE)
    a, w = F.col("a") - F.coalesce("a0", zero), F.col("w") - F.coalesce("w0", zero)
    return met.select("conv_id", "turn", _run_digest(F.col("n"), F.col("before"), a, w).alias("digest"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, digest): what every message says itself, as a whole, by paragraph and by line."""
    own = F.col("own_text")
    pieces = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    said = messages.where("conv_id is not null and turn is not null and own_text <> ''")
    said = said.select("conv_id", "turn", F.explode(F.array_distinct(pieces)).alias("piece"))
    return said.where(normal(F.col("piece")) != "").select("conv_id", "turn", _digest(F.col("piece")).alias("digest"))


def link(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` with ``source_turn``: the latest earlier turn of the conversation that says one of its ``digests``.

    Both sides lie in one ordered window by conversation and digest, so a line that is said and
    quoted very often makes no pairs.
    """
    sought = quoted.select("id", "at", "conv_id", "turn", "level", F.explode(F.array_distinct("digests")).alias("digest"))
    said = said.join(sought.select("conv_id", "digest").distinct(), ["conv_id", "digest"], "left_semi")
    both = sought.withColumn("said", F.lit(None).cast("long")).unionByName(
        said.withColumn("said", F.col("turn")), allowMissingColumns=True
    )
    before = Window.partitionBy("conv_id", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source_turn", F.max("said").over(before)).where("id is not null")
    return found.groupBy("id", "at", "conv_id", "turn", "level").agg(F.max("source_turn").alias("source_turn"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, up): links followed to their end, twice as
    far each round.  Parents are earlier turns, so there are no rings."""
    now = settle(parents.select("conv_id", "turn", F.col("up").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        far = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = now.join(far, ["conv_id", "root_turn"], "left")
        if step.where("next is not null").isEmpty():
            return now
        now = settle(step.select(
            "conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        ))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, root_turn, reply_depth, turn, role, own_text, n_quotes, n_linked, reply_to) of every
    message, ordered by conversation, thread (root_turn), depth and turn.

    A message answers the latest turn that any of its level-1 passages comes from; deeper levels are
    what the answered message quoted and only counted.  A message that answers none is its own root.
    Null text has no quotes and stays null.  Null conv_id or turn links with nothing.  Messages that share
    conv_id and turn share their links.  Repeated rows stay repeated; an empty table gives none.
    """
    seen = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).withColumn("own_text", own_text(F.col("text")))
    quoting = seen.where(F.col("text").rlike(r"(?m)" + _MARK) & F.expr("conv_id is not null and turn is not null"))
    quoting = settle(quoting.select(F.monotonically_increasing_id().alias("id"), "conv_id", "turn", "text"))
    found = settle(passages(quoting))
    said = originals(seen)
    lengths = found.where("n > 1").select("conv_id", "n").distinct()
    placed = seen.where("conv_id is not null and turn is not null and own_text <> ''")
    said = said.unionByName(runs_said(placed.withColumn("id", F.monotonically_increasing_id()), lengths))
    linked = link(found, said)
    by = settle(linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("source_turn").alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.col("source_turn"))).alias("reply_to"),
    ))
    roots = _roots(by.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("up")))
    out = seen.join(by, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("reply_depth"),
        "turn", "role", "own_text",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "reply_to",
    ).orderBy("conv_id", "root_turn", "reply_depth", "turn", "role", "own_text")
