"""Runs of neighbouring rows (gaps and islands), gaps in time, greedy packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from ..tables import settled


def ordered(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def number_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, name: str = "run") -> DataFrame:
    """``df`` with the number of its run, from 1: a run begins where ``starts`` holds (null: it does)."""
    w = ordered(by, order)
    flagged = df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int"))
    total = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn(name, total).drop("_starts")


def merge_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], same: Sequence[str], text: str) -> DataFrame:
    """Neighbours with equal ``same`` columns as one row: position, first and last order value, how many,
    and their texts in order, joined by line feeds (null texts left out)."""
    w = ordered(by, order)
    keys = [F.coalesce(~F.lag(c).over(w).eqNullSafe(F.col(c)), F.lit(True)) for c in same]
    starts = F.row_number().over(w) == 1
    for k in keys:
        starts = starts | k
    runs = number_runs(df, by, order, starts)
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return runs.groupBy(*by, "run", *same).agg(
        F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"),
        F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("text"),
    )


def time_gaps(df: DataFrame, by: Sequence[str], at: str, tie: str, seconds: int) -> DataFrame:
    """Pairs of neighbours in time that lie more than ``seconds`` apart; rows without a time are left out."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    timed = df.where(F.col(at).isNotNull()).withColumns({
        "before": F.lag(tie).over(w), "gap_s": F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w).cast("timestamp")),
    })
    return timed.where(F.col("gap_s") > seconds).select(*by, "before", F.col(tie).alias("after"), "gap_s")


def dense_ids(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """``df`` numbered from 0 without holes in each group."""
    return df.withColumn(name, F.row_number().over(ordered(by, order)) - 1)


def pack(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, most: int) -> DataFrame:
    """``df`` with ``pack``: consecutive rows filled up to ``most``; a new pack begins before it would
    overflow, and one larger row is a pack of its own.  Rows of no size go with what follows them; a null size is none.

    A group's rows pass in order through one task, which holds nothing of them but what the open pack has so far.
    """
    names = df.columns
    first = F.row_number().over(ordered(by, order)) == 1
    rows = df.select(*names, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_s"), first.alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = number = 0
        for batch in batches:
            packs = []
            for s, new in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                if new:
                    held = number = 0
                if held > 0 and held + s > most:
                    held, number = s, number + 1
                else:
                    held += s
                packs.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(packs, pa.int32())], [*names, "pack"])

    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("pack", IntegerType())]))


def around(cited: DataFrame, rows: DataFrame, by: Sequence[str], at: str, reach: int, most: int = 100) -> DataFrame:
    """Rows within ``reach`` of the lines cited in each group, the first ``most``, with ``truncated``."""
    bounds = cited.groupBy(*by).agg((F.min(at) - reach).alias("_from"), (F.max(at) + reach).alias("_to"))
    near = rows.join(bounds, list(by)).where(F.col(at).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    place = F.row_number().over(ordered(by, [at]))
    near = near.withColumn("_place", place).where(F.col("_place") <= most + 1)
    over = F.max("_place").over(Window.partitionBy(*by)) > most
    return near.withColumn("truncated", over).where(F.col("_place") <= most).drop("_place")


def context(cited: DataFrame, records: DataFrame, by: Sequence[str], reach: int = 2) -> DataFrame:
    """(by, item, seq, cited): what is shown of each citation: its records, and ``reach`` on each side.

    ``cited``: by, item, first, last (record numbers); ``records``: by, seq, track, filled (whether there is anything to
    see).  Neighbours are of the track of the first record cited and filled; of the cited ones the filled are
    shown, or all where none is.  A citation whose first record is missing has no neighbours.

    Filled records of a track are numbered, a citation's ends are placed among them by running counts, and
    neighbours are met by number.
    """
    keys = list(by)
    head = records.select(*keys, F.col("seq").alias("first"), "track")
    placed = cited.join(head, [*keys, "first"])
    marks = placed.select(*keys, "track", "item", F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.lit(0).alias("side")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"))
    )).alias("p"))
    none = F.lit(None)
    item = cited.schema["item"].dataType
    points = records.select(*keys, "track", F.col("seq").alias("at"), F.col("filled").cast("int").alias("n"), none.cast(item).alias("item"), none.cast("int").alias("side"))
    # a first end comes before the record it names, a last end after it
    turn = F.when(F.col("side") == 0, 0).when(F.col("side") == 1, 2).otherwise(1)
    asked = marks.select(*keys, "track", F.col("p.at").alias("at"), F.lit(0).alias("n"), "item", F.col("p.side").alias("side"))
    order = Window.partitionBy(*keys, "track").orderBy("at", turn, "item").rowsBetween(Window.unboundedPreceding, 0)
    numbered = points.unionByName(asked).withColumn("rank", F.sum("n").over(order))
    wanted = numbered.where("side is not null").select(*keys, "track", "item", F.explode(F.when(
        F.col("side") == 0, F.sequence(F.col("rank") - reach + 1, F.col("rank"))
    ).otherwise(F.sequence(F.col("rank") + 1, F.col("rank") + reach))).alias("rank"))
    filled = numbered.where("side is null and n = 1").select(*keys, "track", "rank", F.col("at").alias("seq"))
    near = wanted.join(filled, [*keys, "track", "rank"]).select(*keys, "item", "seq", F.lit(False).alias("cited"))
    spans = cited.where("first <= last").select(*keys, "item", F.explode(F.sequence("first", "last")).alias("seq"))
    inside = spans.join(records.select(*keys, "seq", "filled"), [*keys, "seq"])
    any_filled = F.max("filled").over(Window.partitionBy(*keys, "item"))
    shown = inside.withColumn("_any", any_filled).where("filled or not _any").select(*keys, "item", "seq", F.lit(True).alias("cited"))
    return shown.unionByName(near)


def dominant(df: DataFrame, by: Sequence[str], value: str, line: str) -> DataFrame:
    """The most frequent ``value`` of each group; ties go to the one seen on the earliest line."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(line).alias("first"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "first", value))
    return counted.withColumn("_r", best).where("_r = 1").select(*by, value, "n")


def ancestry(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor, depth) for every ancestor of every node, one parent a node; rings end where they close.

    Reaches twice as far each round: who is 2^r levels up brings along its own ancestors up to 2^r levels.
    Rounds end when none adds an ancestor, and each is written down, so nothing is computed twice.
    """
    near = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_a"), F.lit(1).alias("depth"))
    near = settled(near.where("_k is not null and _a is not null"))
    jump = near.select("_k", F.col("_a").alias("_j"))
    pairs, count = near.where("_k <> _a"), None
    reach = 1
    while True:
        far = jump.join(pairs.select(F.col("_k").alias("_j"), "_a", (F.col("depth") + reach).alias("depth")), "_j")
        both = pairs.unionByName(far.select("_k", "_a", "depth")).where("_k <> _a")
        pairs = settled(both.groupBy("_k", "_a").agg(F.min("depth").alias("depth")))
        before, count = count, pairs.count()
        if count == before:
            break
        step = jump.select(F.col("_k").alias("_j"), F.col("_j").alias("_n"))
        jump = settled(jump.join(step, "_j").select("_k", F.col("_n").alias("_j")))
        reach *= 2
    return pairs.select(F.col("_k").alias(key), F.col("_a").alias("ancestor"), "depth")


def blocks(records: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by..., block, first, messages, tool_calls, duration_ms): statistics of each run of records of an assistant.

    Records have role, kind and at (a timestamp).  A duration is null where a time is missing or the last
    record is before the first.
    """
    ours = F.coalesce(F.col("role") == "assistant", F.lit(False))
    in_order = Window.partitionBy(*by).orderBy(order)
    starts = ours & ~F.coalesce(F.lag(ours).over(in_order), F.lit(False))
    marked = records.withColumns({"_ours": ours, "_starts": starts.cast("int")})
    marked = marked.withColumn("block", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    call = F.col("kind") == "toolCall"
    found = marked.where("_ours").groupBy(*by, "block").agg(
        F.min(order).alias("first"), F.count_if(~F.coalesce(call, F.lit(False))).alias("messages"), F.count_if(call).alias("tool_calls"),
        F.min_by(F.struct("at"), order).alias("_head"), F.max_by(F.struct("at"), order).alias("_tail"),
    )
    span = F.unix_millis("_tail.at") - F.unix_millis("_head.at")
    return found.withColumn("duration_ms", F.when(span >= 0, span)).drop("_head", "_tail")
