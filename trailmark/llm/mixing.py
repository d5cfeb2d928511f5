"""Mixing sources to target weights by repeating documents.

Native: aggregates, windows and joins only.  Words are counted per source, every source gets a
repetition rate (target words / its words), and a document is emitted floor(rate) times plus one
more copy when a hash-seeded draw falls below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle

#: Fixed values of the mix: weights by place in the order of sources, and the most repeats.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-42"


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``: the source's position from 0 by code point, null last.

    Sources are range-partitioned and written once; a place is the row's number in its own
    partition plus the rows of the partitions before it, so no task sees all sources.
    """
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    cut = settle(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    start, at = [], 0
    for row in sorted(cut.groupBy("part").count().collect()):  # a row a partition
        start.append((row["part"], at))
        at += row["count"]
    offsets = spark.createDataFrame(start, "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return cut.withColumn("place", within - 1).join(F.broadcast(offsets), "part").select(
        "source", "source_size", (F.col("place") + F.col("start")).alias("place")
    )


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    All words are shared by weight.  A source stops at ``most`` times its own words; what it cannot
    take is shared again by weight among the others until none is above.  Only sums reach the
    driver, once a round.  A source without words gets target and rate 0.
    """
    sources = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    sources = settle(
        sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, last = 0.0, None
    while share != last:
        last = share
        above = F.lit(share) * F.col("weight") > F.col("most")
        held, free = sources.agg(
            F.sum(F.when(above, F.col("most")).otherwise(0)),
            F.sum(F.when(~above, F.col("weight")).otherwise(0)),
        ).first()
        if not free:
            break
        share = (total - held) / free
    wanted = F.lit(share) * F.col("weight")
    target = F.when(wanted > F.col("most"), F.col("most").cast("double")).otherwise(wanted)
    return sources.withColumn("target", target).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(0.0)
        .alias("rate"),
    )


def plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    Null text has size 0; null source is a source of its own, last in order.  The draw depends on
    the seed and doc_id alone (on the text where doc_id is null), so reruns agree and repeated rows
    share a draw.  Columns of ``docs`` named ``mix_*`` are replaced.  An empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.withColumn("mix_size", size)
    by = targets(sized.select("source", F.col("mix_size").alias("size")), weights, most)
    by = by.select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("rate").alias("mix_rate"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 12)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(2**48))
    floor = F.floor("mix_rate")
    copies = floor + F.when(draw < F.col("mix_rate") - floor, 1).otherwise(0)
    return (
        sized.join(by, sized["source"].eqNullSafe(by["mix_source"]))
        .withColumn("mix_copies", copies.cast("int"))
        .drop("mix_source", "mix_rate")
    )


def emit(planned: DataFrame) -> DataFrame:
    """Each planned document ``mix_copies`` times, with the columns it had before :func:`plan`."""
    out = planned.where("mix_copies > 0").withColumn(
        "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    )
    return out.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: :func:`plan` then :func:`emit`."""
    return emit(plan(docs, **options))
