"""What a reader may forget: how far each track was acknowledged, and which tracks must wait for others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.chains import inherited


def acknowledged(chunks: DataFrame, track: list[str], chunk: str = "chunk", line: str = "last_line", ok: str = "ok", messages: str | None = None) -> DataFrame:
    """(track, sent_through, chunks, messages, whole): each track up to its first chunk that was not acknowledged.

    Chunks are sent in order and sending stops at a failure, so what a later chunk's answer says counts not.  No
    answer is a failure.  ``sent_through`` is null where the first chunk failed: such a track has no checkpoint.
    """
    bad = F.when(~F.coalesce(F.col(ok), F.lit(False)), F.col(chunk))
    marked = chunks.withColumn("_stop", F.min(bad).over(Window.partitionBy(*track)))
    sent = F.col("_stop").isNull() | (F.col(chunk) < F.col("_stop"))
    return marked.groupBy(*track).agg(
        F.max(F.when(sent, F.col(line))).alias("sent_through"), F.count_if(sent).alias("chunks"),
        F.sum(F.when(sent, F.col(messages) if messages else F.lit(1)).otherwise(0)).alias("messages"), F.bool_and(sent).alias("whole"),
    )


def checkpoints(old: DataFrame, sent: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """(key, line) after a cycle: a whole track is done up to its ``last_line`` read, which may lie behind its last chunk; a
    part up to what was acknowledged; one that failed, or was not sent, as far as before."""
    met = tracks.select(key, "last_line").join(sent.select(key, "sent_through", "whole"), key, "full").join(old.select(key, F.col("line").alias("_old")), key, "full")
    now = F.when(F.col("whole"), F.coalesce("last_line", "sent_through")).otherwise(F.col("sent_through"))
    return met.select(key, F.coalesce(now, F.col("_old")).alias("line")).where("line is not null")


def waves(tracks: DataFrame, key: str, parent: str, failed: str) -> DataFrame:
    """``tracks`` with ``wave`` and ``held``: parents go before their children, and below a failed one nothing goes.

    ``wave`` is the number of tracks above.  ``failed``: whether a track has failed itself (it is not ``held`` for
    that).  Failure is carried down by doubling; tracks of a ring are held, and have no wave.
    """
    above = inherited(tracks, key, parent, F.col(failed)).withColumnsRenamed({"depth": "wave", "inherited": "held"})
    return tracks.join(above, key)
