"""Row transformers in order, and how many rows each changed, counted in the pass that writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transformer:
    """``value`` replaces ``column`` where it differs; it may read what transformers before it made."""

    name: str
    column: str
    value: Column


def transformed(rows: DataFrame, transformers: Sequence[Transformer]) -> tuple[DataFrame, Observation]:
    """(rows, counts): ``rows`` after all transformers, and an observation of ``rows`` and of what each changed.

    The counts are there once the returned rows are written; nothing is read twice.  A null that stays null is no change.
    """
    seen = Observation()
    out, flags = rows, []
    for i, t in enumerate(transformers):
        flag = f"_changed_{i}"
        out = out.withColumn("_next", t.value).withColumn(flag, ~F.col("_next").eqNullSafe(F.col(t.column)))
        out = out.withColumn(t.column, F.col("_next")).drop("_next")
        flags.append(flag)
    counts = [F.count_if(F.col(f)).alias(t.name) for f, t in zip(flags, transformers, strict=True)]
    return out.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).select(*rows.columns), seen


#: How a line that tells of a finished task begins.
NOTIFICATION = "<task-notification>"


def task_notification(role: str = "role", kind: str = "msg_type", sub_kind: str = "sub_type", text: str = "text") -> Transformer:
    """User messages without a sub-type whose line is a task's notification get that sub-type."""
    told = (F.col(kind) == "message") & (F.col(role) == "user") & F.col(sub_kind).isNull() & F.ltrim(F.col(text)).startswith(NOTIFICATION)
    return Transformer("task-notification-subtype", sub_kind, F.when(told, "taskNotification").otherwise(F.col(sub_kind)))
