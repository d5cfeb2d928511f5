"""Calls and their results as a stream: a call waits over micro-batches until its result comes, or its patience ends.

State is one session, kept by ``transformWithState``: what arrived and is not settled yet, and the calls that are open.  A
state's reads, writes and timers cost more than its rows, so the calls of a session share them.  Rows are settled in event time once the watermark has passed them, woken by event-time timers, so the
outcome does not depend on how rows were dealt to batches, nor on restarts.  :func:`in_batch` says the same of a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

#: State of ``transformWithState`` is kept by this provider only.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _states(call) -> tuple[StructType, StructType]:
    """Types of the rows held and of the calls open."""
    named, at = StructField("call_id", call), StructField("at", LongType())
    return StructType([named, at, StructField("seq", LongType()), StructField("kind", StringType())]), StructType([named, at])


def _outcome(session, call) -> StructType:
    return StructType([
        StructField("session_id", session), StructField("call_id", call), StructField("call_at", TimestampType()),
        StructField("result_at", TimestampType()), StructField("outcome", StringType()),
    ])


def _instant(micros: int | None) -> datetime | None:
    return None if micros is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


class Settler(StatefulProcessor):
    """Settles the rows of one session's calls.  Times are microseconds; a timer is set for the next moment something is due."""

    def __init__(self, patience: timedelta, call):
        self.patience = patience // timedelta(microseconds=1)
        self.call = call

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows, began = _states(self.call)
        self.rows = handle.getListState("rows", rows)
        self.open = handle.getListState("open", began)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.call_id, r.at_us, r.seq, r.kind) for r in rows]
        self.rows.appendList(new)
        self.handle.registerTimer(min(at for _, at, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        due: dict = {}
        left, out = [], []
        for call, *row in self.rows.get():
            if row[0] // 1000 < mark:
                due.setdefault(call, []).append(tuple(row))
            else:
                left.append((call, *row))
        was = {call: at for call, at in self.open.get()}
        began = dict(was)
        for call, rows in due.items():
            self._settle(key[0], call, sorted(rows), began, out)
        for call, at in list(began.items()):
            if (at + self.patience) // 1000 < mark:
                out.append(self._said(key[0], call, at, None, "unanswered"))
                del began[call]
        if due:
            self._keep(self.rows, left)
        if began != was:
            self._keep(self.open, list(began.items()))
        ends = [at for _, at, _, _ in left] + [at + self.patience for at in began.values()]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)
        return iter(out)

    def _settle(self, session, call, rows: list[tuple], began: dict, out: list[Row]) -> None:
        """Settles the ``rows`` of one call in order; ``began`` tells when it was called, if it is open."""
        start = began.pop(call, None)
        for at, _, kind in rows:
            within = start is not None and at - start <= self.patience
            if kind == "call":
                if start is not None:
                    out.append(self._said(session, call, start, None, "superseded" if within else "unanswered"))
                start = at
            else:
                if within:
                    out.append(self._said(session, call, start, at, "answered"))
                else:
                    if start is not None:
                        out.append(self._said(session, call, start, None, "unanswered"))
                    out.append(self._said(session, call, None, at, "orphan"))
                start = None
        if start is not None:
            began[call] = start

    @staticmethod
    def _said(session, call, at: int | None, result: int | None, outcome: str) -> Row:
        return Row(session_id=session, call_id=call, call_at=_instant(at), result_at=_instant(result), outcome=outcome)

    @staticmethod
    def _keep(state, values: list[tuple]) -> None:
        if values:
            state.put(values)
        else:
            state.clear()

    def close(self) -> None:
        pass


def settled_calls(messages: DataFrame, patience: timedelta, late: str) -> DataFrame:
    """(session_id, call_id, call_at, result_at, outcome) of a stream of messages (session_id, call_id, kind, at, seq).

    ``kind`` is call or result; anything else, and a null key or time, is left out.  A result answers the call of its id
    that came last before it, in order of time and ``seq``, if no more than ``patience`` before.  Outcomes:
    ``answered``; ``unanswered`` (patience ended); ``superseded`` (the id was called again first); ``orphan`` (a result
    without such a call).  Rows later than ``late`` behind the latest time seen may be dropped by Spark; stored rows
    answer for those (``operators.export``).  Needs :data:`PROVIDER` to be :data:`ROCKS`.
    """
    rows = _rows(messages).withWatermark("at", late)
    kinds = [rows.schema[c].dataType for c in ("session_id", "call_id")]
    named = rows.select("session_id", "call_id", "kind", "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("long").alias("seq"))
    return named.groupBy("session_id").transformWithState(
        statefulProcessor=Settler(patience, kinds[1]), outputStructType=_outcome(*kinds), outputMode="append", timeMode="EventTime"
    )


def _rows(messages: DataFrame) -> DataFrame:
    whole = F.col("session_id").isNotNull() & F.col("call_id").isNotNull() & F.col("at").isNotNull()
    return messages.where(whole & F.col("kind").isin("call", "result"))


def in_batch(messages: DataFrame, patience: timedelta, late: timedelta) -> DataFrame:
    """What :func:`settled_calls` has settled once it has seen the whole table ``messages``."""
    rows = _rows(messages).withColumn("_us", F.unix_micros("at"))
    mark = rows.agg((F.floor(F.max("_us") / 1000) - late // timedelta(milliseconds=1)).alias("_mark"))
    w = Window.partitionBy("session_id", "call_id").orderBy("_us", "seq", "kind")
    wait = patience // timedelta(microseconds=1)
    past = rows.crossJoin(F.broadcast(mark)).where(F.floor(F.col("_us") / 1000) < F.col("_mark"))  # one row
    near = past.select(
        "*", F.lead(F.struct("kind", "_us", "at")).over(w).alias("_next"), F.lag(F.struct("kind", "_us")).over(w).alias("_last")
    )
    soon = F.col("_next._us") - F.col("_us") <= wait
    over = F.floor((F.col("_us") + wait) / 1000) < F.col("_mark")
    of_call = F.when(soon & (F.col("_next.kind") == "result"), "answered").when(soon, "superseded").when(F.col("_next").isNotNull() | over, "unanswered")
    is_call = F.col("kind") == "call"
    answers = F.coalesce((F.col("_last.kind") == "call") & (F.col("_us") - F.col("_last._us") <= wait), F.lit(False))
    outcome = F.when(is_call, of_call).when(~answers, "orphan")
    return near.withColumn("outcome", outcome).where("outcome is not null").select(
        "session_id", "call_id", F.when(is_call, F.col("at")).alias("call_at"),
        F.when(~is_call, F.col("at")).when(F.col("outcome") == "answered", F.col("_next.at")).alias("result_at"), "outcome",
    )


def run_through(messages: DataFrame, to: str, patience: timedelta, late: str) -> None:
    """Streams all there is of ``messages`` through :func:`settled_calls` into ``to``/rows; the checkpoint lies beside it, so
    the next run goes on from there."""
    spark = messages.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = settled_calls(messages, patience, late).writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint")
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
