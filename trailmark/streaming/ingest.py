"""Micro-batch ingest of transcripts: effectively once, tables in order, a batch visible when complete.

A table is a folder with one part a batch, and in it one a shard of sessions: a batch reads what is stored of the shards of
its own sessions alone.  A batch that runs again overwrites its own part.  Its manifest, written last and seen only
when whole, names all batches that count; readers take the latest.  Sessions that are read anew leave
tombstones: what earlier batches have of them is void from the batch that says so, in the same step as its rows appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import upsert
from ..sources import transcripts
from ..tables import delete, exists, settled

KEY = ["session_id", "line_uuid", "sub_index"]
#: Shards of sessions: what a batch has to read of the store shrinks by it.
SHARDS = 64
#: Manifests kept behind the latest, for readers that began before it.
BEHIND = 3


def shard(session: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(shards)).cast("int")


class Store:
    """Tables below a folder that driver and executors share; one writer."""

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards

    def latest(self) -> int | None:
        """The last committed batch."""
        if not exists(self.spark, f"{self.path}/manifests"):
            return None
        return max(self._manifests(), default=None)

    def _manifests(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/manifests")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        names = [f.getPath().getName() for f in found]
        return [int(n[3:]) for n in names if n.startswith("at=") and exists(self.spark, f"{self.path}/manifests/{n}/_SUCCESS")]

    def committed(self) -> list[tuple[int, int]]:
        """Committed batches as ranges, both ends included: a few, however many batches there are."""
        at = self.latest()
        if at is None:
            return []
        rows = self.spark.read.schema("first long, last long").parquet(f"{self.path}/manifests/at={at}").collect()  # a range a row
        return sorted((r["first"], r["last"]) for r in rows)

    def read(self, name: str, schema: StructType, before: int | None = None, shards: list[int] | None = None) -> DataFrame:
        """Rows of committed batches that no tombstone voids; ``before`` leaves out that batch and later ones, ``shards``
        all other shards.  Both prune folders."""
        at, ranges = f"{self.path}/{name}", self.committed()
        if not ranges or not exists(self.spark, at):
            return self.spark.createDataFrame([], schema)
        rows = self._pruned(at, StructType([*schema]), ranges, before, shards)
        gone = f"{self.path}/gone"
        if exists(self.spark, gone) and "session_id" in schema.names:
            void = self._pruned(gone, StructType().add("session_id", schema["session_id"].dataType), ranges, before, shards)
            void = void.groupBy(F.col("session_id").alias("_gone")).agg(F.max("batch").alias("_since"))
            rows = rows.join(void, (F.col("session_id") == F.col("_gone")) & (F.col("batch") < F.col("_since")), "left_anti")
        return rows.drop("batch", "shard")

    def _pruned(self, at: str, schema: StructType, ranges: list[tuple[int, int]], before: int | None, shards: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(StructType([*schema]).add("batch", "long").add("shard", "integer")).parquet(at)
        counts = F.lit(False)
        for first, last in ranges:
            counts |= F.col("batch").between(first, last)
        rows = rows.where(counts)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return rows if shards is None else rows.where(F.col("shard").isin(shards))

    def write(self, name: str, rows: DataFrame, batch: int, by: str | None = "session_id") -> None:
        """The part of ``batch``, in place of what an attempt before left; rows without a session are shard 0."""
        at = F.coalesce(shard(F.col(by), self.shards), F.lit(0)) if by else F.lit(0)
        rows.withColumn("shard", at).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{name}/batch={batch}")

    def commit(self, batch: int) -> None:
        """Makes ``batch`` count, with all that counted before."""
        ranges: list[list[int]] = []
        for first, last in sorted([*self.committed(), (batch, batch)]):
            if ranges and first <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], last)
            else:
                ranges.append([first, last])
        latest = self.latest()
        number = batch if latest is None else max(batch, latest)
        made = self.spark.createDataFrame(ranges, "first long, last long").coalesce(1)
        if latest is None or number > latest:
            made.write.parquet(f"{self.path}/manifests/at={number}")
        elif [tuple(r) for r in ranges] != self.committed():  # an older batch fills a hole: the next number
            made.write.parquet(f"{self.path}/manifests/at={number + 1}")
        for old in sorted(self._manifests())[: -BEHIND - 1]:
            delete(self.spark, f"{self.path}/manifests/at={old}")

    def shards_of(self, rows: DataFrame) -> list[int]:
        """The shards of the sessions in ``rows``: no more numbers than there are shards."""
        return sorted(r[0] for r in rows.select(shard(F.col("session_id"), self.shards)).distinct().collect() if r[0] is not None)


def ingest_messages(store: Store, messages: DataFrame, batch: int, anew: DataFrame | None = None, order: str = "line", at: str = "ts") -> dict[str, int]:
    """One batch of messages (KEY, ``order``, ``at``, ...): those not yet stored, what they add to sessions, and counts.

    ``anew`` (session_id): sessions whose stored rows are void from this batch on; a session of it that has no message in
    the batch is gone.
    """
    messages = settled(messages)
    near = store.shards_of(messages)
    stored = store.read("messages", messages.schema, before=batch, shards=near)
    if anew is not None:
        anew = anew.select("session_id").distinct()
        stored = stored.join(anew, "session_id", "left_anti")
    fresh, counts = upsert.insert_ignore(stored, messages, KEY, F.col(order))
    row = counts.first()
    store.write("messages", fresh, batch)
    store.write("sessions", session_windows(fresh, at), batch)
    none = messages.select("session_id").limit(0)
    store.write("gone", none if anew is None else anew, batch)
    return {"ingested": row["ingested"], "deduped": row["deduped"]}


def ingest_files(store: Store, files: DataFrame, batch: int, anew: DataFrame | None = None) -> dict[str, int]:
    """One batch of (path, content): messages not yet stored, rejected files, and counts.

    Main tracks and helpers of a batch are one job, so a helper never waits for its parent; a file is read
    again as a whole when it grows, and what is stored already is left out by key.
    """
    records, rejects = transcripts.parse_lines(transcripts.complete_lines(files))
    placed = records.withColumn("_c", transcripts.classify(F.col("path"))).where("_c is not null")
    store.write("rejects", rejects, batch, None)
    counts = ingest_messages(store, transcripts.normalise(placed.select("_c.*", "line", "raw")), batch, anew)
    store.commit(batch)
    return counts


def session_windows(messages: DataFrame, at: str = "ts") -> DataFrame:
    """What a batch adds to sessions: first and last time, messages."""
    return messages.groupBy("session_id").agg(
        F.min(at).alias("started_at"), F.max(at).alias("last_message_at"), F.count("*").alias("messages")
    )


def sessions(store: Store, schema: StructType) -> DataFrame:
    """Sessions over all batches: windows widen, counts add up."""
    return store.read("sessions", schema).groupBy("session_id").agg(
        F.min("started_at").alias("started_at"), F.max("last_message_at").alias("last_message_at"), F.sum("messages").alias("messages")
    )


def follow(spark: SparkSession, source: str, store: Store, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Starts the stream of new transcript files below ``source`` into ``store``."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(source)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_files(store, df, n) and None)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def replay(store: Store, files: DataFrame, batch: int) -> dict[str, int]:
    """Reads whole sessions anew: what is stored of the sessions of ``files`` (path, content: all files of each) is void, and
    what the files say now takes its place, in one step."""
    placed = files.select(transcripts.classify(F.col("path")).alias("c")).where("c is not null").select("c.session_id")
    return ingest_files(store, files, batch, placed)
