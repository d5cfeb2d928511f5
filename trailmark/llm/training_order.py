"""Training-order materialisation: token sequences in shards of fixed stride, in a keyed random order.

Sequences are numbered 0 to N-1 by doc_id, text and part, whatever partitions they come in; a keyed Feistel
network on a slightly larger power of four, walked until it falls below N, permutes the numbers.  A
sequence's image is its slot in the training order.  Range partitions of the slots are written as raw
files, one a shard, of records of one size: slot i is in shard i // per_shard at byte
(i % per_shard) * stride, and a run resumes from any slot by reading on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, map_arrow, new_folder, parts, settle, text_of, write_clean

KEY = 20_250_101
#: Tokens of a record, records of a shard, and the number that fills up a record.
LENGTH, PER_SHARD, PAD = 512, 1 << 14, 0xFFFF
#: How sequences are packed while they wait for their slots: token ids shrink by half.
PACKED = {"compression": "zstd"}
#: Shards are written in so many parts, one after another: of what is exchanged only a part lies on disk at once.
WAVES = 4


class Feistel:
    """A permutation of 0 .. n-1 for a key: four rounds on two halves, with cycle-walking."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(31)) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._round(left, key), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step: Callable) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        out = x >= self.n
        while out.any():
            x[out] = step(x[out])
            out = x >= self.n
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._once)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, token_ids) of every whole text (null: empty) by the public tokenizer library; ids are
    little-endian unsigned 16-bit numbers, and special tokens' strings are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        from .bpe import vocabulary

        coder = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=vocabulary(path, pattern).ranks, special_tokens={}
        )
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                ids = [np.array(coder.encode_ordinary(t.as_py()), "<u2").tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary())], ["doc_id", "token_ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of(docs)), run, "doc_id long, token_ids binary")


def sequences(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """(task, place, doc_id, part, ids): token lists cut in parts of ``length`` tokens at most, numbered
    within the task that made them.  A document without tokens has no part; null lists neither."""
    size = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                doc, part, ids = [], [], []
                for d, packed in zip(*(batch.column(k).slice(start, 256) for k in (0, 1)), strict=True):
                    packed = packed.as_py() or b""
                    for i in range(0, len(packed), size):
                        doc.append(d.as_py())
                        part.append(i // size)
                        ids.append(packed[i : i + size])
                n = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()),
                     pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(ids, pa.binary())],
                    ["task", "place", "doc_id", "part", "ids"],
                )
                place += n

    return map_arrow(
        tokens.select("doc_id", "token_ids"),
        run, "task int, place long, doc_id long, part int, ids binary"
    )


def arranged(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` in the order of doc_id and ``content``, nulls first, in ranges: all before or all behind one another.

    The order does not depend on how ``rows`` were dealt.  Rows equal in both are alike, so a third key that
    does depend on it, and only spreads a row that is repeated very often, changes nothing.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64(content), F.monotonically_increasing_id()]
    named = rows.withColumns({f"_by{i}": k for i, k in enumerate([F.col("doc_id"), *keys[1:]])})
    by = [F.col("_by0").asc_nulls_first(), F.col("_by1"), F.col("_by2")]
    return named.repartitionByRange(parts(rows.sparkSession), *by).sortWithinPartitions(*by).select(rows.columns)


def ordered(tokens: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(slot, doc_id, part, ids) of every sequence of (doc_id, token_ids); slots are 0 .. N-1, each once.

    The same rows have the same slots however they are partitioned.
    """
    return _slots(sequences(arranged(tokens.select("doc_id", "token_ids"), "token_ids"), length), key)


def ordered_documents(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """:func:`ordered` of the tokens of whole texts, which are arranged before they are tokenised."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return _slots(sequences(tokenised(arranged(rows, "text"), path, pattern), length), key)


def _slots(made: DataFrame, key: int) -> DataFrame:
    """Sequences that are written to the shared folder once, so that their numbers stay as they are whatever is
    lost.  A count for each task is all that the driver sees."""
    made = settle(made, **PACKED)
    counts = sorted(map(tuple, made.groupBy("task").count().collect()))
    first = dict(zip([t for t, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    total = sum(n for _, n in counts)
    start = made.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("long")
    def slot(task, place):
        number = task.map(start.value) + place
        return number.__class__(Feistel(total, key).slot(number.to_numpy()))

    return made.withColumn("slot", slot("task", "place")).select("slot", "doc_id", "part", "ids")


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: 4 for its number of tokens, the largest first, 2 a token, the smaller first, and a line end."""
    return 4 + 2 * length + 1


def write_shards(made: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, pad: int = PAD, waves: int = WAVES) -> None:
    """Writes ordered sequences to ``path``/wave=w/shard=i/, a raw file of fixed-stride records each, in slot order.

    Tasks cover ranges of shards, and waves ranges of these, one after another.  Nothing is seen of a wave that is not
    complete; one that is complete is not done again, so a write that broke goes on where it was.  No sequences
    make a folder without shards.
    """
    spark = made.sparkSession
    shards = -(-made.count() // per_shard)
    waves = max(1, min(waves, shards))
    ranges = max(1, min(-(-shards // waves), parts(spark, 4)))
    fill = F.lit(bytes(np.array([pad], "<u2").tobytes()))
    head = F.unhex(F.lpad(F.hex(F.octet_length("ids") / 2), 8, "0"))
    record = F.concat(head, F.rpad("ids", 2 * length, fill))
    dealt = made.withColumn("shard", F.floor(F.col("slot") / per_shard))
    for wave in range(waves):
        at, first, end = f"{path}/wave={wave}", wave * shards // waves, (wave + 1) * shards // waves
        if exists(spark, f"{at}/_SUCCESS"):
            continue
        own = dealt.where(F.col("slot").between(first * per_shard, end * per_shard - 1))
        own = own.repartitionById(ranges, F.expr(f"cast((shard - {first}) * {ranges} div {max(1, end - first)} as int)"))
        rows = own.sortWithinPartitions("shard", "slot").select("shard", record.cast("string").alias("value"))
        write_clean(spark, lambda: rows.write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").text(at))  # noqa: B023


def index(made: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, first_slot, n, doc_ids, parts): what the records of each shard are, in order."""
    entry = F.struct("slot", "doc_id", "part")
    held = made.groupBy(F.floor(F.col("slot") / per_shard).alias("shard")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return held.select(
        "shard", F.col("e")[0]["slot"].alias("first_slot"), F.size("e").cast("long").alias("n"),
        F.col("e.doc_id").alias("doc_ids"), F.col("e.part").alias("parts"),
    )


def read_shards(spark: SparkSession, path: str, slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """(shard, content): the written shards that a run resumed at ``slot`` reads; of the first it skips
    ``slot % per_shard`` records."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("shard") >= slot // per_shard).select(F.col("shard").cast("long").alias("shard"), "content")


def materialise(docs: DataFrame, path: str, pattern: str, to: str | None = None) -> DataFrame:
    """(shard, first_slot, n, doc_ids, parts, n_bytes, payload_sha256) of every shard of whole texts, written to ``to``
    (else a new shared folder); sizes and digests are those of the files read back.

    Null text has no tokens and no sequence; a null doc_id stays null; repeated rows are sequences of their
    own.  An empty table gives no shards.  Other columns are left behind.
    """
    spark = docs.sparkSession
    to = to or new_folder(spark, "shards")
    made = ordered_documents(docs, path, pattern)
    write_shards(made, to)
    if made.isEmpty():
        return spark.createDataFrame([], "shard long, first_slot long, n long, doc_ids array<long>, parts array<int>, n_bytes long, payload_sha256 string")
    files = read_shards(spark, to).select(
        "shard", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("payload_sha256")
    )
    return index(made).join(files, "shard")


def records(content: bytes, length: int = LENGTH) -> list[list[int]]:
    """The token ids of every record of a shard."""
    rows = np.frombuffer(content, np.uint8).reshape(-1, stride(length))
    return [row[4 : 4 + 2 * int.from_bytes(row[:4].tobytes())].copy().view("<u2").tolist() for row in rows]
