"""Target-distribution importance resampling over hashed word features.

Texts become a sparse document-by-bucket count matrix, persisted as CSR blocks: a row of the table holds the
documents of one batch, ``indptr``, ``indices`` (buckets) and ``counts``.  Column sums of the corpus' and the target's
matrices give two distributions, their ratio a gain a bucket, and the product of matrix and gains the weights of
the documents.  Weights plus Gumbel noise that is keyed by document rank them: the highest are a draw without
replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, parts, settle, settle_blocks

#: Parameters: buckets of features, words of the longest feature, words a drawn document has at least, share drawn.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of text whose words are held as arrays at once.
WINDOW = 1 << 22
#: Words of more bytes are hashed one by one.
LONG = 64

_CSR = "ids array<{}>, words array<long>, indptr array<int>, indices array<int>, counts array<int>"


def _lower() -> np.ndarray:
    """Bytes with A-Z lower-cased, and 0 for those that part words: ASCII but letters and digits."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    ascii_ = np.arange(128)
    word = ((ascii_ >= 48) & (ascii_ <= 57)) | ((ascii_ >= 97) & (ascii_ <= 122)) | ((ascii_ >= 65) & (ascii_ <= 90))
    table[:128][~word] = 0
    return table


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


_LOWER, _STEP = _lower(), _crc_table()
_SPACE = np.uint32(32)


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each word; all words advance by one byte together."""
    out = state.copy()
    order = np.argsort((LONG + 1 - np.minimum(lengths, LONG + 1)).astype(np.uint8), kind="stable")  # longest first
    at, size, state = starts[order], lengths[order], out[order]
    long = int((lengths > LONG).sum())
    raw = data.tobytes() if long else b""
    for i in range(long):
        a = int(at[i])
        state[i] = zlib.crc32(raw[a : a + int(size[i])], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    left = np.searchsorted(-size[long:], -np.arange(LONG + 1), "left")  # of how many words byte j is one
    for j in range(LONG):
        n = int(left[j])
        if not n:
            break
        some = state[long : long + n]
        state[long : long + n] = _STEP[(some ^ data[at[long : long + n] + j]) & 0xFF] ^ (some >> np.uint32(8))
    out[order] = state
    return out


def windows(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, bool]]:
    """(start, end, inside) of stretches of about ``window`` bytes that cut no word; ``inside`` if the start lies in
    the text that the stretch before ends in."""
    start, end_of_all, inside = int(offsets[0]), int(offsets[-1]), False
    while start < end_of_all:
        end = min(start + window, end_of_all)
        following = int(offsets[np.searchsorted(offsets, start, "right")])  # the end of the text that start is in
        whole = int(offsets[np.searchsorted(offsets, end, "right") - 1])  # the last text border up to end
        if whole > start:
            end, goes_on = whole, False
        else:
            while end < following:  # a longer text: on to a byte that parts words
                gaps = np.flatnonzero(_LOWER[raw[end : min(end + window, following)]] == 0)
                if len(gaps):
                    end += int(gaps[0]) + 1
                    break
                end = min(end + window, following)
            goes_on = end < following
        yield start, end, inside
        start, inside = end, goes_on


def counted(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, run: int = RUN, window: int = WINDOW) -> tuple:
    """(words, indptr, indices, counts) of the texts raw[offsets[i]:offsets[i + 1]]: the CSR block of their features."""
    n = len(offsets) - 1
    words = np.zeros(n, np.int64)
    keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    tail = np.empty(0, np.uint8)  # the last words of a text that goes on, for features that cross the cut
    for start, end, inside in windows(raw, offsets, window):
        tail = tail if inside else tail[:0]
        data = np.concatenate([np.zeros(1, np.uint8), tail, _LOWER[raw[start:end]], np.zeros(1, np.uint8)])
        edges = np.flatnonzero(np.diff((data != 0).view(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        # texts follow one another without a gap, so a text's border parts words too
        borders = offsets[(offsets > start) & (offsets < end)] - start + 1 + len(tail)
        if len(borders):
            at = np.searchsorted(ends, borders, "right")
            cut = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < borders) if len(starts) else np.zeros(len(borders), bool)
            split = np.unique(borders[cut])
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
        carried = int(np.searchsorted(starts, 1 + len(tail), "left"))
        row = np.searchsorted(offsets, np.maximum(starts - 1 - len(tail), 0) + start, "right") - 1
        words += np.bincount(row[carried:], minlength=n)
        state = _fed(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends - starts)
        found = [(row[carried:], state[carried:])]
        grown, first = state, np.arange(len(starts))
        for k in range(2, run + 1):  # runs of k words: those of k - 1, a space, and the word behind
            last = first + k - 1
            fits = last < len(starts)
            first, last, grown = first[fits], last[fits], grown[: len(first)][fits]
            same = row[first] == row[last]
            first, last, grown = first[same], last[same], grown[same]
            grown = _STEP[(grown ^ _SPACE) & 0xFF] ^ (grown >> np.uint32(8))
            grown = _fed(grown, data, starts[last], (ends - starts)[last])
            new = last >= carried
            found.append((row[last[new]], grown[new]))
        for rows, crc in found:
            key, times_ = np.unique(rows.astype(np.int64) * buckets + (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets, return_counts=True)
            keys.append(key)
            times.append(times_)
        tail = data[starts[-min(run - 1, len(starts))] : -1] if run > 1 and len(starts) else data[:0]
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(place, np.concatenate(times), len(key)).astype(np.int64)
    indptr = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) * buckets)
    return words, indptr, key % buckets, times


def blocks(texts: DataFrame, by: str, column: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """The count matrix of ``texts`` as CSR blocks: ids (of column ``by``), words, indptr, indices and counts.

    Null texts and texts without words are rows without entries.
    """
    rows = texts.select(F.col(by), F.coalesce(F.col(column), F.lit("")).cast("binary"))
    kind = rows.schema[0].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = text.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            yield _block(batch.column(0), *counted(raw, offsets, buckets, run))

    return map_arrow(rows, make, _CSR.format(kind))


def _block(ids: pa.Array, words, indptr, indices, counts) -> pa.RecordBatch:
    def one(values, kind=None) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [one(ids), one(words, pa.int64()), one(indptr, pa.int32()), one(indices, pa.int32()), one(counts, pa.int32())],
        ["ids", "words", "indptr", "indices", "counts"],
    )


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): summed within each task first, so that a task sends a row a bucket at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch, 0), _flat(batch, 1), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return map_arrow(matrix.select("indices", "counts"), add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _flat(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A gain a bucket, in thousandths: the logarithm of its smoothed share in the target over that in the corpus.

    A row a bucket is all that the driver sees.
    """
    s, t = (np.zeros(buckets) for _ in range(2))
    for sums, into in ((corpus, s), (target, t)):
        for bucket, n in sums.collect():  # a row a bucket at most
            into[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of the matrix: its product with ``gain``."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, indptr, indices, counts = (batch.column(k)[i].values for k in range(5))
                ptr, n = indptr.to_numpy(), counts.to_numpy().astype(np.int64)
                worth = np.concatenate([[0], np.cumsum(gain[indices.to_numpy()] * n)])
                held = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [ids, words, pa.array(np.diff(held[ptr]), pa.int64()), pa.array(np.diff(worth[ptr]), pa.int64())],
                    ["id", "n_words", "n_features", "weight"],
                )

    return map_arrow(matrix.select("ids", "words", "indptr", "indices", "counts"), times, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and key."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((bits.cast("double") + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, by: str, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``percent`` % highest scores of rows with ``least`` words, else null.

    Candidates are sorted in ranges; a rank is a row's place in its range plus the rows of the ranges before it, so
    no task sees all.  Equal scores go to the smaller ``by``, null last, then to fewer features.
    """
    spark = scored.sparkSession
    order = [F.col("score").desc(), F.col(by).asc_nulls_last(), F.col("n_features")]
    dealt = scored.where(F.col("n_words") >= least).withColumn("_spread", F.monotonically_increasing_id())
    cut = settle(dealt.repartitionByRange(parts(spark), *order, "_spread").withColumn("_part", F.spark_partition_id()))
    start, total = [], 0
    for part, n in sorted(map(tuple, cut.groupBy("_part").count().collect())):  # a row a partition
        start.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(start, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rank = F.col("_place") + F.col("_start")
    ranked = cut.withColumn("_place", place).join(offsets, "_part").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def scores(docs: DataFrame, target: DataFrame, by: str = "doc_id", buckets: int = BUCKETS, run: int = RUN, seed: str = SEED) -> DataFrame:
    """(``by``, n_words, n_features, weight, score) of every document; its count matrix is written once and read twice."""
    matrix = settle_blocks(blocks(docs, by, buckets=buckets, run=run))
    gain = gains(column_sums(matrix, buckets), column_sums(blocks(target.withColumn("_id", F.lit(0)), "_id", buckets=buckets, run=run), buckets), buckets)
    weighed = weights(matrix, gain).withColumnRenamed("id", by)
    return weighed.withColumn("score", F.col("weight") + noise(F.col(by), seed))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of ``docs``; ``rank`` is null where it is not drawn.

    Null and empty texts have no features and weight 0; a null doc_id draws its noise from an empty key and
    comes last among ties; repeated rows are drawn one by one.  An empty corpus gives no rows; an empty target
    makes all its shares equal.  Other columns, whatever their names, are left behind.
    """
    scored = settle(scores(docs.select("doc_id", "text"), target.select("text"), **options))
    return drawn(scored, "doc_id").select("doc_id", "n_features", "weight", "score", "rank")
