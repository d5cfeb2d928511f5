"""Exact top-k by inner product with a vector-approximation file.

Every vector is kept a second time as a row of cell numbers, a byte a dimension.  A cell says how small
and how large a component can be, so a scan of this much smaller file bounds every score from both
sides.  A first part of the file gives each query a floor, the kth best lower bound; the rest is scanned
against it.  Exact vectors are then read by their best possible score: the first few, and after them only
those that could still be better than the kth result found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, parts, settle

#: Cells of a dimension at most (a byte), and vectors that their edges are fitted on, the first by a hash.
CELLS, SAMPLE = 256, 20_000
#: Rows of the approximation file in one block: at least and at most, about; queries of one list at most.
BLOCK, MOST, ASKED = 4096, 1 << 16, 2048
_LONG = float(2**63)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x); doubles hold these whole numbers exactly, whatever their size."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * x.astype(np.float64)))


def fit_cells(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(edges, least, most): by dimension the edges between cells, and what a cell's components can be.

    ``x`` are sampled whole vectors, ``low`` and ``high`` the least and most component of all vectors.
    """
    n, dims = x.shape
    edges, least, most = [], np.zeros((dims, CELLS)), np.zeros((dims, CELLS))
    for k in range(dims):
        column = np.sort(x[:, k])
        own = np.unique(column[np.arange(1, CELLS) * n // CELLS])
        edges.append(own)
        least[k, : len(own) + 1] = np.concatenate([[low[k]], own])
        most[k, : len(own) + 1] = np.concatenate([own - 1, [high[k]]])
    return edges, least, most


def cells_of(x: np.ndarray, edges: list) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for k, own in enumerate(edges):
        out[:, k] = np.searchsorted(own, x[:, k], "right")
    return out


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most possible score of each query with each vector between ``low`` and ``high``, rounded
    outward by more than floating point can be wrong."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * ((q.shape[1] + 8) * 4.5e-16)
        least, most = np.nan_to_num(least - slack, nan=-np.inf, neginf=-np.inf, posinf=_LONG), most + slack
    most[np.isnan(most)] = np.inf
    # scores are held to the range of a long, and so are bounds
    return np.clip(least, -_LONG, _LONG * (1 - 1e-15)), np.maximum(most, -_LONG)


def scan(ids: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple]:
    """(query ids, vec_ids, least, most) of all that may be among the k best: what reaches the query's
    ``floor`` and the kth best lower bound of this block.  Own ids are passed over."""
    step = max(1, (1 << 22) // max(1, len(ids)))
    for start in range(0, len(q), step):
        names = asked[start : start + step]
        least, most = bounds(q[start : start + step], low, high)
        own = names[:, None] == ids[None, :]
        least[own], most[own] = -np.inf, -np.inf
        need = floor[start : start + step]
        if len(ids) > k:
            need = np.maximum(need, -np.partition(-least, k - 1, axis=1)[:, k - 1])
        row, at = np.nonzero((most >= need[:, None]) & ~own)
        yield names[row], ids[at], least[row, at], most[row, at]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row of whole vectors, exact; beyond a long, the nearest long."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    fits = np.abs(x).max(1) * np.abs(q).max(1) * x.shape[1] < 2.0**62
    fits &= (np.abs(x).max(1) < 2.0**62) & (np.abs(q).max(1) < 2.0**62)
    out = np.zeros(len(x), np.int64)
    out[fits] = np.einsum("nd,nd->n", x[fits].astype(np.int64), q[fits].astype(np.int64))
    for row in np.flatnonzero(~fits):
        total = sum(int(a) * int(b) for a, b in zip(x[row], q[row], strict=True))
        out[row] = min(max(total, -(2**63)), 2**63 - 1)
    return out


def _flat(column: pa.Array | pa.ChunkedArray, n: int, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, dims)


def _file(rows: DataFrame) -> tuple[DataFrame, dict]:
    """The approximation file (dims, vec_id, cells) of ``rows``, and by vector length what cells mean.

    The driver holds two numbers a dimension of all vectors and a bounded sample of each length.
    """
    ends = rows.select("dims", F.posexplode("x").alias("k", "v")).groupBy("dims", "k").agg(F.min("v"), F.max("v"))
    by: dict[int, list] = {}
    for dims, k, low, high in ends.collect():
        by.setdefault(dims, []).append((k, low, high))
    fitted = {}
    for dims, found in by.items():
        some = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE)
        _, low, high = (whole(np.array(c)) for c in zip(*sorted(found), strict=True))
        fitted[dims] = fit_cells(whole(np.array([r[0] for r in some.select("x").collect()], np.float64)), low, high)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            cells = [b""] * len(dims)
            for d in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == d)
                x = whole(_flat(batch.column(2).take(pa.array(at)), len(at), d))
                for row, own in zip(at, cells_of(x, shared.value[int(d)][0]), strict=True):
                    cells[row] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.binary())], ["dims", "vec_id", "cells"]
            )

    return map_arrow(rows.select("dims", "vec_id", "x"), run, "dims int, vec_id long, cells binary"), shared


def _scan(file: DataFrame, asked: DataFrame, shared, k: int) -> DataFrame:
    """(query_id, vec_id, least, most): what may be among a query's k best, block by block and list by list.

    ``file`` has dims, b (its block), lists, vec_id, cells; ``asked`` has dims, b, s (its list), vec_id, x, floor.
    """
    left = file.select("dims", "b", F.explode(F.expr("sequence(0, lists - 1)")).alias("s"), "vec_id", "cells")
    met = left.unionByName(asked, allowMissingColumns=True).repartition(parts(file.sparkSession), "dims", "b", "s")

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("cells").is_null().to_numpy()
        dims = int(group.column("dims")[0].as_py())
        ids = group.column("vec_id").to_numpy()
        one, other = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        found = []
        if one.num_rows and other.num_rows:
            q = whole(_flat(other.column("x"), other.num_rows, dims))
            low = high = np.zeros((one.num_rows, 0))
            if dims:
                _, least, most = shared.value[dims]
                cells = np.frombuffer(b"".join(one.column("cells").to_pylist()), np.uint8).reshape(-1, dims)
                across = np.arange(dims)
                low, high = least[across, cells], most[across, cells]
            found = list(scan(ids[~asks], low, high, ids[asks], q, other.column("floor").to_numpy(), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "least", "most"), columns, kinds, strict=True)})

    return met.groupBy("dims", "b", "s").applyInArrow(run, "query_id long, vec_id long, least double, most double")


def _read(pairs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the exact vectors of ``pairs`` (query_id, vec_id)."""
    ask = asked.select(F.col("vec_id").alias("query_id"), "dims", F.col("x").alias("q"))
    met = pairs.join(ask, "query_id").join(rows, ["vec_id", "dims"]).select("query_id", "vec_id", "dims", "x", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            score = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, q = (whole(_flat(batch.column(c).take(pa.array(at)), len(at), d)) for c in (3, 4))
                score[at] = scores(x, q)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    return map_arrow(met, run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its k best other rows.

    Components are floor(256 x); a score is the integer inner product, ties go to the smaller vec_id; a
    score beyond a long is the nearest long.  Vectors that are null or hold a null or non-finite component,
    and rows without vec_id, take no part.  Vectors meet only vectors of their length; empty ones score 0.
    Rows repeated as a whole are one candidate; rows that share a vec_id are never candidates of each
    other, and a repeated query is asked with its smallest vector.  Too few candidates give fewer rows; an
    empty table gives none; other columns are left behind.

    Equal vectors score alike, so of each only its k + 1 smallest vec_ids can be among any answer;
    dropping the others is exact and keeps a much repeated vector small.
    """
    spark = vectors.sparkSession
    ok = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.where("vec_id is not null and embedding is not null").where(ok)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"), F.size("embedding").alias("dims"))
    asked = settle(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dims").agg(F.min("x").alias("x")))
    rank = F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))
    rows = settle(rows.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r").distinct())
    made, shared = _file(rows)
    # a block is small enough to share the work out, and large enough that queries are not sent too often
    n, lists = F.count("*"), F.count_if(F.col("vec_id") % every == 0)
    counts = rows.groupBy("dims").agg(
        F.greatest(F.ceil(n / most), F.least(F.ceil(n / block), F.lit(2 * parts(spark)))).cast("int").alias("blocks"),
        F.ceil(lists / ASKED).cast("int").alias("lists"),
    ).where("lists > 0").withColumn("head", F.ceil(F.sqrt("blocks")).cast("int"))
    counts = F.broadcast(settle(counts))  # a row a vector length
    n = F.xxhash64("vec_id", F.lit(1))
    file = settle(made.join(counts, "dims").withColumn("b", F.pmod(n, "blocks").cast("int")))

    def ask(blocks: str, queries: DataFrame) -> DataFrame:
        return queries.join(counts, "dims").select(
            "dims", F.explode(F.expr(blocks)).alias("b"), F.pmod(n, "lists").cast("int").alias("s"), "vec_id", "x", "floor"
        )

    lowest = asked.withColumn("floor", F.lit(float("-inf")))
    first = settle(_scan(file.where("b < head"), ask("sequence(0, head - 1)", lowest), shared, k))
    floor = _kth(first, "least", k)
    floored = asked.join(floor.select(F.col("query_id").alias("vec_id"), F.col("kth").alias("floor")), "vec_id", "left").fillna(float("-inf"), ["floor"])
    rest = ask("if(head < blocks, sequence(head, blocks - 1), array())", floored)
    found = first.unionByName(_scan(file.where("b >= head"), rest, shared, k))
    found = found.groupBy("query_id", "vec_id").agg(F.max("least").alias("least"), F.max("most").alias("most"))
    found = settle(found)
    found = found.join(_kth(found, "least", k), "query_id", "left").where("kth is null or most >= kth").drop("kth")
    best = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "vec_id")
    found = settle(found.withColumn("place", F.row_number().over(best)).select("query_id", "vec_id", "most", "place"))
    read = settle(_read(found.where(F.col("place") <= 2 * k), rows, asked))
    far = found.where(F.col("place") > 2 * k).join(_kth(read, "score", k), "query_id", "left")
    more = _read(far.where("kth is null or most >= kth"), rows, asked)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return read.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _kth(found: DataFrame, column: str, k: int) -> DataFrame:
    """(query_id, kth): the kth largest number of a query that has so many."""
    order = Window.partitionBy("query_id").orderBy(F.col(column).desc())
    ranked = found.withColumn("r", F.row_number().over(order)).withColumnRenamed(column, "kth")
    return ranked.where(F.col("r") == k).select("query_id", "kth") if k > 0 else ranked.where("false").select("query_id", "kth")
