"""Embedding near-dedup with a robust-pruned flat graph.

Vectors of a label make a region; larger ones are dealt to overlapping regions of their nearest centroids,
again and again until a region fits a task; what centroids cannot part is cut, and every two cuts are a region, so
that no pair in it is left out.  In a region, vectors are dealt to overlapping cluster
shards, and every shard grows a graph: a vector is searched for in the graph so far, and what the
search saw is pruned so that no kept neighbour is much nearer to another kept neighbour than to the
vector.  The shards' lists are united to one graph, in which each vector is looked for from the shards'
medoids by greedy search that goes on through everything in range.  What it finds is verified in double
precision and makes components; within these every pair is checked for the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, settle
from .components import components
from .simhash import roots, whole_groups

LEAST = 0.93
#: Vectors of a region at most, about; of a shard in it, on average; shards a vector of a region is in.
REGION, SHARD, SHARDS = 8192, 400, 3
#: Regions that a label or region is split into at most at once, regions a vector is then dealt to, and how often.
#: Of pairs at cosine 0.93 in 64 isotropic dimensions, 99.2 % share one of 5 among 1024 centroids, 78 % one of 2.
SPLIT, OVERLAP, LEVELS = 256, 5, 4
#: Vectors that a split's centroids are fitted on, about (a fraction by a hash), and vectors dealt by one task.
SAMPLE, DEALT = 4096, 1 << 16
#: Members of a component that are compared in one piece.
CUT = 2048
#: Neighbours kept of a vector in a shard (twice as many with links back) and of all its shards, length of the search
#: list, how much nearer a neighbour may be, nodes followed at once.
DEGREE, UNITED, BEAM, ALPHA, STEP = 16, 32, 16, 1.2, 4


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors by a few rounds of spherical k-means, always the same ones."""
    c = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


class Graph:
    """A flat graph over unit vectors: lists of neighbours, and medoids to start from."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float32)
        n = len(x)
        middle = self.x.mean(0) if n else np.zeros(x.shape[1], np.float32)
        self.medoids = (self.x @ middle).argmax(keepdims=True) if n else np.zeros(0, np.int64)
        self.near = np.full((n, 2 * DEGREE), -1, np.int64)
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([self.medoids, order[order != self.medoids[0]]]) if n else order
        done = 1
        while done < n:  # as many again each time: all of them searched in the graph so far
            batch = order[done : done + min(done, 512)]
            self._insert(batch)
            done += len(batch)

    @classmethod
    def united(cls, x: np.ndarray, size: int, overlap: int) -> Graph:
        """The graphs of overlapping cluster shards of ``size`` vectors on average, their lists united."""
        n = len(x)
        if n <= 2 * size:
            return cls(x)
        c = centroids(x[:: max(1, n // SAMPLE)], min(n, -(-n * overlap // size)))
        cells = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
        lists, medoids = np.full((n, 2 * DEGREE * cells.shape[1]), -1, np.int64), []
        for cell in range(len(c)):
            own, place = np.nonzero(cells == cell)
            if not len(own):
                continue
            shard = cls(x[own])
            medoids.append(own[shard.medoids[0]])
            near = np.where(shard.near >= 0, own[shard.near], -1)
            lists[own[:, None], place[:, None] * 2 * DEGREE + np.arange(2 * DEGREE)] = near
        lists = -np.sort(-lists, axis=1)
        lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
        lists = -np.sort(-lists, axis=1)
        out = cls.__new__(cls)
        out.x, out.medoids = x.astype(np.float32), np.unique(medoids)
        lists = lists[:, : int((lists >= 0).sum(1).max(initial=1))]
        out.near = np.full((n, UNITED), -1, np.int64)
        for i in range(0, n, 512):  # the nearest of all
            some = lists[i : i + 512]
            sims = np.einsum("nd,ncd->nc", out.x[i : i + 512], out.x[some])
            sims[some < 0] = -np.inf
            best = _top(sims, UNITED)
            out.near[i : i + 512, : best.shape[1]] = np.where(best >= 0, np.take_along_axis(some, np.maximum(best, 0), 1), -1)
        return out

    def _insert(self, batch: np.ndarray) -> None:
        seen = self.search(self.x[batch], np.inf)
        seen[np.arange(len(batch)), batch] = -np.inf
        self.near[batch, :DEGREE] = self._prune(batch, _top(seen, 3 * DEGREE))
        # links back, pruned where a list is full
        source = np.repeat(batch, DEGREE)
        target = self.near[batch, :DEGREE].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (self.near[nodes] >= 0).sum(1)
        lists = np.full((len(nodes), 2 * DEGREE + int(count.max(initial=0))), -1, np.int64)
        lists[:, : 2 * DEGREE] = self.near[nodes]
        place = np.arange(len(target)) - np.repeat(first, count) + np.repeat(held, count)
        lists[np.repeat(np.arange(len(nodes)), count), place] = source
        full = (lists >= 0).sum(1) > 2 * DEGREE
        self.near[nodes[~full]] = lists[~full][:, : 2 * DEGREE]
        if full.any():
            some = lists[full]
            sims = np.einsum("nd,ncd->nc", self.x[nodes[full]], self.x[some])
            sims[some < 0] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * DEGREE]
            some = np.take_along_axis(some, best, 1)
            self.near[nodes[full], DEGREE:] = -1
            self.near[nodes[full], :DEGREE] = self._prune(nodes[full], some)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most DEGREE of each node's candidates: the nearest, without those it hides."""
        rows = np.arange(len(nodes))
        c = self.x[candidates]
        to = 2 - 2 * np.einsum("nd,ncd->nc", self.x[nodes], c)
        between = 2 - 2 * (c @ c.transpose(0, 2, 1))
        to = np.where(candidates >= 0, to, np.inf)
        out = np.full((len(nodes), DEGREE), -1, np.int64)
        waiting = to.copy()
        for k in range(DEGREE):
            best = waiting.argmin(1)
            live = np.isfinite(waiting[rows, best])
            if not live.any():
                break
            out[live, k] = candidates[rows, best][live]
            hidden = ALPHA**2 * between[rows, best] <= to
            waiting[hidden] = np.inf
            waiting[rows, best] = np.inf
        return out

    def search(self, q: np.ndarray, least: float) -> np.ndarray:
        """For each query the cosine of every vector that a greedy search from the medoids saw.

        A query goes on while one of its BEAM best, or any within ``least``, is not followed yet.
        Vectors never seen have minus infinity.
        """
        n, q = len(self.x), q.astype(np.float32)
        sims = np.full((len(q), n), -np.inf, np.float32)
        followed, seen = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        sims[:, self.medoids] = q @ self.x[self.medoids].T
        seen[:, self.medoids] = True
        best = _top(sims[:, self.medoids], BEAM)
        beam = np.full((len(q), BEAM), -1, np.int64)
        beam[:, : best.shape[1]] = np.where(best >= 0, self.medoids[best], -1)
        live = np.arange(len(q))
        while len(live):
            ids = beam[live]
            open_ = (ids >= 0) & ~followed[live[:, None], ids]
            row, column = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= STEP))
            node = ids[row, column]
            if np.isfinite(least):
                followed[live[row], node] = True
                more, wide = np.nonzero((sims[live] >= least) & ~followed[live])
                row, node = np.concatenate([row, more]), np.concatenate([node, wide])
            if not len(row):
                break
            followed[live[row], node] = True
            next_ = self.near[node]
            fresh = np.zeros((len(live), n + 1), bool)
            fresh[row[:, None], next_] = True  # no neighbour: the last column
            who, what = np.nonzero(fresh[:, :n] & ~seen[live])
            seen[live[who], what] = True
            new = np.empty(len(who), np.float32)
            for i in range(0, len(who), 1 << 16):
                a, b = who[i : i + (1 << 16)], what[i : i + (1 << 16)]
                new[i : i + (1 << 16)] = np.einsum("nd,nd->n", q[live[a]], self.x[b])
            sims[live[who], what] = new
            self._widen(beam, sims, live, who, what, new)
            live = live[np.bincount(row, minlength=len(live)) > 0]
        return sims

    @staticmethod
    def _widen(beam, sims, live, who, what, new) -> None:
        """Puts the new vectors among the BEAM best of their queries; they come query by query."""
        count = np.bincount(who, minlength=len(live))
        width = int(count.max(initial=0))
        if not width:
            return
        ids = np.full((len(live), BEAM + width), -1, np.int64)
        value = np.full((len(live), BEAM + width), -np.inf, np.float32)
        ids[:, :BEAM] = beam[live]
        value[:, :BEAM] = np.where(ids[:, :BEAM] >= 0, sims[live[:, None], ids[:, :BEAM]], -np.inf)
        place = BEAM + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        ids[who, place], value[who, place] = what, new
        top = np.argpartition(-value, BEAM - 1, axis=1)[:, :BEAM]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(value, top, 1), axis=1, kind="stable"), 1)
        beam[live] = np.take_along_axis(ids, top, 1)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest finite numbers of each row, the largest first; else -1."""
    k = min(k, sims.shape[1])
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, best, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
    return np.where(np.isfinite(value), best, -1)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy()
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that the length of very large or small vectors is still a number
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label and a vector with finite components, not all of them zero."""
    fine = F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    return vectors.where("label is not null and embedding is not null and vec_id is not null").where(fine)


_KEY = ["label", "dims", "region"]


def _regions(nodes: DataFrame) -> DataFrame:
    """(label, dims, region, node, x): every node in the regions it is searched in, none much larger than REGION.

    Any two nodes of a region that is still too large after LEVELS splits meet in one of its pairs of cuts."""
    now = nodes.select("label", "dims", F.lit(0).cast("long").alias("region"), "node", "x")
    done = None
    for level in range(LEVELS + 1):
        large = settle(now.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > REGION))
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        small = now.join(large.select(*_KEY), _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        split = now.join(large, _KEY)
        if level < LEVELS:
            now = settle(_split(split, large))
    return done.unionByName(_pairs(split))


def _pairs(rows: DataFrame) -> DataFrame:
    """What centroids cannot part (regions of ``rows``, with n, their sizes): cut by a hash, and every two cuts are a region."""
    cut = rows.withColumn("cuts", F.ceil(2 * F.col("n") / REGION).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    met = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("own <> other")
    return met.select("label", "dims", F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "node", "x")


def _split(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The nodes of regions of ``rows`` (with n, their sizes) in the OVERLAP nearest of new regions."""

    def fit(group: pa.Table) -> pa.Table:
        n, dims = int(group.column("n")[0].as_py()), int(group.column("dims")[0].as_py())
        x = _unit(_matrix(group.column("x"), group.num_rows))
        c = centroids(x, int(np.clip(-(-n * OVERLAP // (REGION // 2)), 2, min(SPLIT, max(2, len(x))))))
        key = [group.column(k).slice(0, 1) for k in _KEY]
        return pa.table([*key, pa.array([c.astype(np.float32).reshape(-1, dims).tobytes()], pa.binary())], [*_KEY, "c"])

    some = F.pmod(F.xxhash64("node", "region"), F.lit(1 << 30)) * F.col("n") < F.lit(SAMPLE << 30)
    picked = rows.where(some).select(*_KEY, "n", "node", "x")
    fitted = picked.groupBy(*_KEY).applyInArrow(fit, "label int, dims int, region long, c binary")
    salts = F.ceil(F.col("n") / DEALT).cast("int")
    lead = fitted.join(large, _KEY).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    follow = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("n")
    both = follow.unionByName(lead, allowMissingColumns=True).select(*_KEY, "salt", "c", "node", "x")
    order = [*_KEY, "salt", F.col("c").isNull(), "node"]
    both = both.repartition(parts(rows.sparkSession), *_KEY, "salt").sortWithinPartitions(*order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("c").is_valid().to_numpy(zero_copy_only=False))
            edges = [0, *heads.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if b > a and part.column("c")[0].is_valid:
                    c = np.frombuffer(part.column("c")[0].as_py(), np.float32).reshape(-1, part.column("dims")[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                x = _unit(_matrix(pa.chunked_array([part.column("x")]), part.num_rows))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP]
                row = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                region = part.column("region").take(row).to_numpy() * (SPLIT + 1) + near.ravel() + 1
                columns = [part.column(k).take(row) for k in ("label", "dims", "node", "x")]
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(region), *columns[2:]], [*_KEY, "node", "x"])

    return map_arrow(both, deal, f"label int, dims int, region long, node long, x {rows.schema['x'].dataType.simpleString()}")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    for table in whole_groups(batches, keys, 1):
        columns = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield table.slice(a, b - a)


def linked(x: np.ndarray, least: float, size: int | None = None) -> np.ndarray:
    """For unit vectors of a region, the smallest member that links verified in double precision lead to."""
    n = len(x)
    graph = Graph.united(x, size or SHARD, SHARDS)
    label = np.arange(n)
    for i in range(0, n, 256):
        sims = graph.search(x[i : i + 256], least - 1e-3)
        a, b = np.nonzero(sims >= least - 1e-5)
        other = i + a != b
        a, b = a[other], b[other]
        for j in range(0, len(a), 1 << 16):
            u, v = i + a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            fine = np.einsum("nd,nd->n", x[u], x[v]) >= least
            label = roots(n, u[fine], v[fine], label)
    return label


def _search(members: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect in each region what is linked in it."""
    size = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            node = table.column("node").to_numpy()
            label = linked(_unit(_matrix(table.column("x"), len(node))), least, size)
            u = np.flatnonzero(label != np.arange(len(node)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[label[u]])], ["u", "v"])

    rows = members.select(*_KEY, "node", "x").repartition(parts(members.sparkSession), *_KEY)
    return map_arrow(rows.sortWithinPartitions(*_KEY, "node"), run, "u long, v long")


def _count(members: DataFrame, least: float) -> DataFrame:
    """(node, links): for the members (component, node, x, copies) of components, how many vec_ids of other members
    are linked with them, by every pair of a component.  Large components are cut and the cuts paired."""
    cuts = members.groupBy("component").agg(F.ceil(F.count("*") / CUT).cast("int").alias("cuts"))
    met = (
        members.join(cuts, "component")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "x")
    )
    keys = ["component", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            own, node, copies = (table.column(k).to_numpy() for k in (3, 4, 5))
            x = _unit(_matrix(table.column("x"), len(node)))
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            links = np.zeros(len(node), np.int64)
            for i in range(0, len(one), 512):
                some = one[i : i + 512]
                near = x[some] @ x[two].T >= least
                near &= node[some][:, None] != node[two][None, :]
                links[some] += near @ copies[two]
                if lo != hi:
                    links[two] += copies[some] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    met = met.repartition(parts(members.sparkSession), *keys).sortWithinPartitions(*keys, "node")
    return map_arrow(met, run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null, their vectors equally long, and their cosine in
    double precision is ``least`` or more.  Vectors that are null, zero or hold null or non-finite
    components have no links.  Rows with equal label and vector are one node, linked with one another.
    A row without vec_id links with nothing and has no component.  Rows that share a vec_id but not
    label and vector are nodes of their own, each with its own links.  An empty table gives no rows;
    other columns are left behind.
    """
    copies = (
        valid(vectors)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("x"))
        .groupBy("label", "x")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    )
    nodes = settle(copies.withColumns({"dims": F.size("x"), "node": F.monotonically_increasing_id()}))
    by = components(_search(_regions(nodes), least)).groupBy("node").agg(F.min("component").alias("component"))
    members = settle(nodes.join(by, "node"))
    links = _count(members.select("component", "node", "x", "copies"), least)
    least_id = members.groupBy("component").agg(F.min("first").alias("least"))
    found = members.select("node", "component").join(least_id, "component").join(links, "node").select("node", "links", "least")
    ids = nodes.join(settle(found), "node", "left").select(
        F.col("label").alias("_label"), F.col("x").alias("_x"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        F.coalesce("least", "first").alias("_component"),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    out = rows.join(ids, (rows["label"] == ids["_label"]) & (rows["embedding"] == ids["_x"]), "left")
    lone = F.col("vec_id").isNull()
    return out.select(
        "vec_id",
        F.when(lone, 0).otherwise(F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(lone, None).otherwise(F.coalesce("_component", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, found: DataFrame, asked: int = 200, least: float = LEAST) -> dict:
    """Recall of ``found`` for the first ``asked`` valid vectors by a hash of vec_id.

    Their links are counted against all rows of their label, the asked vectors broadcast as one
    bounded block, and set against n_links.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).select("vec_id", "label", "embedding")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(asked).collect()
    q = spark.sparkContext.broadcast([(r.vec_id, r.label, np.array(r.embedding, np.float64)) for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q.value), np.int64)
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
            for k, (name, own, y) in enumerate(q.value):
                rows = [i for i in np.flatnonzero(label == own) if len(x[i]) == len(y) and ids[i] != name]
                if rows:
                    total[k] += (_unit(np.array([x[i] for i in rows])) @ _unit(y[None])[0] >= least - 1e-12).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, *_ in q.value], pa.int64()), pa.array(total)], ["vec_id", "true_links"]
        )

    true = rows.mapInArrow(run, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("t"))
    got = true.join(found.select("vec_id", "n_links").dropDuplicates(["vec_id"]), "vec_id")
    t, g = got.agg(F.sum("t"), F.sum(F.least("t", "n_links"))).first()
    return {"asked": len(picked), "links": t or 0, "recall": 1.0 if not t else g / t}
