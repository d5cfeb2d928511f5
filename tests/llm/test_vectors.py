import math

import numpy as np
import pytest

from trailmark.llm import vectors


def brute(rows, least=0.93):
    n = len(rows)
    ok = [
        v is not None and l is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
        and any(x)
        for v, x, l in rows
    ]
    unit = [np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)) if o else None for (_, x, _), o in zip(rows, ok)]
    links, label = [0] * n, list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= least:
                    links[i] += 1
                    links[j] += 1
                    label[max(find(i), find(j))] = min(find(i), find(j))
    by = {}
    for i, (v, _, _) in enumerate(rows):
        by.setdefault(find(i), []).append(v)
    return sorted(
        ((v, links[i], min(by[find(i)]) if v is not None else None, v is not None and v == min(by[find(i)]))
         for i, (v, _, _) in enumerate(rows)), key=repr,
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int, copies int")


def test_driver_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    found = vectors.near_vectors(df)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
    assert vectors.audit(df, found)["recall"] == 1.0


def clusters(seed, groups, size, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=dims)
        for _ in range(size):
            rows.append((len(rows), (c + rng.normal(size=dims) * rng.choice([0.02, 0.2, 0.3])).astype(np.float32).tolist(), g % 3))
    return rows


@pytest.mark.parametrize("cut", [1024, 40])
def test_clusters_also_in_small_regions(spark, monkeypatch, cut):
    monkeypatch.setattr(vectors, "CUT", cut)
    monkeypatch.setattr(vectors, "REGION", 2 * cut)
    monkeypatch.setattr(vectors, "SHARD", 30)
    rows = clusters(1, 6, 50)
    got = {r[0]: r for r in map(tuple, vectors.near_vectors(frame(spark, rows)).collect())}
    want = brute(rows)
    true = sum(w[1] for w in want)
    assert sum(r[1] for r in got.values()) >= 0.97 * true
    assert all(got[w[0]][1] <= w[1] for w in want)
    assert sum(got[w[0]][2] == w[2] for w in want) >= 0.97 * len(want)


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(7, v, 1), (3, v, 1), (5, v, 2), (8, v, None), (9, None, 1), (10, [0.0] * 3, 1), (11, [1.0, None, 2.0], 1),
            (12, [float("nan"), 1.0, 1.0], 1), (13, [float("inf"), 1.0, 1.0], 1), (14, [2.0, 4.0, 6.0], 1),
            (15, [-1.0, -2.0, -3.0], 1), (None, v, 1), (16, [1.0, 2.0], 1), (17, [], 1), (18, [1e30, 2e30, 3e30], 1),
            (19, v, 1), (19, v, 1)]
    got = sorted(map(tuple, vectors.near_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert vectors.near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1000, 60])
def test_search_from_the_medoids_finds_the_range(size):
    rows = clusters(2, 4, 150)
    x = vectors._unit(np.array([r[1] for r in rows], np.float64))
    sims = vectors.Graph.united(x, size, 3).search(x, 0.9)
    true = x @ x.T >= 0.93
    assert (true & (sims >= 0.9299)).sum() >= 0.98 * true.sum()


def test_one_id_with_two_vectors(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: (v + rng.normal(size=16) * 0.01).tolist()
    rows = [(7, a.tolist(), 1), (7, b.tolist(), 1), (8, near(a), 1), (9, near(b), 1), (10, near(b), 2)]
    rows = [(v, np.array(x, np.float32).tolist(), label) for v, x, label in rows]
    got = sorted(map(tuple, vectors.near_vectors(frame(spark, rows)).collect()))
    assert got == [(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False), (10, 0, 10, True)]


def test_recall_of_a_large_table(spark, monkeypatch):
    """20,000 vectors with links, split in many regions: links and components against brute force."""
    monkeypatch.setattr(vectors, "REGION", 1000)
    rng = np.random.default_rng(10)
    parts = []
    for _ in range(2500):
        c = rng.normal(size=64)
        parts.append(c / np.linalg.norm(c) + rng.normal(size=(8, 64)) * rng.uniform(0.015, 0.045))
    x = np.concatenate(parts).astype(np.float32)
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()))
    unit = vectors._unit(x.astype(np.float64))
    true = np.zeros(len(x), np.int64)
    u, v = [], []
    for i in range(0, len(x), 2000):
        a, b = np.nonzero(unit[i : i + 2000] @ unit.T >= 0.93)
        a = a[a + i != b] + i, b[a + i != b]
        u.append(a[0])
        v.append(a[1])
    u, v = np.concatenate(u), np.concatenate(v)
    true = np.bincount(u, minlength=len(x))
    root = vectors.roots(len(x), u, v)
    links = np.array([g[1] for g in got])
    assert (links <= true).all() and true.sum() > 40_000
    recall, same = links.sum() / true.sum(), np.mean([g[2] for g in got] == root)
    print(f"recall {recall:.4f} of {true.sum()} links, components {same:.4f}")
    assert recall >= 0.97 and same >= 0.97


def test_planted_pairs_among_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "REGION", 100)  # hundreds of regions, as for a large table
    monkeypatch.setattr(vectors, "SHARD", 20)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(1500):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = rng.uniform(0.931, 0.96)
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(len(rows), a.astype(np.float32).tolist(), 1), (len(rows) + 1, b.astype(np.float32).tolist(), 1)]
    got = {r[0]: r for r in map(tuple, vectors.near_vectors(frame(spark, rows)).collect())}
    assert sum(got[i + 1][2] == i for i in range(0, 3000, 2)) >= 0.97 * 1500


def test_what_centroids_cannot_part_loses_no_pair(spark, monkeypatch):
    """A region that is still too large after all splits: every two of its cuts meet."""
    monkeypatch.setattr(vectors, "REGION", 60)
    monkeypatch.setattr(vectors, "LEVELS", 0)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(150):  # pairs that have nothing in common with others
        c = rng.normal(size=48)
        for _ in range(2):
            rows.append((len(rows), (c + rng.normal(size=48) * 0.1).astype(np.float32).tolist(), 0))
    got = sorted(map(tuple, vectors.near_vectors(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert sum(n for _, n, _, _ in got) >= 290
