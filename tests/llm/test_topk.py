import math
import random

import numpy as np

from trailmark.llm import topk


def brute(rows, every=50, k=5):
    ok = [
        (v, [math.floor(256 * float(np.float32(c))) for c in x])
        for v, x in rows
        if v is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    ok = sorted({(v, tuple(x)) for v, x in ok})
    out, asked = [], set()
    for v, x in ok:
        if v % every or (v, len(x)) in asked:
            continue
        asked.add((v, len(x)))
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), w) for w, y in ok if w != v and len(x) == len(y))
        out += [(v, r + 1, w, -s) for r, (s, w) in enumerate(best[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    return sorted(map(tuple, topk.top_k(df, **options).collect()))


def test_driver_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)
    assert sorted(map(tuple, topk.top_k(df, every=10, block=60).collect())) == brute(rows, 10)


def test_edge_rows(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # one vector many times
    rows += [(50, rows[3][1]), (60, rows[60][1]), (150, None), (300, [1.0, None, 0.0, 0.0])]
    rows += [(301, [float("nan")] * 4), (302, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, []), (401, []), (450, [9.0]), (100, [0.0] * 4)]
    got = run(spark, rows)
    want = brute([r for r in rows if r != (50, rows[3][1]) and r != (100, [0.0] * 4)])
    by = {q for q, *_ in want} - {50, 100}
    # ids 50 and 100 have two vectors each: as candidates both count
    assert {q for q, *_ in got} == {0, 50, 100, 200, 350, 400}
    for q in (0, 200, 350, 400):
        assert [r for r in got if r[0] == q] == [r for r in brute(rows) if r[0] == q], by


def test_large_components(spark):
    """Products beyond what a double or 2^53 holds exactly, and beyond a long."""
    got = run(spark, [(0, [1e6, 0.0]), (1, [1e6, 0.0]), (2, [9e5, 0.0]), (3, [6e5, 0.0])])
    assert got == [(0, 1, 1, 65536000000000000), (0, 2, 2, 58982400000000000), (0, 3, 3, 39321600000000000)]
    rnd = random.Random(2)
    for size in (1e5, 1e6, 3e6):
        rows = [(i, [rnd.uniform(-size, size) for _ in range(3)]) for i in range(300)]
        rows += [(300 + i, [v + rnd.choice([0.0, 0.25, 1.0]) for v in rows[i][1]]) for i in range(60)]
        assert run(spark, rows, block=40) == brute(rows)
    huge = run(spark, [(0, [1e30, 1.0]), (2, [1e30, 0.0]), (1, [1e38, 0.0]), (3, [-1e38, 0.0])])
    assert huge == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 3, -(2**63))]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for size in (1, 1e4, 1e12):
        x, q = topk.whole(rng.normal(0, size, (500, 9))), topk.whole(rng.normal(0, size, (20, 9)))
        edges, least, most = topk.fit_cells(x[:200], x.min(0), x.max(0))
        cells = topk.cells_of(x, edges)
        low, high = least[np.arange(9), cells], most[np.arange(9), cells]
        assert (low <= x).all() and (x <= high).all()
        a, b = topk.bounds(q, low, high)
        for i in range(20):
            s = topk.scores(x, np.broadcast_to(q[i], x.shape))
            assert all(float(lo) <= int(v) <= float(hi) for lo, v, hi in zip(a[i], s, b[i], strict=True))


def test_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (1500, 6)).tolist())]
    assert run(spark, rows, block=60, every=20) == brute(rows, 20)


def test_empty_table(spark):
    assert run(spark, []) == []
