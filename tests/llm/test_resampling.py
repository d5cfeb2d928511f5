import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from trailmark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def buckets_of(found, buckets):
    out = {}
    for f in found:
        b = zlib.crc32(f.encode()) % buckets
        out[b] = out.get(b, 0) + 1
    return out


def plain(docs, target, buckets=10_000, run=1):
    s, t = {}, {}
    for into, some in ((s, [x for _, x in docs]), (t, target)):
        for text in some:
            for b, n in buckets_of(features(text, run)[1], buckets).items():
                into[b] = into.get(b, 0) + n
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (S + buckets) / ((n + 1) * (T + buckets)))) for b, n in s.items()}
    rows = []
    for doc, text in docs:
        words, found = features(text, run)
        weight = sum(gain[b] * n for b, n in buckets_of(found, buckets).items())
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 10 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "a-b", "naïve", "x" * 70, "3rd", "日本", "ÉCOLE", "_", "q" * 64] + [f"w{i}" for i in range(50)]
    return [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize("run", [1, 3])
def test_against_plain(spark, run):
    docs = [(i, t) for i, t in enumerate(texts(run, 300))] + [(900, None), (901, ""), (None, "one two " * 20), (None, "one two " * 20), (7, "the " * 40), (7, "the " * 40), (902, "the " * 30)]
    target = [*texts(9, 20), None, ""]
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], "doc_id long, text string, weight string, rank int, _part int").repartition(5)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), run=run)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, run=run)


def test_windows_change_nothing():
    """Texts longer than a window, words longer than one, runs over the cuts."""
    some = [*texts(3, 40), "", "y" * 5_000, " ".join(texts(4, 60)), "", "é" * 700 + " z"]
    raw = "".join(some).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in some)])
    data = np.frombuffer(raw, np.uint8)
    for run in (1, 2, 4):
        want = resampling.counted(data, offsets, 1000, run, 1 << 30)
        for window in (1, 7, 100, 3_000):
            got = resampling.counted(data, offsets, 1000, run, window)
            assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True)), (run, window)
        words, indptr, indices, counts = want
        for i, text in enumerate(some):
            held = dict(zip(indices[indptr[i] : indptr[i + 1]].tolist(), counts[indptr[i] : indptr[i + 1]].tolist(), strict=True))
            assert held == buckets_of(features(text, run)[1], 1000) and words[i] == len(features(text)[0])


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resampled(empty, target).count() == 0
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(30)], "doc_id long, text string")
    got = resampling.resampled(docs, target.limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and {r.weight for r in got} == {got[0].weight}


def test_draw_prefers_the_target(spark):
    """Documents made of the target's words are drawn far more often than others."""
    docs = [(i, ("good words here " if i % 2 else "other stuff there ") * 8) for i in range(200)]
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("good words here",)], "text string"))
    assert all(r.doc_id % 2 for r in got.where("rank is not null").collect())
