import hashlib
import math
import random
import re

import pytest

from trailmark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """(doc_id, size, source_size, target, copies) by sharing again until no source is above."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        open_ = [s for s in order if s not in full]
        share = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        above = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not above:
            break
        full |= above
    target = {s: float(3 * sizes[s]) if s in full else share * weight[s] for s in order}
    out = []
    for d, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        key = str(d) if d is not None else (t or "")
        draw = int(hashlib.md5(f"mix-42|{key}".encode()).hexdigest()[:12], 16) / 2**48
        out.append((d, len(WORD.findall(t or "")), sizes[s], target[s], math.floor(rate) + (draw < rate % 1)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "Z", "é", "\U0001f600", "￿", "src1", "src10", "", None][: 4 + 3 * seed]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 60])), rnd.choice(names + names[:1] * 9)) for i in range(200)]
    rows += [(None, "x y", "a"), (3, rows[3][1], rows[3][2]), (900, None, "only empty"), (901, "a\tb\x0bc d", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_size int")
    got = mixing.plan(docs).select("doc_id", "mix_size", "mix_source_size", "mix_target", "mix_copies")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_emit_repeats_documents(spark):
    rows = [(i, "one two three", f"s{i % 4}" if i % 3 else "s0") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r[0]: r[4] for r in plain(rows)}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in want.items() if n}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], docs.schema)
    assert sorted(map(tuple, mixing.plan(docs).select("mix_size", "mix_target", "mix_copies").collect())) == [(0, 0.0, 0)] * 2


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, "y"), (2, None, None, 2, "z")], "doc_id long, text string, source string, mix_rate int, mix_source string")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source"] and {r.doc_id for r in out.collect()} <= {1, 2}
