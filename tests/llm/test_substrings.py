import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import substrings


def brute(rows, span):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by counting every window."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, span=200):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, substrings.dedup_digest(docs, span).collect()), key=repr)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_with_shared_passages(spark, seed):
    rnd = random.Random(seed)
    passages = [words(rnd, n) for n in (20, 35, 60, 90, 200)]
    rows = []
    for d in range(150):
        text = [words(rnd, rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            text += [p[a : rnd.randrange(a, len(p)) + 1], words(rnd, rnd.randrange(30))]
        rows.append((d, "".join(text)))
    rows += [(200, "ab" * 400), (201, "x" * 199), (202, "x" * 200), (203, "y" * 201), (204, "line of text\n" * 60)]
    rows += [(205, rows[7][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (206, "")]
    got = run(spark, rows)
    assert got == brute(rows, 200)
    assert sum(r[2] for r in got) > 0


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows, 200)


def test_hot_passage_with_different_surroundings(spark):
    rnd = random.Random(5)
    p = words(rnd, 60)
    rows = [(d, words(rnd, 20)[: rnd.randrange(5, 60)] + p[rnd.randrange(40) :] + words(rnd, 12)) for d in range(120)]
    assert run(spark, rows) == brute(rows, 200)


def test_merge_gives_order_and_prefixes():
    rnd = random.Random(3)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 14))) for _ in range(500)]
    for k in (1, 2, 3, 7, 16):
        runs = [substrings.front_code([(x, x[::-1], 1, 2, i) for i, x in enumerate(sorted(keys[r::k]))]) for r in range(k)]
        got = list(substrings.merge_runs(runs))
        assert [e[0] for e in got] == sorted(keys)
        before = b""
        for key, lcp, left, *_ in got:
            assert lcp == substrings.common_prefix(before, key) and left == key[::-1]
            before = key


def test_small_and_large_groups_agree():
    rnd = random.Random(4)
    span = 60
    for _ in range(30):
        texts = sorted(bytes(rnd.choice(b"ab") for _ in range(1)) * rnd.randrange(25, 60) for _ in range(14))
        lefts = [bytes([rnd.choice(b"ab")]) * rnd.randrange(0, 28) for _ in texts]
        lcp = [0] + [substrings.common_prefix(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        left, right = substrings.reaches(lcp, lefts, span)
        for i in range(len(texts)):
            want = [(0, 0)]
            for j in range(len(texts)):
                c = substrings.common_prefix(lefts[i], lefts[j]), substrings.common_prefix(texts[i], texts[j])
                if j != i and sum(c) >= span and c[0] <= span - substrings.GRAM:
                    want.append(c)
            assert left[i] == max(w[0] for w in want)


def test_remove_keeps_columns(spark):
    long = "é" * 150
    rows = [(1, long + "a", "en", 151), (2, long + "b", "en", 151), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = substrings.remove_repeated(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a", "en", 1), (2, "b", "en", 1), (3, "", None, 0)]


def test_empty_table(spark):
    assert run(spark, []) == []
