import re

import numpy as np
import pytest
import xxhash

from trailmark.llm import simhash

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_groups(rows):
    prints = [plain_print(t) for _, t in rows]
    arr = np.array(prints, np.uint64)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        x = arr ^ arr[i]
        bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(1)
        for j in np.flatnonzero(bits <= 3):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    by = {}
    for i, (d, _) in enumerate(rows):
        by.setdefault(find(i), []).append(d)
    least = {k: min([d for d in v if d is not None], default=None) for k, v in by.items()}
    return sorted(
        ((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr
    )


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, simhash.near_groups(docs).collect()), key=repr)
    assert got == plain_groups(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "a b c d"), (5, "a b c d"),
            (None, "a b c d"), (None, "quite another text here"), (6, "İ É x y"), (7, "word " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, node int")
    got = sorted(map(tuple, simhash.near_groups(docs).collect()), key=repr)
    assert got == plain_groups(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 24])
def test_compare_links_all_within_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4))])
    group = np.sort(rng.integers(0, 12, len(fps)))
    side = np.where(group % 3 == 0, rng.integers(1, 3, len(fps)), 0)
    u, v = simhash.compare(fps, group, side, radius)
    got = simhash.roots(len(fps), u, v)
    i, j = np.triu_indices(len(fps), 1)
    bits = np.array([(int(a) ^ int(b)).bit_count() for a, b in zip(fps[i], fps[j], strict=True)])
    near = (group[i] == group[j]) & (bits <= radius) & ((side[i] == 0) | (side[i] != side[j]))
    assert (got == simhash.roots(len(fps), i[near], j[near])).all()


def test_hot_bucket_is_cut(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**62, 300)] + [1 << b for b in range(60)]
    rows = spark.createDataFrame([(7, f, f) for f in fps], "bucket long, node long, fp long")
    made = simhash.links(rows, 2, piece=50).collect()
    ids = {f: i for i, f in enumerate(fps)}
    got = simhash.roots(len(fps), np.array([ids[r.u] for r in made]), np.array([ids[r.v] for r in made]))
    assert set(got[300:].tolist()) == {300} and (got[:300] == np.arange(300)).all()


def jaccard(a, b):
    def shingles(t):
        w = WORD.findall(t.translate(LOWER))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def found(docs, **options):
    return {r.doc_id: r.component_id for r in simhash.near_copies(docs, **options).collect()}


def plain_copies(texts, least=0.8):
    """Components of all pairs by the whole sets of shingles."""
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(i)
    u, v = [], []
    for i, s in enumerate(sets):
        common = {}
        for h in s:
            for j in holders[h]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        near = [j for j, c in common.items() if c >= least * (len(s) + len(sets[j]) - c)]
        u += [i] * len(near)
        v += near
    empty = [i for i, s in enumerate(sets) if not s]
    u, v = u + empty[1:], v + empty[:-1]
    return simhash.roots(len(texts), np.array(u, int), np.array(v, int))


def test_driver_documents_lose_no_link(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    ids = [d for d, _ in rows]
    want = {d: ids[k] for d, k in zip(ids, plain_copies([t for _, t in rows]), strict=True)}
    assert found(docs) == want and len(set(want.values())) < len(ids)


@pytest.mark.parametrize("piece", [1 << 12, 16])
def test_large_family_of_short_and_long(spark, monkeypatch, piece):
    """Families, passages that many share, small sets, and stragglers, in cuts of few rows."""
    monkeypatch.setattr(simhash, "CLUSTER", 4000)
    monkeypatch.setattr(simhash, "OFTEN", 1)
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 50000, n)]
    base, passage = word(150), word(80)
    texts = [" ".join(edited(rng, base, int(rng.integers(0, 5)))) for _ in range(120)]
    texts += [" ".join(word(40) + passage) for _ in range(80)]
    texts += [" ".join(word(3) + passage) for _ in range(40)]
    short = word(12)
    texts += [" ".join(short + word(k)) for k in (0, 1, 2, 3, 4, 5, 9)] + [" ".join(short[:k]) for k in range(0, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_copies(texts)
    got = found(docs, piece=piece)
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_one_id_with_two_texts(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(50))), (1, " ".join(f"b{i}" for i in range(50))), (2, " ".join(f"b{i}" for i in range(51)))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])


def test_near_copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for d in range(60):
        words = [vocab[i] for i in rng.integers(0, 3000, 200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 4, 30):
            changed = list(words)
            for k in rng.integers(0, 200, edits):
                changed[k] = "edited"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = list(range(len(rows)))
    for d in range(0, len(rows), 5):
        for i in range(d, d + 5):
            for j in range(d, i):
                if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    got = found(docs)
    assert [got[i] for i in range(len(rows))] == label


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (9, "other words entirely here now"),
            (None, text), (4, None), (8, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(3, text + " more", "en"), (9, rows[3][1], "en"), (None, text, "en"), (4, None, "en")], key=repr)


def test_no_table_as_long_as_the_corpus_is_broadcast(spark, monkeypatch):
    sent, bounded = [], simhash.bounded

    def spied(small, *most):
        sent.append(small.count())
        return bounded(small, *most)

    monkeypatch.setattr(simhash, "bounded", spied)
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(30))) for d in range(200)]
    rows += [(1000 + d, rows[d][1] + " more") for d in range(5)] + [(None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(simhash.keep_one(docs).collect(), key=repr) == sorted(rows[:200] + rows[-1:], key=repr)
    assert max(sent) <= 10


def test_near_copies_are_merged_not_broadcast(spark, monkeypatch):
    plans, settle = [], simhash.settle

    def spied(df, **options):
        df.collect()  # so that the plan is the one that was run
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, **options)

    monkeypatch.setattr(simhash, "settle", spied)
    rows = [(d, " ".join(f"w{d % 3}x{i}" for i in range(30 + d))) for d in range(9)]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {d: d % 3 for d in range(9)}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p and "doc_id" not in p.split("BroadcastHashJoin")[1][:40]]


@pytest.mark.parametrize("sent", [0, 100])
@pytest.mark.parametrize("copies", [1, 3])
def test_keep_one_by_either_list(spark, monkeypatch, sent, copies):
    monkeypatch.setattr(simhash, "SENT", sent)
    rows = [(d, f"a{d % 4} b c d e f g h{d % 4}") for d in range(4 * copies + 1)] + [(None, "x"), (0, "a0 b c d e f g h0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == sorted(rows[:4] + [(None, "x")], key=repr)


@pytest.mark.parametrize("most", [0, 5, 40, 1000])
def test_frequent_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "FREQUENT", most)
    rng = np.random.default_rng(5)
    known = rng.integers(0, 2**32, 60)
    sets = [np.sort(known[: rng.integers(1, 61)]).astype(np.uint32) for _ in range(80)]
    counts = {int(h): sum(int(h) in s for s in sets) for h in known}
    counts = {h: n for h, n in counts.items() if n >= simhash.OFTEN}
    df = spark.createDataFrame([(s.tobytes(),) for s in sets], "own binary").coalesce(1)
    h, n = simhash.frequent(df)
    given = dict(zip(h.tolist(), n.tolist(), strict=True))
    assert h.tolist() == sorted(given) and len(given) <= most and given.items() <= counts.items()
    rest = [n for x, n in counts.items() if x not in given]
    assert not given or not rest or min(given.values()) >= max(rest)
    assert len(given) >= min(most, len(counts)) - 5  # what is left out are slices of ties


def edited(rng, words, edits):
    changed = list(words)
    for n, k in enumerate(rng.choice(len(words), edits, replace=False)):
        changed[k] = f"edit{rng.integers(10**9)}x{n}"
    return changed


def near(rng, words, least, above):
    """A text whose similarity to ``words`` is just above or just below ``least``."""
    made, before = list(words), list(words)
    while jaccard(" ".join(words), " ".join(made)) >= least:
        before, made = made, edited(rng, made, 1)
    return before if above else made


def test_long_texts_just_above_and_below(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(24):
        words = [f"w{i}" for i in rng.integers(0, 50000, (1000, 1500, 3000)[d % 3])]
        other = near(rng, words, 0.8, above=d % 2 == 0)
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(other))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    true = [jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, 48, 2)]
    assert all(abs(x - 0.8) < 0.01 for x in true)
    assert [got[2 * d + 1] == 2 * d for d in range(24)] == [x >= 0.8 for x in true]


def test_cut_clusters(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLUSTER", 2500)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 50000, 400)]
    texts = [words]
    for _ in range(30):  # a chain: the ends are far apart
        texts.append(edited(rng, texts[-1], 4))
    texts.append(near(rng, texts[0], 0.7, above=True))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = found(docs)
    assert all(got[i] == 0 for i in range(31)) and got[31] == 31


def test_sets_in_reach_share_a_bucket():
    rng = np.random.default_rng(4)
    for n in (*range(1, 40), 100, 333, 1000):
        for _ in range(20):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            lost = int(rng.integers(0, n // 5 + 1))  # of a; and as many new ones as similarity 0.8 lets in
            new = int((n - lost) / 0.8 + 1e-9) - n
            b = np.concatenate([a[lost:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            count = {int(h): int(c) for h, c in zip(a, rng.integers(0, 4, n), strict=True)}
            x, y = (
                s[simhash.prefix(s, np.array([count.get(int(h), 0) for h in s]), 0.8)] for s in (np.sort(a), np.sort(b))
            )
            assert len(np.intersect1d(x, y)), (n, lost)


def test_passages_repeated_unequally(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(20):
        words = [f"w{i}" for i in rng.integers(0, 50000, 600)]
        again = [f"p{i}" for i in rng.integers(0, 50000, 20)]
        rows += [(3 * d, " ".join(words + again)), (3 * d + 1, " ".join(words + again * 60)),
                 (3 * d + 2, " ".join(words + again * 2))]  # the last two have the same set
    assert all(jaccard(rows[i][1], rows[i + 1][1]) > 0.9 for i in range(0, 60, 3))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[i] == i - i % 3 for i in range(60))
