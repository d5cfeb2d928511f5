import hashlib
import random

import pytest
from trailmark.llm import alignment

PATHS = alignment.public_tokenizers_paths()
ODD = ["a  b", " a", "a ", "\n", "  ", "▁ a", "a\n b", "x <|endoftext|> y </s>", "é é ß", "日本語 テキスト", "a  b", "a ́b", "🎉🎉 🎉", "\x00 a", "a - b",
       "   lead", "don't 's 'S", "x \t y", "", None, "é e", "tail\r\n", "ﬁ ﬂ", "aaaa" * 50, "--- ---", "١٢٣ 45"]


@pytest.fixture(scope="module")
def made():
    return alignment.Pair(*PATHS)


def whole(made, text):
    """Numbers, digest and links of a text tokenised as a whole, by walking over the ends."""
    nothing = (0, 0, 0, 0, ""), {}
    if not text:
        return nothing
    s = " " + text
    a, b = made.a.encode(s, add_special_tokens=False).ids, made.b.encode(text)
    said = [made.bytes_a[i] for i in a], [made.bytes_b[i] for i in b]
    if any(b"".join(x) != s.encode() for x in said):
        return nothing
    ends = []
    for pieces in said:
        at, upto = 0, []
        for p in pieces:
            at += len(p)
            upto.append(at)
        ends.append(upto)
    groups = {}
    cuts = sorted(set(ends[0]) & set(ends[1]))
    for k, ids in enumerate((a, b)):
        for i, e in zip(ids, ends[k], strict=True):
            groups.setdefault(next(c for c in cuts if c >= e), ([], []))[k].append(i)
    links = {}
    for xs, ys in groups.values():
        for x in xs:
            for y in ys:
                links[x, y] = links.get((x, y), 0) + 1
    text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for _, (xs, ys) in sorted(groups.items()))
    return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest()), links


def plain(made, docs):
    each = [(doc, *whole(made, text)) for doc, text in docs]
    count, most = {}, {}
    for _, _, links in each:
        for p in links:
            count[p] = count.get(p, 0) + 1
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(((doc, *numbers[:4], sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), numbers[4])
                   for doc, numbers, links in each), key=repr)


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["the", "The", "naïve", "Straße", "3rd", "日本", "x" * 40, "don't", "a,b", "\n", "", "(", "qzx", "été", "word\nnext", "🎉"]
    return [" ".join(rnd.choices(words, k=rnd.choice([1, 5, 40]))) for _ in range(n)]


def test_against_whole_texts(spark, made):
    docs = [*enumerate(ODD), *enumerate(texts(1, 60), 100), (100, texts(1, 60)[0]), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, row int, pair string").repartition(4)
    got = alignment.aligned(df, *PATHS)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(made, docs)


def test_rare_links_by_shuffling(spark, made):
    """Hardly a link is held by every task: the rest is joined, to the same result."""
    docs = [*enumerate(texts(2, 80))]
    blocks = alignment.blocks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), *PATHS)
    for held in (1, 20, 10**9):
        got = alignment.with_counts(blocks, alignment.link_counts(blocks, 3), made.width, held)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(made, docs)


def test_cuts_change_nothing(made, monkeypatch):
    """Texts in many parts, pairs expanded a few at once, and a memory that is emptied again and again."""
    some = [" ".join(texts(3, 8)), *ODD, *texts(4, 20), "word " * 50 + "▁ bad " + "word " * 50]
    monkeypatch.setattr(alignment, "AT_ONCE", 50)
    monkeypatch.setattr(alignment, "EXPANDED", 2)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    own = alignment.Pair(*PATHS)
    block = alignment.Block(own)
    for text in some:
        block.add(text)
    import pyarrow as pa

    cols = dict(zip(["doc", "n_a", "n_b", "n_groups", "n_links", "sha", "indptr", "link", "times", "pair", "docs"], [c[0].as_py() for c in block.batch(pa.array(range(len(some)))).columns], strict=True))
    for i, text in enumerate(some):
        numbers, links = whole(made, text)
        assert (*(cols[c][i] for c in ("n_a", "n_b", "n_groups", "n_links")), cols["sha"][i]) == numbers
        at = slice(cols["indptr"][i], cols["indptr"][i + 1])
        assert {divmod(cols["pair"][k], made.width): n for k, n in zip(cols["link"][at], cols["times"][at], strict=True)} == links


def test_chunks(made):
    texts = ["a b  c", " x y ", "  ", "a - b\n c d", "a\n", "x a\n y"]
    assert made.chunks(texts) == [["a", "b  c"], [" x", "y "], ["  "], ["a", "-", "b\n c", "d"], ["a\n"], ["x", "a\n y"]]


def test_nothing(spark):
    schema = "doc_id long, text string"
    assert alignment.aligned(spark.createDataFrame([], schema), *PATHS).count() == 0
    got = alignment.aligned(spark.createDataFrame([(1, None), (2, "")], schema), *PATHS).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
