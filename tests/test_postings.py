import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmark import plans
from trailmark.functions.query import Operand
from trailmark.operators import postings, search
from trailmark.tables import delete, kept, write, written

WORDS = "the then brown quick fox a-b don't été 12 und".split()
QUERIES = [
    "brown", "the", "qui", '"quick brown" the', "brown -fox", '"the quick" OR fox und -12', "brown quick fox", '-"quick brown" the', "té OR ét", '"don\'t" a',
    'fox OR "fox fox"', "foo_bar -the_fox quick",
]


def texts(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 4, 12, 30]))) for _ in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    some = [*texts(1, 80), None, "", "Quick  BROWN,fox;The"]
    docs = [(("session", "message", "pullRequest")[i % 3], i % 20, i, t) for i, t in enumerate(some)]
    df = spark.createDataFrame(docs, "source_kind string, id long, source_row long, text string")
    made = postings.build(df).cache()
    yield df, made
    made.unpersist()


def plain_covers(text, query):
    """Every stretch that holds a branch and holds no shorter one, by trying all."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    plan = postings.compile(query)
    fits = lambda w, slot: w.startswith(slot[0]) if slot[1] else w == slot[0]
    at = [[(p, p + len(o) - 1) for p in range(len(words)) if p + len(o) <= len(words) and all(fits(words[p + i], plan.slots[s]) for i, s in enumerate(o))] for o in plan.operands]
    open_ = [have for have, lack in plan.branches if all(at[k] for k in have) and not any(all(at[k] for k in g) for g in lack)]
    good = lambda a, b: any(all(any(a <= x and y <= b for x, y in at[k]) for k in have) for have in open_)
    asked = {p for p, w in enumerate(words) for k in plan.wanted for s in plan.operands[k] if fits(w, plan.slots[s])}
    found = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if good(a, b) and not good(a + 1, b) and not good(a, b - 1)]
    return [(a, b, b - a + 1 - len(asked & set(range(a, b + 1)))) for a, b in found], bool(open_)


@pytest.mark.parametrize("query", QUERIES)
def test_against_all_stretches(index, query):
    df, made = index
    want = {(r.source_kind, r.id, r.source_row): plain_covers(r.text, query) for r in df.collect()}
    got = {}
    for r in postings.covers(made, query).collect():
        got.setdefault((r.source_kind, r.id, r.source_row), []).append((r.first, r.last, r.gaps))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (v, _) in want.items() if v}
    assert {tuple(r) for r in postings.match(made, query).collect()} == {k for k, (_, hit) in want.items() if hit}
    words = search.tokens(F.col("text"))
    assert df.where(search.matches(words, query)).count() == sum(hit for _, hit in want.values())
    for r in postings.ranked(made, query).collect():
        total = sum(0.1 / (1 + g) for _, _, g in want[r.source_kind, r.id, r.source_row][0])
        assert r.score == pytest.approx(total / (1 + total) * search.WEIGHTS[r.source_kind])


def test_what_is_indexed(spark, index):
    df, made = index
    back = made.select(*postings.KEY, F.explode("positions").alias("pos"), "token").groupBy(*postings.KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w"))
    got = {r.source_row: [x.token for x in r.w] for r in back.collect()}
    assert got == {r.source_row: w for r in df.collect() if (w := re.findall(r"[^\W_]+", (r.text or "").lower()))}
    long = spark.createDataFrame([("session", 1, 0, "a " * 16_384 + "late")], df.schema)
    assert postings.match(postings.build(long), "late").count() == 0 and postings.match(postings.build(long), "a").count() == 1


def test_lists_lie_side_by_side(spark, tmp_path):
    """A token is in few files, and a plan asks the files for it."""
    docs = [("session", i, 0, f"common w{i % 50} x{i}") for i in range(400)]
    at = str(tmp_path / "index")
    write(postings.build(spark.createDataFrame(docs, "source_kind string, id long, source_row long, text string")), at, ["source_kind"])
    made = postings.stored(spark, at)
    files = made.where("token like 'w%'").select(F.input_file_name()).distinct().count()
    assert files < made.select(F.input_file_name()).distinct().count() and made.where("token = 'common'").select(F.input_file_name()).distinct().count() >= 1
    found = postings.match(made, "w7")
    assert "StringStartsWith(token,w7)" in found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert found.count() == 8


def shown(spark, text, query):
    docs = spark.createDataFrame([("session", 1, 0, text)], "source_kind string, id long, source_row long, text string")
    spans = postings.fragments(postings.build(docs), docs, query)
    return [tuple(s) for s in docs.join(spans, postings.KEY).select(postings.snippet(F.col("text"), F.col("spans"), query).alias("s")).first().s]


def test_snippets(spark):
    assert shown(spark, "One fox, two!", "fox") == [("One ", False), ("fox", True), (", two!", False)]
    far = " ".join(f"w{i}" for i in range(100))
    said = shown(spark, f"fox {far} the fox {far}", '"the fox"')
    words = "".join(t for t, _ in said).split()
    assert len(words) == postings.WORDS and [t for t, on in said if on] == ["the", "fox"]  # a phrase in the middle
    both = shown(spark, f"fox {far} fox {far} fox", "fox")
    assert [t for t, on in both if on] == ["fox", "fox"] and len("".join(t for t, _ in both).split()) == 2 * postings.WORDS
    assert shown(spark, "fox " * 60, "fox") == [("fox " * 53, False)]  # too many segments: plain
    near = shown(spark, f"brown {far} brown fox {far}", "brown fox")
    assert [t for t, on in near if on][:2] == ["brown", "fox"] or ("fox", True) in near


def test_operands_of_several_words():
    plan = postings.compile([[Operand("a_b"), Operand("c_d", excluded=True), Operand("e", prefix=True)]])
    assert plan.branches == (((0, 1, 4), ((2, 3),)),) and plan.slots[plan.operands[4][0]] == ("e", True)


def test_kept_until_its_source_changes(spark, tmp_path):
    source, made = str(tmp_path / "t"), []

    def make(to):
        made.append(to)
        write(spark.read.parquet(source), to)

    spark.range(3).write.parquet(source)
    first = kept(spark, "copy", [source], make)
    assert kept(spark, "copy", [source], make) == first and len(made) == 1 and spark.read.parquet(first).count() == 3
    spark.range(4).write.mode("append").parquet(source)
    second = kept(spark, "copy", [source], make)
    assert second != first and spark.read.parquet(second).count() == 7
    for at in (first, second):
        delete(spark, at)


def test_texts_are_listed_once_and_repeats_brought_together(spark):
    """No position of a text is shuffled by itself: what is dealt to ranges is a row a document and word."""
    rows = [("session", 1, 0, "b a b"), ("session", 1, 0, "b c"), ("message", None, 0, "a"), ("message", None, 0, "a a"), ("session", 2, 0, None), ("session", 3, 0, "ß A a")]
    docs = spark.createDataFrame(rows, "source_kind string, id long, source_row long, text string")
    index = postings.build(docs)
    got = {(r.source_kind, r.id, r.token): r.positions for r in index.collect()}
    assert got == {
        ("session", 1, "a"): [1], ("session", 1, "b"): [0, 0, 2], ("session", 1, "c"): [1], ("message", None, "a"): [0, 0, 1],
        ("session", 3, "ß"): [0], ("session", 3, "a"): [1, 2],
    }
    plan = postings.build(docs.where("id = 3"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Scan parquet" in plan


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Tables with words behind 32,768 characters, and in a run of over 2,040 of them."""
    at = tmp_path_factory.mktemp("long")
    far, run = "a " * 20_000, "x," * 1_100
    texts = [far + "und", far + "und die", run + "und", run + "und die", far + "that the", far + "that the und", "that " + run[:-1] + " the", run + "that the", None]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (i BIGINT, x VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    for name, columns in {"documents": "i AS doc_id, x AS text", "conversations": "i % 5 AS conv_id, i AS turn, 'user' AS role, x AS text", "pages": "i AS page_id, x AS html"}.items():
        db.execute(f"CREATE VIEW {name} AS SELECT {columns} FROM t")
        db.execute(f"COPY {name} TO '{at}/{name}.parquet'")
    return str(at), db


def both(spark, long_texts, name):
    at, db = long_texts
    made = plans.QUERIES[name](spark, at)
    return sorted(map(tuple, made.collect())), sorted(db.execute(f"SELECT {', '.join(made.columns)} FROM ({plans.SQL[name]})").fetchall())


def test_match_reads_whole_texts(spark, long_texts):
    got, want = both(spark, long_texts, "search_match")
    assert got == want == [(0,), (2,), (5,)]


def test_phrase_reads_whole_texts(spark, long_texts):
    """Words on both sides of a long run are not neighbours."""
    got, want = both(spark, long_texts, "search_phrase")
    assert got == want == [(4,), (7,)]


def test_best_source_reads_whole_texts(spark, long_texts):
    """Hits of every kind of row behind the cap and in long runs are found and counted."""
    got, want = both(spark, long_texts, "search_best_source")
    assert got == want
    assert [(r[0], r[1], r[-1]) for r in got] == [("message", 0, 1), ("message", 1, 1), ("message", 2, 1), ("session", 4, 3), ("session", 5, 2), ("session", 6, 2), ("session", 7, 2)]


def test_whole_texts_in_parts(spark, index, tmp_path):
    """Parts by document make the same index, repeated documents included, and leave none of their lists."""
    df, _ = index
    docs = df.unionByName(df.limit(7))
    want = sorted(map(tuple, postings.build(docs, whole=True).collect()))
    before = written(spark)
    postings.write_whole(docs, str(tmp_path / "index"))
    made = postings.stored(spark, str(tmp_path / "index"))
    assert written(spark) == before and made.select("wave").distinct().count() > 1
    assert sorted(map(tuple, made.drop("wave").collect())) == want
