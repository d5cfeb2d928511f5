import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import chains, evidence, reviews, runs, transform
from trailmark.sources import histories
from trailmark.streaming import acks


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def greedy(sizes, most):
    held, number, out = 0, 0, []
    for n in sizes:
        if held and held + n > most:
            number, held = number + 1, 0
        held += n
        out.append(number)
    return out


def test_pack_is_greedy(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for g in [*range(12), None]:
        sizes = [rnd.choice([0, 0, 1, 3, 5, 9, 11, 30, None]) for _ in range(rnd.choice([1, 2, 30, 90]))]
        for i, p in enumerate(greedy([s or 0 for s in sizes], 10)):
            rows.append((g, i, sizes[i], "x"))
            want[g, i] = p
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, s int, pack_of string")
    assert {(r.g, r.i): r.pack for r in runs.pack(df, ["g"], ["i"], "s", 10).collect()} == want
    assert runs.pack(df.limit(0), ["g"], ["i"], "s", 10).count() == 0


def test_chains(spark):
    links = [("a", i, i + 1 if i < 40 else None) for i in range(41)] + [("loop", i, (i + 1) % 5) for i in range(5)]
    links += [("late", 0, 1), ("late", 1, 2), ("late", 2, 3), ("late", 3, 1), ("gone", 0, 99), (None, 7, 8), (None, 8, None), ("a", 77, 3)]
    df = spark.createDataFrame(links, "g string, k int, t int")
    marks, loops = chains.reached(df, ["g"], "k", "t", df.where("k = 0 or k = 7 and g is null"))
    assert got(loops) == [("late",), ("loop",)]
    assert got(marks, "g", "k", "step") == sorted([("a", i, i) for i in range(41)] + [("gone", 0, 0), (None, 7, 0), (None, 8, 1)], key=repr)


def test_pages(spark):
    schema = "thread string, cursor string, following string, body int"
    plain = [("t", None, "x", 1), ("t", "x", "y", 2), ("t", "y", None, 3), ("t", "y", None, 4), ("t", "lost", None, 5), ("u", None, "", 6)]
    made = chains.pages_in_order(spark.createDataFrame(plain, schema), ["thread"], "cursor", "following")
    assert [r[:2] for r in got(made, "thread", "page", "body")] == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    with pytest.raises(chains.LoopError, match="t"):
        chains.pages_in_order(spark.createDataFrame([*plain[:2], ("t", "y", "x", 3)], schema), ["thread"], "cursor", "following")


def test_acknowledged_prefix_and_checkpoints(spark):
    rows = [("a", 0, 10, True, 5), ("a", 1, 20, True, 5), ("a", 2, 30, False, 5), ("a", 3, 40, True, 5), ("b", 0, 7, None, 1), ("b", 1, 9, True, 1), ("c", 0, 4, True, 2)]
    sent = acks.acknowledged(spark.createDataFrame(rows, "k string, chunk int, last_line int, ok boolean, n int"), ["k"], messages="n")
    assert got(sent) == [("a", 20, 2, 10, False), ("b", None, 0, 0, False), ("c", 4, 1, 2, True)]
    tracks = spark.createDataFrame([("a", 45), ("b", 9), ("c", 6)], "k string, last_line int")
    old = spark.createDataFrame([("b", 3), ("d", 8)], "k string, line int")
    assert got(acks.checkpoints(old, sent, tracks, "k")) == [("a", 20), ("b", 3), ("c", 6), ("d", 8)]


def test_failure_comes_down(spark):
    rows = [("main", None, False), ("a", "main", True), ("b", "a", False), ("c", "b", False), ("d", "main", False), ("e", "gone", False), ("r1", "r2", False), ("r2", "r1", False), ("below", "r1", False), ("self", "self", None)]
    deep = [(f"n{i}", f"n{i - 1}" if i else None, i == 3) for i in range(40)]
    made = acks.waves(spark.createDataFrame([*rows, *deep], "k string, up string, failed boolean"), "k", "up", "failed")
    out = {r.k: (r.wave, r.held) for r in made.collect()}
    assert [out[k] for k in ("main", "a", "b", "c", "d", "e")] == [(0, False), (1, False), (2, True), (3, True), (1, False), (0, False)]
    assert [out[k] for k in ("r1", "r2", "below", "self")] == [(None, True)] * 4
    assert all(out[f"n{i}"] == (i, i > 3) for i in range(40))


def test_two_readings(spark):
    rnd = random.Random(3)
    old, new, want = [], [], []
    for k in range(40):
        a = [rnd.choice([*"abc", None]) for _ in range(rnd.randrange(12))]
        b = a[: rnd.randrange(len(a) + 1)] + [rnd.choice("abc") for _ in range(rnd.randrange(4))]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        old += [(k, i + 1, x) for i, x in enumerate(a)]
        new += [(k, i + 1, x) for i, x in enumerate(b)]
        want += [(k, i + 1, x, "kept" if i < same else "withdrawn") for i, x in enumerate(a)] + [(k, i + 1, x, "fresh") for i, x in enumerate(b) if i >= same]
    schema = "k int, place int, item string"
    made = histories.reconciled(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k"], "place", "item")
    assert got(made) == sorted(want, key=repr)


def test_pending_items_of_a_turn_that_is_gone(spark):
    ids = "thread_id string, turn_id string, item_id string"
    pending = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "1", "done"), ("unread", "9", "c")], ids)
    left = histories.still_pending(pending, spark.createDataFrame([("t", "1")], "thread_id string, turn_id string"), spark.createDataFrame([("t",)], "thread_id string"),
                                   spark.createDataFrame([("t", "1", "done")], ids))
    assert got(left) == [("t", "1", "a"), ("unread", "9", "c")]


def test_transformers_count_what_they_change(spark):
    rows = [("user", "message", None, " <task-notification> x"), ("user", "message", "other", "<task-notification>"), ("assistant", "message", None, "<task-notification>"), ("user", "message", None, None), ("user", "message", None, "plain")]
    df = spark.createDataFrame(rows, "role string, msg_type string, sub_type string, text string")
    shout = transform.Transformer("shout", "text", F.when(F.col("sub_type") == "taskNotification", F.upper("text")).otherwise(F.col("text")))
    out, seen = transform.transformed(df, [transform.task_notification(), shout])
    kept = out.collect()
    assert seen.get == {"rows": 5, "task-notification-subtype": 1, "shout": 1}
    assert [(r.sub_type, r.text) for r in kept][:2] == [("taskNotification", " <TASK-NOTIFICATION> X"), ("other", "<task-notification>")] and out.columns == df.columns


def test_context_of_citations(spark):
    rnd = random.Random(8)
    records = {s: [(rnd.choice("mab"), rnd.random() < 0.5) for _ in range(30)] for s in range(6)}
    cited = [(s, i, first, first + rnd.choice([0, 0, 1, 4])) for s in records for i, first in enumerate(rnd.sample(range(32), 5))]
    want = set()
    for s, item, first, last in cited:
        rows = records[s]
        inside = [i for i in range(first, last + 1) if i < 30]
        shown = [i for i in inside if rows[i][1]] or inside
        want |= {(s, item, i, True) for i in shown}
        if first < 30:
            near = [i for i in range(30) if rows[i] == (rows[first][0], True)]
            want |= {(s, item, i, False) for i in [i for i in near if i < first][-2:] + [i for i in near if i > last][:2]}
    flat = [(s, i, t, f) for s, rows in records.items() for i, (t, f) in enumerate(rows)]
    made = runs.context(spark.createDataFrame(cited, "s int, item int, first long, last long"), spark.createDataFrame(flat, "s int, seq long, track string, filled boolean"), ["s"])
    assert got(made) == sorted(want, key=repr)


def test_excerpts(spark):
    records = spark.createDataFrame([(1, i, f"r{i}" + "x" * 8) for i in range(20)], "session_id int, seq long, line string")
    cited = spark.createDataFrame([(1, "p", 2, 2), (1, "p", 5, 6), (1, "p", 16, 18), (1, "q", 0, 0), (1, "q", 9, 3), (2, "r", 1, 1)], "session_id int, problem string, first long, last long")
    made = {(r.problem, r.block): r for r in evidence.excerpts(cited, records, reach=1, budget=1_000).collect()}
    assert {k: (r.first, r.last, r.n, r.cut) for k, r in made.items()} == {("p", 1): (1, 7, 7, False), ("p", 2): (15, 19, 5, False), ("q", 1): (0, 1, 2, False)}
    assert made["q", 1].text == "r0xxxxxxxx\n\nr1xxxxxxxx"
    short = {(r.problem, r.block): (r.n, r.cut) for r in evidence.excerpts(cited, records, reach=1, budget=85).collect()}
    assert short == {("p", 1): (7, False), ("p", 2): (2, True), ("q", 1): (2, False)}
    problems = spark.createDataFrame([("p", "a", [(2, 2), (9, 9)]), ("none", "a", []), ("moved", "b", [(1, 1)]), ("old", "c", [(1, 1)])], "problem string, review_id string, evidence array<struct<first:long,last:long>>")
    known = spark.createDataFrame([("a", 1, 7, True), ("b", 1, 8, True), ("c", 1, 7, False)], "review_id string, session_id int, project_id int, numbered boolean")
    told = dict(got(evidence.with_excerpts(problems, known, records, 7, reach=0), "problem", "excerpt"))
    assert told == {"p": "r2xxxxxxxx\n\n...\n\nr9xxxxxxxx", "none": None, "moved": None, "old": None}


def test_late_results_of_reviews(spark):
    made = spark.createDataFrame([("a", "running", 2, None, None, None), ("b", "running", 3, None, None, None), ("c", "done", 1, "x", "s", "m"), ("d", "running", 1, None, None, None), ("e", "waiting", 1, None, None, None)],
                                 "run_id string, status string, attempts int, outcome string, summary string, last_message_id string")
    had = spark.createDataFrame([("a", 0, "old"), ("b", 0, "stays"), ("c", 0, "kept")], "review_id string, position int, title string")
    kind = "run_id string, attempt int, arrival int, error string, outcome string, summary string, last_message_id string, problems array<struct<title:string>>"
    results = [("a", 1, 1, None, "late", None, None, [("no",)]), ("a", 2, 2, None, "productive", "s", "m9", [("one",), ("two",)]), ("a", 2, 3, None, "again", None, None, []),
               ("b", 3, 1, "broken", None, None, None, None), ("c", 1, 1, None, "x", None, None, None), ("d", 1, 1, "broken", None, None, None, None), ("zzz", 1, 1, None, None, None, None, None), ("e", None, 1, None, None, None, None, None)]
    after, problems, refused = reviews.finish(made, had, spark.createDataFrame(results, kind))
    assert got(after) == [("a", "done", 2, "productive", "s", "m9"), ("b", "failed", 3, None, None, None), ("c", "done", 1, "x", "s", "m"), ("d", "waiting", 1, None, None, None), ("e", "waiting", 1, None, None, None)]
    assert got(problems) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "stays"), ("c", 0, "kept")]
    assert got(refused) == [("a", 1, 1, "other attempt"), ("a", 2, 3, "repeated"), ("c", 1, 1, "not running"), ("e", None, 1, "not running"), ("zzz", 1, 1, "unknown")]


def test_packing_shuffles_once(spark):
    rows = spark.range(3_000).selectExpr("id % 7 as g", "id as i", "id % 5 as s", "'x' as text", "timestamp_seconds(id) as at")
    made = runs.pack(rows, ["g"], ["i"], "s", 9)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "parquet" not in plan  # nothing is written and read again
    want, held, number, group = {}, 0, 0, None
    for r in rows.orderBy("g", "i").collect():
        if r.g != group:
            held, number, group = 0, 0, r.g
        if held > 0 and held + r.s > 9:
            held, number = r.s, number + 1
        else:
            held += r.s
        want[r.i] = (number, r.text, r.at)
    assert {r.i: (r.pack, r.text, r.at) for r in made.collect()} == want
