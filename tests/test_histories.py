import json

from pyspark.sql import functions as F

from trailmark.operators import learning
from trailmark.sources import histories as h


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def test_parts(spark):
    messages = spark.createDataFrame([
        ("m1", "s", 1, json.dumps({"role": "user"})), ("m2", "s", 2, json.dumps({"role": "assistant", "tokens": {"input": 4, "output": 5, "cache": {"read": 6}, "reasoning": -1}})),
        ("m3", "s", 3, "{cut"),
    ], "id string, session_id string, time_created long, data string")
    part = lambda i, m, **d: (i, m, 10, json.dumps(d))
    parts = spark.createDataFrame([
        part("a", "m1", type="file"), part("b", "m1", type="text", text="hi"), part("a", "m2", type="step-start"), part("b", "m2", type="text", text="yo"),
        part("c", "m2", type="tool", tool="write", callID="k", state={"status": "completed", "input": {"filePath": "/f"}, "output": "ok"}),
        part("d", "m2", type="tool", state={"status": "running"}), part("e", "m2", type="step-finish", reason="aborted"), part("z", "m3", type="text"),
    ], "id string, message_id string, time_created long, data string")
    got = sorted(h.part_messages(messages, parts).collect(), key=lambda r: (r.message_id, r.sub_index))
    assert [(r.message_id, r.sub_index, r.msg_type, r.sub_type, r.call_id, r.status) for r in got] == [
        ("m1", 0, "message", None, None, None), ("m2", 0, "custom", "step-start", None, None), ("m2", 2, "message", None, None, None),
        ("m2", 4, "toolCall", None, "k", None), ("m2", 5, "toolResult", None, "k", "success"), ("m2", 6, "toolCall", None, "d", None), ("m2", 8, "turnEvent", None, None, "aborted"),
    ]
    assert got[2].tokens.asDict() == {"input": 4, "output": 5, "cached": 6, "thinking": 0} and got[4].write_path == "/f" and got[0].text == "hi"


def test_threads(spark):
    turns = spark.createDataFrame([("t", "u1", 0, "completed", 5), ("t", "u2", 1, "interrupted", None)], "thread_id string, turn_id string, turn_pos int, status string, completed_at long")
    item = lambda turn, pos, **d: ("t", turn, pos, json.dumps(d))
    items = spark.createDataFrame([
        item("u2", 0, id="3", type="reasoning", summary=["a"], content=["b"]), item("u1", 1, id="2", type="commandExecution", command="ls", status="completed", exitCode=1, aggregatedOutput="no"),
        item("u1", 0, id="1", type="userMessage", content=[{"type": "text", "text": "go"}, {"type": "odd"}]), item("gone", 0, id="4", type="mystery"),
    ], "thread_id string, turn_id string, item_pos int, item string")
    got = sorted(h.item_messages(h.ordered_items(turns, items)).collect(), key=lambda r: (r.pos, r.sub_index))
    assert [(r.pos, r.sub_index, r.msg_type, r.text, r.status) for r in got] == [
        (0, 0, "message", "go", None), (0, 1, "custom", None, None), (1, 0, "toolCall", None, None), (1, 1, "toolResult", "no", "failure"),
        (2, 0, "turnEvent", None, "completed"), (3, 0, "message", "a\n\nb", None), (4, 0, "custom", None, None), (5, 0, "custom", None, None),
    ]


def test_event_lines(spark):
    good = {"eventId": "e", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "trigger": "auto", "whyTriggered": "", "proposed_learning": "p", "outcome": "new", "status": ""}
    lines = [good, "{cut", {**good, "eventId": ""}, {**good, "outcome": "later"}, good, [1]]
    df = spark.createDataFrame([("f", i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)] + [("g", 1, json.dumps(good))], "path string, line int, text string")
    got = {(r.path, r.line): r for r in h.event_lines(df).collect()}
    assert [got["f", i].kind for i in range(6)] == ["event", "broken", "broken", "unknown", "held", "unknown"] and got["g", 1].kind == "event"
    assert got["f", 3].reason == "outcome" and got["f", 0].event.status is None and got["f", 0].event.why_triggered == ""


def test_small_sources(spark):
    df = spark.createDataFrame([('[{"a":1,"b":"x"},{"a":null}]',), ("no",), (None,)], "j string")
    assert rows(h.recordset(df, "j", "a int, b string")) == [(1, "x"), (None, None)]
    pages = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("l", 1, "x")], "id string, at int, v string")
    assert rows(h.latest_pages(pages, ["id"], "at"), "id", "v") == [("k", "new"), ("l", "x")]
    assert rows(h.up_to_date(pages.where("v = 'old'"), pages, "id", "at"), "id", "v") == [("k", "new"), ("l", "x")]
    sessions = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert rows(h.families(sessions)) == [("a", "a", "main"), ("b", "a", "agent:b"), ("c", "a", "agent:c")]


def test_save_groups(spark):
    groups = spark.createDataFrame([
        (1, None, "learning", [1, 2]), (2, 7, "learning", [3]), (3, 8, "learning", [4]), (4, 7, "link", [5]), (5, None, "drop", [6]), (6, None, "learning", [9, 10]),
    ], "group_id int, learning_id int, verdict string, problem_ids array<int>")
    problems = spark.createDataFrame([(i, 1 if i == 9 else None) for i in (1, 3, 4, 5, 6, 9)], "problem_id int, learning_run_id int")
    fixes = spark.createDataFrame([(7, "skipped"), (8, "rejected")], "learning_id int, decision string")
    assert rows(learning.save_groups(groups, problems, fixes)) == [
        (1, "created", None, [1]), (2, "updated", 7, [3]), (3, "linked", 8, [4]), (4, "linked", 7, [5]), (5, "dropped", None, [6]), (6, "skipped", None, []),
    ]


def test_projects_and_batches(spark):
    asked = spark.createDataFrame([("u", "Acme", "app"), ("u", "other", "app"), ("v", "acme", "app")], "user_id string, org_slug string, slug string")
    projects = spark.createDataFrame([("app", "org", "o1", "p1")], "slug string, owner_kind string, owner_id string, project_id string")
    members = spark.createDataFrame([("u", "acme", "o1")], "user_id string, org_slug string, org_id string")
    assert rows(learning.find_or_create(asked, projects, members), "user_id", "owner_kind", "project_id", "created") == [("u", "org", "p1", False), ("u", "user", None, True), ("v", "user", None, True)]
    sessions = spark.createDataFrame([(i,) for i in range(1, 5)], "session_id int")
    runs = spark.createDataFrame([(1, "a", "done"), (2, "a", "done"), (3, "a", "running"), (4, "b", "done")], "session_id int, analyzer string, status string")
    news = spark.createDataFrame([(2,), (3,)], "session_id int")
    assert rows(learning.review_batch(sessions, runs, news, "a")) == [(1, "skip"), (2, "newPart"), (3, "skip"), (4, "full")]
    caps = spark.createDataFrame([("high", i) for i in range(7)] + [("low", 1)], "priority string, n int")
    assert len(rows(learning.within_caps(caps, {"high": 2}, F.col("n")))) == 4


def test_events_and_reading(spark):
    events = spark.createDataFrame([("u", "p1", "n1", 1), ("v", "p1", "n1", 2), ("v", "p2", "n2", 3), ("u", "p2", "n2", 4)], "user_id string, project_id string, project_name string, event_id int")
    seen = spark.createDataFrame([("p1",)], "project_id string")
    assert rows(learning.visible_events(events, "u", seen), "event_id", "project_name") == [(1, "n1"), (2, "n1"), (4, None)]
    messages = spark.createDataFrame([("a", 1, None, "main", 5, 10), ("a", 2, None, "x", 9, 11), ("b", 1, 7, "main", 1, 12), ("b", 2, 7, "x", 1, 13)], "session_id string, pos int, ts int, track_id string, line int, message_id int")
    assert rows(learning.last_read(messages)) == [("a", 10), ("b", 13)]
