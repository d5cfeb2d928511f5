import json
import re

import pytest
from pyspark.sql import functions as F

from trailmark.sources import transcripts as t
from trailmark.streaming import ingest

PATH = "/home/a/.x/projects/p/"
LINES = [
    {"type": "user", "uuid": "0A000000-0000-4000-8000-000000000001", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "Hello\nthere"}},
    {"type": "assistant", "timestamp": "2024-01-01T00:00:05", "message": {"role": "assistant", "usage": {"input_tokens": 3, "output_tokens": -1}, "content": [
        {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Done"}, {"type": "text"},
        {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "git commit -m x", "api_key": "k"}}]}},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": "no"}]}, "toolUseResult": {"filePath": "/w/a"}},
    {"type": "user", "isMeta": True, "message": {"role": "user", "content": []}},
    {"type": "user", "message": {"role": "user", "content": "<command-name>/go</command-name>"}, "exitCode": 1},
    {"type": "attachment", "attachment": {"type": "queued_command", "prompt": "next", "commandMode": "task-notification"}},
    {"type": "attachment", "attachment": {"type": "edited_text_file", "filename": "/w/b"}},
    {"type": "system", "subtype": "compact_boundary"},
    {"type": "progress", "data": {"type": "bash", "stdout": "x", "toolUseID": "c1"}},
    {"type": "user", "isCompactSummary": True, "message": {"role": "user", "content": "sum", "usage": {"input_tokens": 2}}},
    {"type": "summary"},
    {"odd": 1},
]
TEXT = "\n".join(map(json.dumps, LINES[:2])) + "\n\n" + "".join(json.dumps(x) + "\n" for x in LINES[2:]) + '{"cut":'


@pytest.fixture(scope="module")
def messages(spark):
    files = spark.createDataFrame([(PATH + "s1.jsonl", TEXT), (PATH + "bad.jsonl", '{"a":1}\n[1]\n')], "path string, content string")
    records, rejects = t.parse_lines(t.complete_lines(files))
    assert [tuple(r) for r in rejects.collect()] == [(PATH + "bad.jsonl", 2)]
    placed = records.withColumn("c", t.classify(F.col("path"))).select("c.*", "line", "raw")
    return sorted(t.normalise(placed).collect(), key=lambda r: (r.line, r.sub_index))


def test_types(messages):
    assert [(r.line, r.sub_index, r.msg_type, r.sub_type) for r in messages] == [
        (1, 0, "message", None), (2, 0, "message", None), (2, 1, "message", None), (2, 2, "custom", "text"), (2, 3, "toolCall", None),
        (4, 0, "toolResult", None), (5, 0, "custom", "message.content"), (6, 0, "localCommand", None), (7, 0, "message", "taskNotification"),
        (8, 0, "fileEvent", "edited_text_file"), (9, 0, "compaction", "compact_boundary"), (10, 0, "progress", "bash"),
        (11, 0, "message", "compactSummary"), (11, 1, "usage", "tokens"), (12, 0, "systemEvent", "summary"), (13, 0, "custom", "unknown"),
    ]


def test_fields(messages):
    by = {(r.line, r.sub_index): r for r in messages}
    assert by[1, 0].line_uuid == "0a000000-0000-4000-8000-000000000001" and by[1, 0].ts is not None
    assert by[2, 0].ts is None  # no zone
    assert by[2, 0].content_type == "reasoning" and by[2, 0].role == "assistant" and by[2, 0].tokens.asDict() == {"input": 3, "output": 0, "cached": 0, "thinking": 0}
    assert by[2, 1].tokens is None
    assert by[2, 3].command == "git commit -m x" and "Redacted" in by[2, 3].input
    assert by[4, 0].status == "failure" and by[4, 0].write_path == "/w/a" and by[4, 0].output == '"no"'
    assert by[6, 0].command == "/go" and by[6, 0].status == "failure"
    assert by[11, 1].tokens.input == 2 and by[11, 0].tokens is None
    assert len({(r.line_uuid, r.sub_index) for r in messages}) == len(messages)


def test_classify(spark):
    paths = ["s.jsonl", "s/subagents/agent-7.jsonl", "s/subagents/x/y.jsonl", "s/subagents/workflows/w/journal.jsonl", "s/notes.txt"]
    rows = spark.createDataFrame([(PATH + p,) for p in paths], "path string").select(t.classify(F.col("path")).alias("c")).collect()
    assert [r.c and (r.c.session_id, r.c.track_id[:10]) for r in rows] == [("s", "main"), ("s", "agent:7"), ("s", "agent:path"), None, None]


def test_cutoff_and_titles(spark):
    raw = [
        ("old", "main", 1, {"timestamp": "2020-01-01T00:00:00Z"}), ("old", "agent:1", 1, {"timestamp": "2024-01-01T00:00:00Z"}),
        ("new", "main", 1, {"timestamp": "2024-01-01T00:00:00Z"}), ("none", "main", 1, {"type": "ai-title", "aiTitle": "A"}),
        ("none", "main", 2, {"type": "custom-title", "customTitle": " C "}), ("none", "main", 3, {"type": "ai-title", "aiTitle": "B"}),
    ]
    df = spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in raw], "session_id string, track_id string, line int, raw string")
    kept = t.within_cutoff(df, F.to_timestamp(F.lit("2023-01-01")))
    assert {r.session_id for r in kept.collect()} == {"new", "none"}
    assert {r.session_id: r.title for r in t.titles(df).collect()}["none"] == "C"


def test_changed(spark):
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 5), ("d", 1, 1)], "path string, modified int, size int")
    seen = spark.createDataFrame([("a", 1, 10, 3), ("b", 1, 15, 4), ("c", 1, 9, 7)], "path string, modified int, size int, lines int")
    assert {r.path: r.from_line for r in t.changed(files, seen).collect()} == {"b": 5, "c": 1, "d": 1}


def test_ingest_twice(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    one = "".join(json.dumps(x) + "\n" for x in LINES[:3])
    files = spark.createDataFrame([(PATH + "s1.jsonl", one)], "path string, content string")
    assert ingest.ingest_files(store, files, 0) == {"ingested": 6, "deduped": 0}
    assert ingest.ingest_files(store, files, 0) == {"ingested": 6, "deduped": 0}  # the same batch again
    assert ingest.ingest_files(store, files, 1) == {"ingested": 0, "deduped": 6}
    more = spark.createDataFrame([(PATH + "s1.jsonl", one + json.dumps(LINES[-1]) + "\n")], "path string, content string")
    assert ingest.ingest_files(store, more, 2) == {"ingested": 1, "deduped": 6}
    schema = spark.read.parquet(str(tmp_path / "store/sessions/batch=0")).drop("shard").schema
    assert [r.messages for r in ingest.sessions(store, schema).collect()] == [7]


def test_replay_equals_a_fresh_ingest(spark, tmp_path):
    """A session read anew has the rows that it would have had at once; others keep theirs, and nothing else is read."""
    name = PATH + "{}.jsonl"
    text = lambda some: "".join(json.dumps(x) + "\n" for x in some)
    files = lambda *some: spark.createDataFrame([(name.format(s), text(x)) for s, x in some], "path string, content string")
    store = ingest.Store(spark, str(tmp_path / "store"), shards=8)
    ingest.ingest_files(store, files(("s1", LINES), ("s2", LINES[:4])), 0)
    ingest.replay(store, files(("s1", LINES[2:6])), 1)
    ingest.ingest_files(store, files(("s2", LINES[:5])), 2)
    fresh = ingest.Store(spark, str(tmp_path / "fresh"), shards=3)
    ingest.ingest_files(fresh, files(("s1", LINES[2:6]), ("s2", LINES[:5])), 0)
    schema = spark.read.parquet(str(tmp_path / "fresh/messages/batch=0")).drop("shard").schema
    rows = lambda s: sorted(map(repr, s.read("messages", schema).collect()))
    assert rows(store) == rows(fresh)
    kind = spark.read.parquet(str(tmp_path / "fresh/sessions/batch=0")).drop("shard").schema
    assert sorted(map(repr, ingest.sessions(store, kind).collect())) == sorted(map(repr, ingest.sessions(fresh, kind).collect()))
    assert store.committed() == [(0, 2)]
    near = store.shards_of(spark.createDataFrame([("s2",)], "session_id string"))
    plan = store.read("messages", schema, shards=near)._jdf.queryExecution().executedPlan().toString()
    assert len(near) == 1 and re.search(r"PartitionFilters: \[.*\(shard#", plan)


def test_what_is_not_committed_is_not_there(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "1", 0, 1, 5), ("b", "1", 0, 1, 6)], "session_id string, line_uuid string, sub_index int, line int, ts int")
    assert ingest.ingest_messages(store, rows, 3) == {"ingested": 2, "deduped": 0} and store.read("messages", rows.schema).count() == 0
    store.commit(3)
    assert store.read("messages", rows.schema).count() == 2 and store.committed() == [(3, 3)]
    ingest.ingest_messages(store, rows.limit(0), 5, rows.where("session_id = 'a'"))  # a session that is gone
    store.commit(5)
    assert [r.session_id for r in store.read("messages", rows.schema).collect()] == ["b"] and store.committed() == [(3, 3), (5, 5)]
    ingest.ingest_messages(store, rows.limit(0), 4)
    store.commit(4)
    store.commit(4)
    assert store.committed() == [(3, 5)] and [r.session_id for r in store.read("messages", rows.schema).collect()] == ["b"]
    for batch in range(6, 12):
        ingest.ingest_messages(store, rows.limit(0), batch)
        store.commit(batch)
    assert store.committed() == [(3, 11)] and len(list((tmp_path / "store/manifests").glob("at=*"))) == ingest.BEHIND + 1


def test_follow(spark, tmp_path):
    folder = tmp_path / "x/projects/p"
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text(TEXT)
    store = ingest.Store(spark, str(tmp_path / "store"))
    run = lambda: ingest.follow(spark, str(tmp_path / "x"), store, str(tmp_path / "at")).awaitTermination()
    run()
    (folder / "s2.jsonl").write_text(TEXT)
    run()
    schema = spark.read.parquet(str(tmp_path / "store/messages/batch=0")).drop("shard").schema
    found = store.read("messages", schema).groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in found} == {"s1": 16, "s2": 16}


def test_sidecars(spark):
    from trailmark.sources import transcripts

    paths = spark.createDataFrame([("s/agent-a1.jsonl",), ("s/main.jsonl",), ("s\\agent-b.jsonl",), ("s/agent-c.jsonl",), ("s/agent-.jsonl",)], "path string")
    metadata = spark.createDataFrame([
        ("s/agent-a1.meta.json", '{"agentType":"explore","description":"","spawnDepth":2,"toolUseId":"t1","spawnToolUseId":"t0"}'),
        ("s\\agent-b.meta.json", '{"agentType":7,"spawnDepth":-1,"spawnToolUseId":"t2"}'), ("s/agent-c.meta.json", "[broken"),
    ], "path string, raw string")
    got = sorted(map(tuple, transcripts.sidecars(paths, metadata).drop("path").collect()))
    assert got == [("a1", "explore", "", 2, "t1"), ("b", None, None, None, "t2"), ("c", None, None, None, None)]
