"""Rules that no catalogue query names."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from trailmark.functions import content, git
from trailmark.operators import evidence, export, learning, read, upsert
from trailmark.sources import transcripts


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_line_ids(spark):
    own = "0F9619FF-8B86-D011-B42D-00C04FC964FF"
    texts = ['{"a":1}', "", "é", "x" * 500]
    df = spark.createDataFrame([(own, "t"), *[(None, t) for t in texts], ("no uuid", "t"), (None, None)], "native string, stable string")
    made = [r[0] for r in df.select(content.line_id(F.col("native"), F.col("stable"))).collect()]
    assert made == [own.lower(), *[str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts], str(uuid.uuid5(uuid.NAMESPACE_URL, "t")), None]


def test_evidence_that_holds(spark):
    problems = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "session_id int, problem string")
    checked = spark.createDataFrame([(1, "a", None), (1, "a", "msg-1: quote is not there"), (1, "b", None)], "session_id int, problem string, failure string")
    assert got(evidence.proven(problems, checked)) == [(1, "b"), (2, "a")]
    cited = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 4, 4)], "session_id int, problem string, from long, to long")
    records = spark.createDataFrame([(1, i, datetime(2024, 1, 5 - i)) for i in range(4)], "session_id int, seq long, ts timestamp")
    assert got(evidence.seen_at(cited, records)) == [(1, "a", datetime(2024, 1, 4))]
    ends = spark.createDataFrame([(["msg-3", "msg-9"],), (["msg-3"],), (["msg-x"],), ([],)], "e array<string>")
    assert [bool(r[0]) for r in ends.select(evidence.reaches_new(F.col("e"), 5)).collect()] == [True, False, False, False]


def test_new_part(spark):
    rows = [(1, i, datetime(2024, 1, 1, i), datetime(2024, 1, 1, i), "message", None) for i in range(6)]
    rows += [(1, 6, datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 0), "toolCall", "c"), (1, 7, datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 9), "toolResult", "c"), (1, 8, None, datetime(2024, 1, 1, 9), "message", None)]
    df = spark.createDataFrame(rows, "session_id int, pos int, ts timestamp, created_at timestamp, msg_type string, call_id string")
    made = export.new_part(df, F.lit(datetime(2024, 1, 1, 4, 30)), context=2)
    assert got(made, "pos", "is_new") == [(4, False), (5, True), (6, False), (7, True), (8, True)]


def test_repos_and_origins(spark):
    said = spark.createDataFrame([(1, "/a", 0, "main"), (1, "/b", 1, "main"), (2, None, 0, "main"), (2, "/x", 1, "agent:q"), (3, "/z", 5, "main")], "session_id int, cwd string, pos int, track_id string")
    repos = spark.createDataFrame([("/a", 10), ("/root", 99)], "cwd string, repo_id int")
    assert got(export.attribute_repos(said, repos, "/root"), "session_id", "pos", "repo_id") == [(1, 0, 10), (1, 1, 99), (2, 0, 99), (2, 1, 99), (3, 5, 99)]
    assert got(export.attribute_repos(said, repos), "session_id", "pos", "repo_id")[1] == (1, 1, None)
    assert got(export.origins(said, spark.createDataFrame([(3,)], "session_id int"))) == [(1, "/a")]


def test_for_readers(spark):
    rows = [("bash", "success", "in", "fine\nError: no such file\nmore"), ("bash", "failure", "i" * 9_000, "short"), ("AskUserQuestion", "success", "q" * 9_000, "the answer"), (None, None, None, None)]
    made = export.for_reader(spark.createDataFrame(rows, "tool_name string, status string, input string, output string")).collect()
    assert made[0].output.startswith("[… output left out, ") and "Error: no such file" in made[0].output and "fine" not in made[0].output
    assert made[1].output == "short" and len(made[1].input) < 9_000 and made[2].input == "q" * 9_000 and made[2].output == "the answer" and made[3].output is None
    pieces = spark.createDataFrame([("p", 1, "a"), ("p", 0, "b"), ("q", 0, "b"), ("q", 1, "a"), ("r", 0, "a")], "piece string, seq int, text string")
    hashes = dict(got(export.piece_hash(pieces, ["piece"])))
    assert hashes["p"] == hashes["q"] != hashes["r"]


def test_learning_lists(spark):
    at = lambda d: datetime(2024, 1, d)
    problems = spark.createDataFrame([(3, at(2), None), (1, at(2), None), (2, at(1), None), (4, at(1), 7)], "problem_id int, created_at timestamp, learning_run_id int")
    assert [r.problem_id for r in learning.unmarked(problems, 2).collect()] == [2, 1]
    events = spark.createDataFrame([("b", at(1)), ("a", at(1)), ("c", at(3))], "event_id string, timestamp timestamp")
    assert [r.event_id for r in learning.newest_events(events, 2).collect()] == ["c", "a"]
    pulls = spark.createDataFrame([(1, 1, "open", at(1)), (1, 2, "open", None), (1, 3, "open", at(9)), (1, 4, "closed", None)], "repo_id int, number int, state string, checked_at timestamp")
    assert [r.number for r in learning.pull_requests_to_check(pulls, F.lit(at(5))).collect()] == [2, 1]
    queue = spark.createDataFrame([(1, "p", "waiting", at(1)), (2, "q", "waiting", at(2)), (3, "q", "running", at(1))], "id int, project_id string, status string, created_at timestamp")
    assert got(learning.fix_run_ready(queue, spark.createDataFrame([("p", "running"), ("q", "done")], "project_id string, status string")), "id") == [(2,)]
    lessons = spark.createDataFrame([("dev", "b", "T2", "two"), ("dev", "a", "T1", None), ("ops", "a", "T", "x")], "audience string, category string, title string, body string")
    assert dict(got(learning.knowledge(lessons))) == {"dev": "## T1\n\n\n\n## T2\n\ntwo", "ops": "## T\n\nx"}


def test_parents_and_states(spark):
    helpers = spark.createDataFrame([(1, "a", "t1"), (1, "b", "t2"), (1, "c", "t9"), (2, "d", "t1")], "session_id int, agent_id string, spawn_tool_use_id string")
    calls = spark.createDataFrame([(1, "t1", None), (1, "t2", "a"), (1, "t2", "a")], "session_id int, tool_id string, agent_id string")
    assert got(read.parents_of(helpers, calls), "agent_id", "parent_agent_id") == [("a", None), ("b", "a"), ("c", None), ("d", None)]
    at = datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, 1, "open", None, None), (1, 2, "closed", at, None), (1, 3, "open", None, None)], "repo_id int, number int, state string, closed_at timestamp, checked_at timestamp")
    answers = spark.createDataFrame([(1, 1, "merged", at), (1, 2, None, None)], "repo_id int, number int, state string, closed_at timestamp")
    now = datetime(2024, 2, 2)
    assert got(upsert.pull_request_states(stored, answers, F.lit(now))) == [(1, 1, "merged", at, now), (1, 2, "closed", at, now), (1, 3, "open", None, None)]
    states = spark.createDataFrame([("MERGED", at, now), ("CLOSED", None, at)], "s string, m timestamp, c timestamp").select(git.pull_request_state(F.col("s"), F.col("m"), F.col("c")).alias("x"))
    assert [tuple(r.x) for r in states.collect()] == [("merged", at), ("closed", at)]


def test_files_and_coverage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    (tmp_path / "b.jsonl").write_text("")
    files = {r.path.rsplit("/", 1)[-1]: (r.size, r.content) for r in transcripts.read_files(spark, str(tmp_path)).collect()}
    assert files["a.jsonl"] == (8, "one\ntwo\n")
    key = "session_id string, track_id string"
    n = lambda *some: spark.createDataFrame(list(some), key)
    made = transcripts.coverage(n(("s", "main"), ("s", "main"), ("s", "agent:a")), n(("s", "main")), n(("s", "main"), ("s", "main"), ("s", "main")))
    assert got(made) == [("s", "agent:a", 1, 0, 0), ("s", "main", 2, 1, 3)]
