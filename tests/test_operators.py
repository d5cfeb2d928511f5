"""Small cases with results worked out by hand, and edge cases: ties, nulls, empty tables."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from trailmark.functions import content, decisions, git
from trailmark.functions.query import QueryError, parse
from trailmark.operators import evidence, export, filters, leads, read, runs, scheduling, search, signals, upsert

UTC = timezone.utc


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.mark.parametrize("text", ["", " ", '"open', "- a", "a -", "OR a", "-a", "...", "x" * 201, "a OR -b"])
def test_bad_queries(text):
    with pytest.raises(QueryError):
        parse(text)


def test_query_grammar():
    branches = parse('one "two three" -four OR five')
    assert [[(o.value, o.phrase, o.excluded, o.prefix) for o in b] for b in branches] == [
        [("one", False, False, True), ("two three", True, False, False), ("four", False, True, False)],
        [("five", False, False, True)],
    ]


def test_search(spark):
    df = spark.createDataFrame([(1, "The quick Brown fox"), (2, "brown quick"), (3, None), (4, "")], "id int, text string")
    words = search.tokens(F.col("text"))
    hit = lambda q: [r[0] for r in rows(df.where(search.matches(words, q)), "id")]
    assert hit("bro") == [1, 2] and hit('"quick brown"') == [1] and hit("quick -fox") == [2] and hit("zebra OR fo") == [1]


def test_cap(spark):
    long = "a " * 16_383 + "bcd"
    df = spark.createDataFrame([("x " + "y" * 2_040 + " z",), (long,), (None,)], "t string").select(search.cap(F.col("t")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got[0] == "x  z" and got[1] == "a " * 16_383 and got[2] is None


def test_best_source_ties(spark):
    hits = spark.createDataFrame([(1, "message", 5, 1.0), (1, "session", 9, 1.0), (1, "session", 8, 1.0), (2, "toolCall", 1, 0.5)], "id int, source_kind string, source_row int, score double")
    assert rows(search.best_source(hits), "id", "source_kind", "source_row", "matched_rows") == [(1, "session", 8, 3), (2, "toolCall", 1, 1)]


E_ = "session_id int, seq long, kind string, status string, call_id string, name string, path string, is_meta boolean, input long, output long, cached long, thinking long"


def stream(*events):
    return [(1, i, *(e + (None,) * (10 - len(e)))) for i, e in enumerate(events)]


def test_signals(spark):
    fail = ("toolResult", "failure", None, "A")
    events = stream(
        ("userMessage",), fail, fail, ("turn", "completed"), fail, ("userMessage",), ("userMessage", None, None, None, None, True), ("userMessage",),
        ("toolResult", "failure", None, "B"), fail, ("edit", None, None, None, "p"), ("edit", None, None, None, "q"), ("edit", None, None, None, "p"),
        ("toolCall", None, "c", "T"), ("tokens", None, None, None, None, None, 5, 6, 7, 8), ("turn", "aborted"),
    )
    df = spark.createDataFrame(events, E_)
    out = signals.analyze(df).first()
    assert (out.corrections, out.rapid_reprompts, out.tool_failures, out.outcome) == (1, 1, 5, "aborted")
    assert [(x.tool, x.failures, x.first_seq, x.last_seq) for x in out.error_loops] == [("A", 3, 1, 4)]
    assert [(x.path, x.edit_count) for x in out.edits] == [("p", 2), ("q", 1)] and out.input_tokens == 5
    got = {(r.category, r.subject): r.evidence for r in signals.lessons(df).collect()}
    assert got == {("tool-retry", "A"): [1, 2, 4], ("supervision", "supervision"): [5]}
    assert signals.analyze(spark.createDataFrame([], E_)).count() == 0


def test_runs(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("u", "a"), ("u", "b"), ("a", None), ("u", "c"), (None, "d"), (None, "e")])], "k int, n int, r string, t string")
    assert rows(runs.merge_runs(df, ["k"], ["n"], ["r"], "t"), "run", "r", "n", "text") == [(1, "u", 2, "a\nb"), (2, "a", 1, ""), (3, "u", 1, "c"), (4, None, 2, "d\ne")]
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 20, 1, 9, None])], "k int, n int, s int")
    assert [r.pack for r in runs.pack(sizes, ["k"], ["n"], "s", 10).orderBy("n").collect()] == [0, 0, 1, 2, 3, 3, 3]
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", None)], "k string, p string")
    assert rows(runs.ancestry(ring, "k", "p")) == [("a", "b", 1), ("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    cited = spark.createDataFrame([(1, 2), (1, 3)], "k int, n int")
    assert rows(runs.around(cited, df, ["k"], "n", 1), "n", "truncated") == [(1, False), (2, False), (3, False), (4, False)]
    assert rows(runs.around(cited, df, ["k"], "n", 1, most=2), "n", "truncated") == [(1, True), (2, True)]


def test_ancestry_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "k int, p int")
    got = runs.ancestry(chain, "k", "p")
    assert got.count() == 199 * 200 // 2 and rows(got.where("k = 199 and depth in (1, 64, 199)")) == [(199, 0, 199), (199, 135, 64), (199, 198, 1)]
    assert runs.ancestry(chain.limit(0), "k", "p").count() == 0


def test_parameters():
    good = filters.parameters(project="0A0B0C0D-0000-1111-2222-333344445555", tags=" B,a,b", pr="2147483647", commit="ABCDEF1", since="2024-02-29", limit="100", zone="Europe/Berlin")
    assert good["project"].startswith("0a0b") and good["tags"] == ["b", "a"] and good["pr"] == 2**31 - 1 and good["commit"] == "abcdef1" and good["limit"] == 100
    bad = {"project": "0a0b", "tags": "a,,b", "pr": "2147483648", "commit": "xyz1234", "since": "2023-02-29", "limit": "101", "page": "0", "zone": "Mars/One", "branch": " ", "other": "x"}
    for name, text in bad.items():
        with pytest.raises(ValueError, match=name):
            filters.parameters(**{name: text})


def test_named_commits(spark):
    commits = spark.createDataFrame([("abcdef1000", 1), ("abcdef1", 2), ("bbbbbbb1", 3), ("bbbbbbb2", 4)], "sha string, n int")
    named = lambda p: rows(filters.commits_named(commits, p), "n")
    assert named("ABCDEF1") == [(2,)] and named("abcdef10") == [(1,)] and named("fff0000") == []
    with pytest.raises(Exception, match="more than one commit"):
        named("bbbbbbb")


def test_reassign_and_blocks(spark):
    s = spark.createDataFrame([(1, 7, "me"), (2, 7, "you"), (3, 8, "me"), (4, None, "me")], "id int, project_id int, user_id string")
    assert rows(upsert.reparent(s, 7, 9), "id", "project_id") == [(1, 9), (2, 9), (3, 8), (4, None)]
    assert rows(upsert.reparent(s, 7, 9, "me"), "id", "project_id") == [(1, 9), (2, 7), (3, 8), (4, None)]
    at = lambda x: None if x is None else datetime(2024, 1, 1, 0, 0, x)
    records = [(1, i, r, k, at(t)) for i, (r, k, t) in enumerate([("user", "message", 1), ("assistant", "message", 2), ("assistant", "toolCall", 5), ("user", "message", 6), ("assistant", None, None), ("assistant", "toolCall", 9)])]
    df = spark.createDataFrame(records, "s int, n int, role string, kind string, at timestamp")
    assert rows(runs.blocks(df, ["s"], "n"), "block", "first", "messages", "tool_calls", "duration_ms") == [(1, 1, 1, 1, 3000), (2, 4, 1, 1, None)]


def test_problems_are_replaced(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "review_id int, position int, title string")
    again = spark.createDataFrame([(1, [("x",)]), (3, [])], "review_id int, problems array<struct<title:string>>")
    assert rows(upsert.replace_problems(old, again)) == [(1, 0, "x"), (2, 0, "c")]


def test_upserts(spark):
    schema = "k int, a string, t int, o string"
    old = spark.createDataFrame([(1, "x", 5, "first"), (2, "y", 7, "first")], schema)
    new = spark.createDataFrame([(1, None, 3, "second"), (3, "z", 1, "second")], schema)
    assert rows(upsert.coalesce_upsert(old, new, ["k"], frozen=["o"], earliest=["t"])) == [(1, "x", 3, "first"), (2, "y", 7, "first"), (3, "z", 1, "second")]
    fresh, counts = upsert.insert_ignore(old, new.unionByName(new), ["k"], F.col("t"))
    assert rows(fresh, "k") == [(3,)] and counts.first().asDict() == {"ingested": 1, "deduped": 3}
    tags = spark.createDataFrame([(["b", "a", "b"],)], "t array<string>").select(upsert.rebuild_tags(F.col("t"), ["C", "a"], ["B"]).alias("t"))
    assert tags.first().t == ["a", "c"]


def test_decisions(spark):
    asks = [(1, i, d, "why", "me", 10) for i, d in enumerate(["skipped", "open", "skipped", "skipped", "open", "skipped", "accepted"])]
    asks += [(2, 1, "skipped", None, "me", 10), (3, 1, "rejected", "why", "me", 1), (4, 1, "open", None, "me", 1)]
    df = spark.createDataFrame(asks, "fix_id int, at int, decision string, reason string, by string, sessions long").withColumn("at", F.timestamp_seconds("at"))
    assert rows(decisions.replay(df), "fix_id", "decision", "reason", "skip_count", "returns_at") == [
        (1, "rejected", "Skipped 3 times", 3, None), (2, "skipped", None, 1, 20), (3, "rejected", "why", 0, None), (4, "open", None, 0, None),
    ]


def test_date_windows():
    now = datetime(2024, 3, 31, 12, tzinfo=UTC)
    assert filters.date_window("today", now, "Asia/Kolkata")[0] == datetime(2024, 3, 30, 18, 30, tzinfo=UTC)
    a, b = filters.date_window("custom", now, "Europe/Berlin", "2024-03-31", "2024-03-31")
    assert (b - a).total_seconds() == 23 * 3600  # the clocks go forward
    gone = filters.local_midnight(datetime(2024, 9, 8), "America/Santiago")  # this day has no midnight
    assert gone == datetime(2024, 9, 8, 4, tzinfo=UTC)


def test_schedules(spark):
    queue = spark.createDataFrame([(1, "waiting", 0, 3), (2, "waiting", 2, 1), (3, "running", 1, 0)], "id int, status string, attempts int, created_at int")
    taken = scheduling.claim(queue)
    assert rows(taken) == [(1, "waiting", 0, 3), (2, "running", 3, 1), (3, "running", 1, 0)]
    assert rows(scheduling.settle_failures(taken, taken.where("status = 'running'")), "id", "status") == [(1, "waiting"), (2, "failed"), (3, "waiting")]
    waits = spark.range(1, 9).select(scheduling.backoff_seconds(F.col("id"), 30, 3600).alias("w"))
    assert [r.w for r in waits.orderBy("w").collect()][-2:] == [1920.0, 3600.0]


def test_due_at_zone(spark):
    projects = spark.createDataFrame([(1, True, None), (2, False, None), (3, True, datetime(2024, 1, 2, 1))], "project_id int, auto_review boolean, last_nightly_pick_at timestamp")
    before, after = datetime(2024, 1, 1, 20, 29, tzinfo=UTC), datetime(2024, 1, 1, 20, 31, tzinfo=UTC)
    assert rows(scheduling.due_for_pick(projects, before, "Asia/Kolkata", "02:00"), "project_id") == []
    assert rows(scheduling.due_for_pick(projects, after, "Asia/Kolkata", "02:00"), "project_id") == [(1,)]


def test_git_facts(spark):
    out = "npm noise\n[feat/a+b (root-commit) 1a2b3c4] Say it \n 2 files changed, 1 insertion(+)\nhttps://h.io/o/r/pull/7 https://h.io/o/r/pull/7 https://g.x/a/b/-/merge_requests/9"
    df = spark.createDataFrame([(out,), ("nothing",), (None,)], "o string")
    got = df.select(git.commit_facts(F.col("o")).alias("c"), git.pull_requests(F.col("o")).alias("p")).collect()
    assert tuple(got[0].c) == ("feat/a+b", "1a2b3c4", "Say it", 2, 1, None) and got[1].c is None and got[2].c is None
    assert list(map(tuple, got[0].p)) == [("h.io", "o", "r", 7), ("g.x", "a", "b", 9)]


@pytest.mark.parametrize("command,commits,creates", [
    ("git commit -m x", True, False), ("cd a && git -v commit", True, False), ("grep 'git commit' f", False, False),
    ("bash -lc 'git commit -m y'", True, False), ("gh pr create --title T", False, True), ("gh pr view 3", False, False), ("/bin/sh -c \"glab mr create\"", False, True),
    ("zsh -l -c 'cd x;git -p commit'", True, False), ("sh --norc commit.sh", False, False), ("git log && echo commit", False, False), ("", False, False),
])
def test_commands(spark, command, commits, creates):
    df = spark.createDataFrame([(command,)], "c string").select(git.is_commit(F.col("c")).alias("a"), git.creates_pull_request(F.col("c")).alias("b"))
    assert tuple(df.first()) == (commits, creates)


def test_pull_request_flags(spark):
    command = "gh pr create --title 'Fix --base words' --head=me/x --base --body \"many\n--title lines\""
    df = spark.createDataFrame([(command,)], "c string").select(git.pull_request_flags(F.col("c")).alias("f"))
    assert tuple(df.first().f) == ("Fix --base words", None, "me/x")


def test_remote(spark):
    df = spark.createDataFrame([("git@h.io:o/r.git",), ("https://h.io/o/r/s",), ("file:///x",), ("https://h.io/o",), (None,)], "u string").select(git.remote(F.col("u")).alias("r"))
    assert [r.r and tuple(r.r) for r in df.collect()] == [("h.io", "o", "r"), ("h.io", "o", "r/s"), None, None, None]


def test_content(spark):
    raw = json.dumps({"b": [1, "x", None, True], "API-Key": "k", "a": {"Access_Token": {"deep": 1}, "z": "a\0b"}})
    df = spark.createDataFrame([(raw,), ("nope",), (None,)], "j string")
    got = df.select(content.redact("j").alias("r"), content.json_text("j").alias("t")).collect()
    assert json.loads(got[0].r) == {"b": [1, "x", None, True], "API-Key": "[Redacted]", "a": {"Access_Token": "[Redacted]", "z": "ab"}}
    hard = spark.createDataFrame([('{"x":"a\\\\u0000","y":"\\u0000\\u0000b"}',), ("[NaN]",)], "j string").select(content.redact("j").alias("r")).collect()
    assert [r.r for r in hard] == ['{"x":"a\\\\u0000","y":"b"}', None]
    assert got[0].t == "k\n1\na\0b\n1\nx" and got[1].r is None and got[2].t is None
    nested = spark.createDataFrame([('{"z":["first",{"b":"last"}],"a":7}',)], "j string").select(content.json_text("j").alias("t"))
    assert nested.first().t == "7\nfirst\nlast"


def test_references(spark):
    html = '<video poster = "p/v.jpg" width="3"> ](no.md) [x](mailto:me) [y](e(1).md "t") <img src="a%20b.png?x=1#y"> <a href="https://x.y">[t](docs/c+d.md) ![i](a%20b.png) <a data-src="no.js" HREF=\'#top\'>'
    df = spark.createDataFrame([(html,), (None,)], "h string").select(content.references(F.col("h")).alias("r"))
    assert [r.r for r in df.collect()] == [["p/v.jpg", "a b.png", "e(1).md", "docs/c+d.md"], []]


def test_evidence(spark):
    lines = ['msg-1 to msg-2 — "the "big" bug" — it fails', 'msg-3 - "x y" - why', "nothing", "msg-1 — msg-4 – “a — b” — c - d", 'msg-2 — "p" q" - r', "msg-1 msg-2 — x — y", None]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(content.evidence(F.col("l")).alias("e"))
    assert [r.e and tuple(r.e) for r in df.collect()] == [("msg-1", "msg-2", 'the "big" bug', "it fails"), ("msg-3", "msg-3", "x y", "why"), None, ("msg-1", "msg-4", "a — b", "c - d"), ("msg-2", "msg-2", 'p" q', "r"), None, None]
    records = spark.createDataFrame([(1, i, f"msg-{i}", t, None, None, None) for i, t in enumerate(["It  IS", "so\\nbroken", "ok"])], "session_id int, seq int, id string, text string, tool_name string, input string, output string")
    cited = [(1, 1, "msg-0", "msg-1", "is … so broken"), (1, 2, "msg-2", "msg-1", "ok"), (1, 3, "msg-0", "msg-9", "ok"), (1, 4, "msg-2", "msg-2", "“”"), (1, 5, "msg-2", "msg-2", "absent")]
    got = evidence.check(spark.createDataFrame(cited, "session_id int, item int, from string, to string, quote string"), records)
    assert [(r.item, r.failure) for r in got.orderBy("item").collect()] == [
        (1, None), (2, "msg-2 to msg-1: range runs backwards"), (3, "msg-0 to msg-9: no such message"), (4, "msg-2: quote is too short"), (5, "msg-2: quote is not there"),
    ]


def test_contained(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "xy"), (3, "beta gammas"), (4, "")], "d int, said string")
    quotes = spark.createDataFrame([(1, "pha beta gamma delta epsilon ze"), (2, "a beta g"), (3, "xy"), (4, "beta gamma"), (5, "no such words are in here")], "q int, quote string")
    assert rows(evidence.contained(quotes, "quote", texts, "said", ["d"]), "q", "d") == [(1, 1), (2, 1), (3, 2), (4, 1), (4, 3)]


M_ = "session_id string, pos long, track_id string, line int, ts timestamp, msg_type string, sub_type string, role string, content_type string, text string, call_id string, tool_name string, input string, output string, status string, command string, write_path string, tokens struct<input:long,output:long,cached:long,thinking:long>"


def message(pos, msg_type, **more):
    names = [c.split()[0] for c in M_.split(", ")][:17] + ["tokens"]
    values = {"session_id": "s", "pos": pos, "track_id": "main", "line": pos, "msg_type": msg_type} | more
    return tuple(values.get(n) for n in names)


@pytest.fixture(scope="module")
def session(spark):
    return spark.createDataFrame([
        message(1, "message", role="user", content_type="text", text="do\n it " + "x" * 200),
        message(2, "toolCall", call_id="c", tool_name="Edit", input='{"file_path":"/a"}', tokens=(1, 2, 3, 4)),
        message(3, "custom"), message(4, "toolResult", call_id="c", status="success", output='"fine"', write_path="/a"),
        message(5, "toolResult", call_id="c", status="failure", output='"again"'), message(6, "toolResult", call_id="lost", status="failure", output='"?"'),
        message(7, "toolCall", call_id="g", tool_name="Bash", command="git commit -m z"), message(8, "toolResult", call_id="g", status="success", output=json.dumps("[main 1234567] z\n 1 file changed, 3 deletions(-)")),
        message(9, "message", role="user", content_type="text", text="note", sub_type="systemReminder"),
        message(10, "toolResult", call_id="w", status="success", write_path="/b"),
    ], M_)


def test_export(session):
    got = export.session_export(session, full=True).orderBy("seq").collect()
    assert [(r.seq, r.id, r.msg_type, r.status, r.output) for r in got] == [
        (0, "msg-0", "message", None, None), (1, "msg-1", "toolCall", "success", '"fine"'), (2, "msg-2", "toolResult", "failure", '"?"'),
        (3, "msg-3", "toolCall", "success", got[3].output), (4, "msg-4", "message", None, None), (5, "msg-5", "toolResult", "success", None),
    ]
    assert export.session_export(session).orderBy("seq").first().text == "do it " + "x" * 94 + "…"


def test_review_events(session):
    got = export.review_events(session).orderBy("seq").collect()
    assert [(r.kind, r.name, r.path) for r in got] == [
        ("userMessage", None, None), ("toolCall", "Edit", None), ("edit", None, "/a"), ("tokens", None, None), ("toolResult", "Edit", None),
        ("toolResult", "Edit", None), ("toolResult", None, None), ("toolCall", "Bash", None), ("toolResult", "Bash", None), ("userMessage", None, None),
        ("toolResult", None, None), ("edit", None, "/b"),
    ]


def test_git_events(session):
    got = export.git_events(session).collect()
    assert [(r.kind, r.call_id, r.sha, r.files_changed, r.insertions, r.deletions) for r in got] == [("commit", "g", "1234567", 1, None, 3)]


def test_timeline(session):
    got = export.timeline(session).orderBy("pos").collect()
    assert [(r.pos, r.kind) for r in got] == [(1, "prompt"), (2, "tool"), (3, "event"), (6, "tool"), (7, "tool"), (9, "injection"), (10, "tool")]


def test_shorten(spark):
    text = "a" * 1_000 + "\n" + "b" * 900 + "\nERROR here\n" + "c" * 1_000 + "z" * 1_000
    out = spark.createDataFrame([(text,), ("short",)], "t string").select(export.shorten(F.col("t"), True).alias("s")).collect()
    assert "ERROR here" in out[0].s and out[0].s.endswith("z" * 1_000) and len(out[0].s) < 2_200 and out[1].s == "short"


def test_leads(spark):
    schema = "session_id int, seq int, id string, track string, msg_type string, role string, origin string, tool_name string, status string, text string, input string, output string, ts long"
    r = lambda i, *x: (1, i, f"msg-{i}", "main", *x, i * 1_000 if i < 5 else 900_000 + i)
    records = spark.createDataFrame([
        r(0, "message", "user", None, None, None, "please", None, None), r(1, "message", "assistant", None, None, None, "Which one?", None, None),
        *[r(i, "toolCall", None, None, "Bash", "failure", None, "ls", "x") for i in (2, 3, 4)], r(5, "message", "user", "human", None, None, "[Request interrupted by user]", None, None),
    ], schema)
    got = leads.find_leads(records).orderBy(F.substring("lead", 2, 5).cast("int")).collect()
    assert [(x.lead, x.section) for x in got] == [
        ("L1", "Human messages"), ("L2", "Interrupts"), ("L3", "Questions the agent asked"), ("L4", "Tool failures"), ("L5", "Tool failures"), ("L6", "Tool failures"),
        ("L7", "Tool failures"), ("L8", "Repeated calls"), ("L9", "Gaps over 5 minutes"),
    ]
    assert got[3].line == "Bash failed 3 times: msg-2, msg-3, msg-4" and got[7].line == "Bash ×3: msg-2, msg-3, msg-4 — ls"


def test_versions(spark):
    df = spark.createDataFrame([("1.10.0",), ("1.9.0",), ("1.10.0-rc.2",), ("1.10.0-rc.10",), ("1.10.0-alpha",), ("odd",), (None,), ("1.10.0+b",)], "v string")
    got = [r.v for r in df.orderBy(read.version_key(F.col("v")).asc_nulls_last(), "v").collect()]
    assert got == ["odd", "1.9.0", "1.10.0-alpha", "1.10.0-rc.2", "1.10.0-rc.10", "1.10.0", "1.10.0+b", None]


def test_anchors(spark):
    records = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 2, 20.0), (2, 0, 5.0)], "session_id int, pos int, at double")
    branches = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (2, "c", 1.0)], "session_id int, branch string, start double")
    assert rows(read.branch_anchors(records, branches), "branch", "anchor") == [("a", 1), ("b", None), ("c", 0)]


def test_calls_with_results(spark):
    calls = spark.createDataFrame([("s", "c", 1), ("t", "c", 1)], "session_id string, tool_id string, line int")
    results = spark.createDataFrame([("s", "c", 3, "failure", "b"), ("s", "c", 2, "success", "a")], "session_id string, tool_id string, line int, status string, text string")
    assert rows(read.calls_with_results(calls, results), "session_id", "status", "result") == [("s", "success", "a"), ("t", None, None)]
