import json

from pyspark.sql import functions as F

from trailmark.operators import artifacts, reviews

GOOD = """# Review
- **Outcome:** Struggled

## Summary
It took
long.

## Problems
### Tests were not run
- **Class:** missed
- **Severity:** high — it broke
  the build
- **Fix type:** skill
- **Description:** Nothing ran.
  It should have.
- **Evidence:** msg-1 to msg-2 — "all "done" now" — wrong
- **Learning:** Run them.
- **Extra:** Stage: coder; tool: bash; zsh

### Listed
- **Class:** slow
- **Severity:** low — minor
- **Fix type:** code
- **Description:** d
- **Evidence:**
  - msg-3 — "x y" — w
  - msg-4 — "z" — w
- **Learning:** l

### Bad one
- **Class:** odd
- **Evidence:** nothing here
"""


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def test_parse(spark):
    texts = [(1, GOOD), (2, "- **Outcome:** shipped\n\n## Summary\nFine\n\n## Problems\nNothing to change.\n"), (3, "- **Outcome:** shipped\n## Summary\ns\n## Problems\nlater"), (4, None), (5, "## Summary\nx")]
    heads, problems = reviews.parse(spark.createDataFrame(texts, "review_id int, markdown string"), required=("stage",))
    assert rows(heads, "review_id", "outcome", "error") == [(1, "struggled", None), (2, "shipped", None), (3, "shipped", "no problem and not said so"), (4, None, "outcome"), (5, None, "outcome")]
    assert heads.where("review_id = 1").first().summary == "It took\nlong."
    got = problems.orderBy("position").collect()
    one = got[0]
    assert (one.title, one["class"], one.severity, one.severity_reason, one.fix_type) == ("Tests were not run", "missed", "high", "it broke the build", "skill")
    assert one.description == "Nothing ran. It should have." and one.drops == []
    assert [tuple(e) for e in one.evidence] == [("msg-1", "msg-2", 'all "done" now', "wrong")]
    assert one.extra == {"stage": "coder", "tool": "bash; zsh"}
    assert [e["from"] for e in got[1].evidence] == ["msg-3", "msg-4"] and got[1].drops == ["extra stage missing"]
    assert {"class", "severity", "learning", "evidence cannot be read"} <= set(got[2].drops)
    count = reviews.histograms(problems.withColumn("session_id", F.lit(1)), ["review_id"]).first()
    assert (count.problems, count.sessions, count.times, count.severity_high, count.class_slow) == (3, 1, 3, 1, 1)


def test_writes(spark):
    schema = "session_id int, path string, created boolean, base string, at timestamp, pos int"
    df = spark.createDataFrame([(1, p, c, b, None, i) for i, (p, c, b) in enumerate([
        ("a", False, None), ("a", False, "one"), ("a", False, "two"), ("b", True, None), ("b", False, "own"), ("c", False, "old"), ("c", True, "x"),
    ])], schema)
    assert rows(artifacts.writes(df)) == [(1, "a", False, "one"), (1, "b", True, None), (1, "c", True, "old")]


def test_queue(spark):
    schema = "session_id int, path string, content string, created boolean, base string, attempts int, next_attempt_at int, at long"
    queue = spark.createDataFrame([(1, "a", "v1", False, "base", 3, 99, 1)], schema)
    fresh = spark.createDataFrame([(1, "a", "v2", False, "later", 0, None, 2), (1, "b", "w", True, None, 4, None, 3)], schema)
    out = artifacts.enqueue(queue, fresh)
    assert rows(out) == [(1, "a", "v2", False, "base", 3, 99, 2), (1, "b", "w", True, None, 4, None, 3)]
    done = spark.createDataFrame([(1, "a", 1)], "session_id int, path string, at long")  # changed meanwhile, so it stays
    failed = spark.createDataFrame([(1, "b", 3)], "session_id int, path string, at long")
    assert rows(artifacts.settle_uploads(out, done, failed), "path", "attempts") == [("a", 3)]


def test_closure_and_tree(spark):
    files = spark.createDataFrame([("a.md", "[x](b.md) [y](none.md)"), ("b.md", "[z](a.md) ![i](c/d.png)"), ("c/d.png", None), ("e.md", "")], "path string, content string")
    start = spark.createDataFrame([("a.md",)], "path string")
    assert rows(artifacts.closure(start, files)) == [("a.md",), ("b.md",), ("c/d.png",)]
    paths = spark.createDataFrame([("src/core/x/a.ts",), ("src/core/x/b.ts",), ("z.md",), ("d/e.md",), ("d/f/g.md",)], "path string")
    assert list(map(tuple, artifacts.tree(paths).collect())) == [
        ("", "d", True), ("", "src/core/x", True), ("", "z.md", False), ("d", "f", True), ("d", "e.md", False), ("d/f", "g.md", False),
        ("src/core/x", "a.ts", False), ("src/core/x", "b.ts", False),
    ]


def test_inputs_and_listing(spark):
    df = spark.createDataFrame([(json.dumps({"path": "p", "command": "ls\n -l"}),), ("{}",), ("no",), (None,)], "j string").select(artifacts.summarise_input(F.col("j")).alias("s"))
    assert [r.s for r in df.collect()] == ["ls -l", "", "", ""]
    files = spark.createDataFrame([("a", b"h\xc3\xa4", None, False), ("b", b"\0", b"x", True)], "path string, content binary, base binary, is_binary boolean")
    assert rows(artifacts.listing(files)) == [("a", 3, False, "hä"), ("b", 1, True, None)]
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([300, 200, 1, 700])], "k int, n int, size int")
    assert [r.pack for r in artifacts.chunks(sizes, ["k"], ["n"], "size").orderBy("n").collect()] == [0, 0, 1, 2]
