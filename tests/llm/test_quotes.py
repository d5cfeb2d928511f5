import random
import re

from trailmark.llm import quotes


def depth(line):
    m = re.match(r"[ \t]*(>[> \t]*)", line)
    return m[1].count(">") if m else 0


def normal(text):
    text = re.sub(r"(?m)^[ \t]*(>[> \t]*)", "", text).lower()
    return re.sub(r"\s+", " ", text).strip(" ")


def plain(rows):
    parsed = []
    for conv, turn, role, text in rows:
        lines = re.split(r"\r?\n", text) if text is not None else []
        own = None if text is None else re.sub(r"^\s+|\s+\Z", "", "\n".join(x for x in lines if not depth(x)))
        runs = []
        for line in lines:
            d = depth(line)
            if runs and runs[-1][0] == d:
                runs[-1][1].append(line)
            else:
                runs.append((d, [line]))
        found = [(d, normal("\n".join(x)), tuple(y for y in map(normal, x) if y)) for d, x in runs if d]
        said, kept = set(), ()
        if own:
            said = {normal(x) for x in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]} - {""}
            kept = tuple(y for y in map(normal, own.split("\n")) if y)
        parsed.append((conv, turn, role, own, [f for f in found if f[1]], (said, kept)))
    links = {}
    for conv, turn, _, _, found, _ in parsed:
        for d, p, ls in found if conv is not None and turn is not None else ():
            sources = [
                t for c, t, _, _, _, (said, kept) in parsed if c == conv and t is not None and t < turn
                and (p in said or len(ls) > 1 and any(kept[i : i + len(ls)] == ls for i in range(len(kept))))
            ]
            links.setdefault((conv, turn), []).append((d, max(sources, default=None)))
    reply = {k: max((s for d, s in v if d == 1 and s is not None), default=None) for k, v in links.items()}
    out = []
    for conv, turn, role, own, _, _ in parsed:
        root, far = turn, 0
        while reply.get((conv, root)) is not None:
            root, far = reply[conv, root], far + 1
        v = links.get((conv, turn), [])
        out.append((conv, root, far, turn, role, own, len(v), sum(s is not None for _, s in v), reply.get((conv, turn))))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, reply_to long")
    return list(map(tuple, quotes.conversations(df).collect()))


def test_thread(spark):
    rows = [
        (1, 0, "user", "First question.\nSecond line.\n\nAnother paragraph"),
        (1, 1, "assistant", "> first   QUESTION.\n> Second line.\nAn answer"),
        (1, 2, "user", "> > First question.\n>> Second line.\n> An answer\n\nThanks, but why?"),
        (1, 3, "user", ">Another paragraph\nThis one too"),
        (1, 4, "assistant", "> never said\nhm"),
        (2, 0, "user", "An answer"), (2, 1, "user", "> Another paragraph\nelsewhere"), (2, 2, "user", " > An answer"),
    ]
    got = {(r[0], r[3]): r for r in run(spark, rows)}
    assert got[1, 2][1:3] == (0, 2) and got[1, 2][6:] == (2, 2, 1) and got[1, 2][5] == "Thanks, but why?"
    assert got[1, 3][8] == 0 and got[1, 4][6:] == (1, 0, None) and got[2, 1][8] is None and got[2, 2][8] == 0
    assert sorted(run(spark, rows), key=repr) == plain(rows)


def test_random_threads(spark):
    rnd = random.Random(2)
    lines = [f"line number {i}" for i in range(12)] + ["", "> ", "  spaced   LINE number 3"]
    rows = []
    for conv in range(6):
        for turn in range(12):
            text = "\n".join(rnd.choice(["", "", "> ", ">> ", "> > > "]) + rnd.choice(lines) for _ in range(rnd.randrange(6)))
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), text))
    rows += [(0, 3, "user", "line number 3"), (0, 3, "user", "line number 3"), (None, 2, "user", "> line number 1"),
             (3, None, "user", "> line number 1"), (4, 20, None, None), (4, 21, "user", "x\r\n> line number 2\r\ny")]
    got = run(spark, rows)
    assert sorted(got, key=repr) == plain(rows)
    threads = [r[:4] for r in got if None not in r[:4]]
    assert threads == sorted(threads)


def test_lines_out_of_a_paragraph(spark):
    """Quotes of some lines: out of one paragraph, over two, and around a quote that the original holds itself."""
    text = "a one\nb two\nc three\n\nd four\n\ne five"
    rows = [
        (1, 0, "user", text), (1, 1, "assistant", "> a one\n> b two\nmine\n> nothing\nyours"),
        (1, 2, "user", "> b two\n> c three\n>\n> d four\nok"), (1, 3, "user", "> mine\n> yours"),
        (1, 4, "user", "> b two\n> a one\nwrong order"), (1, 5, "user", "> a one\n> c three\ngap"), (2, 0, "user", "> a one\n> b two"),
    ]
    got = {(r[0], r[3]): r for r in run(spark, rows)}
    assert [got[1, t][8] for t in range(6)] == [None, 0, 0, 1, None, None] and got[2, 0][8] is None
    assert sorted(run(spark, rows), key=repr) == plain(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    from trailmark.llm import sql

    rnd = random.Random(5)
    said = [f"line {i}" for i in range(9)]
    rows = []
    for conv in range(5):
        for turn in range(10):
            start = rnd.randrange(8)
            mine = [rnd.choice(said) for _ in range(2)] + said[start : start + rnd.randrange(1, 4)]
            theirs = [f"> {x}" for x in said[rnd.randrange(8) :][: rnd.randrange(4)]]
            rows.append((conv, turn, "user", "\n".join(rnd.choice([theirs + mine, mine + theirs]))))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    want = duckdb.sql(sql.QUOTES_SQL.replace("FROM conversations", f"FROM '{tmp_path}/c/*.parquet'")).fetchall()
    got = run(spark, rows)
    assert sorted(got, key=repr) == sorted(want, key=repr) == plain(rows) and any(r[8] is not None for r in got)


def test_long_blanks_are_linear(spark):
    """A message of 1 MB of blanks: as fast as any other."""
    import time

    rows = [(1, 0, "user", "x" + " " * (1 << 20) + "y"), (1, 1, "user", "> x y\n" + "\n" * (1 << 18) + "z")]
    run(spark, rows[1:])
    began = time.perf_counter()
    got = {r[3]: r for r in run(spark, rows)}
    assert got[1][8] == 0 and got[1][5] == "z" and time.perf_counter() - began < 60


def test_hot_line_makes_no_pairs(spark):
    rows = [(1, t, "user", "yes\n> yes") for t in range(400)]
    got = run(spark, rows)
    assert sorted(r[8] if r[8] is not None else -1 for r in got) == list(range(-1, 399))


def test_empty_table(spark):
    assert run(spark, []) == []
