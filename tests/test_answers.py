from pyspark.sql import functions as F

from trailmark.operators import answers


def test_answers_of_leads(spark):
    text = "# x\n- L1: problem (kind: missed) — The  Title\n  - L2: dropped (no kind) — because\n- L3: one\n- L3: two\nL4: no dash\n- L5:\n- Lx: no"
    made = spark.createDataFrame([(text,), (None,)], "m string").select(answers.answers_of(F.col("m")).alias("a")).collect()
    assert [tuple(x) for x in made[0].a] == [("L1", "problem (kind: missed) — The  Title"), ("L2", "dropped (no kind) — because"), ("L3", "two"), ("L5", "")] and made[1].a == []


def test_leads_without_an_answer_that_holds(spark):
    lines = {
        "L1": "problem (kind: missed) — The  Title", "L2": "problem (kind: missed) — another", "L3": "problem — The Title", "L4": "dropped (no kind) — because",
        "L5": "dropped (exception: idle-gap) – lunch", "L6": "dropped (exception: boredom) — no", "L7": "dropped (no kind)", "L8": "kept",
        "L10": 'dropped (did not happen) — msg-3 — "please do not delete … the tests" — it did not', "L11": 'dropped (no kind) — msg-4 — "please do not delete" — other message',
        "L12": 'dropped (no kind) — msg-3 — "please do" — too short?', "L13": 'dropped (no kind) — msg-3 — "never said so at all" — no', "L14": 'dropped (no kind) — msg-3 — "please do not delete"',
    }
    leads = [("s", k, "msg-3" if int(k[1:]) >= 10 else None) for k in [*lines, "L9"]]
    made = answers.unaccounted(
        spark.createDataFrame(leads, "session_id string, lead string, msg_id string"),
        spark.createDataFrame([("s", "\n".join(f"- {k}: {v}" for k, v in lines.items()))], "session_id string, markdown string"),
        spark.createDataFrame([("s", "the title"), ("t", "another")], "session_id string, title string"),
        spark.createDataFrame([("s", "msg-3", 'Please do NOT "delete"\nall of the tests.')], "session_id string, id string, text string"),
    )
    why = {r.lead: r.why for r in made.collect()}
    none = "quote is not there"
    short = {} if len("please do") >= answers.QUOTE_MIN else {"L12": none}
    assert why == {"L2": "no such problem", "L3": "no such problem", "L6": "no case", "L7": "no case", "L8": "no case", "L9": "no answer", "L11": none, "L13": none, "L14": none, **short}
