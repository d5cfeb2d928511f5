"""Capture and review queries: what was acknowledged, rolled back, paged, transformed, packed, shown and settled."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chains, evidence, reviews, runs, transform
from ..sources import histories
from ..streaming import acks, ingest, results
from ..tables import folder
from .registry import load, portions, query

_SENT = """
chunks AS (SELECT l_orderkey AS track, l_linenumber AS chunk, l_linenumber * 500 AS last_line, NOT (l_returnflag = 'R' AND l_quantity < 15) AS ok FROM lineitem),
stops AS (SELECT *, min(chunk) FILTER (NOT ok) OVER (PARTITION BY track) AS stop FROM chunks),
sent AS (SELECT track, max(last_line) FILTER (stop IS NULL OR chunk < stop) AS sent_through, count(*) FILTER (stop IS NULL OR chunk < stop) AS chunks, bool_and(stop IS NULL) AS whole
  FROM stops GROUP BY track)
"""


def _sent(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("chunk"), (F.col("l_linenumber") * 500).alias("last_line"),
        (~((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 15))).alias("ok"),
    )
    return acks.acknowledged(lines, ["track"])


@query(f"WITH {_SENT} SELECT track, sent_through, chunks, whole FROM sent")
def acknowledged_prefix(spark, sf_dir):
    """How far each track was acknowledged: its chunks before the first that failed."""
    return _sent(spark, sf_dir).select("track", "sent_through", "chunks", "whole")


@query(f"""
WITH RECURSIVE {_SENT},
tracks AS (SELECT o_orderkey AS track, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey // 3 END AS parent, sent.track IS NOT NULL AND sent_through IS NULL AS failed
  FROM orders LEFT JOIN sent ON sent.track = o_orderkey),
up AS (SELECT t.track, p.track AS above, p.parent AS further, p.failed FROM tracks t JOIN tracks p ON p.track = t.parent AND t.track <> p.track
  UNION ALL SELECT up.track, p.track, p.parent, p.failed FROM up JOIN tracks p ON p.track = up.further AND up.above <> p.track)
SELECT t.track, count(above)::BIGINT AS wave, coalesce(bool_or(up.failed), false) AS held FROM tracks t LEFT JOIN up ON up.track = t.track GROUP BY t.track
""")
def held_back_tracks(spark, sf_dir):
    """Parents go first, and below one of which nothing was acknowledged nothing goes."""
    # track 0 would be its own parent, but is a multiple of seven
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("track"), F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_orderkey") / 3)).alias("parent")
    )
    sent = _sent(spark, sf_dir).select("track", F.col("sent_through").isNull().alias("failed"))
    return acks.waves(orders.join(sent, "track", "left"), "track", "parent", "failed").select("track", "wave", "held")


_ITEMS = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""
WITH old AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEMS}) AS place FROM lineitem),
new AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ITEMS}) AS place FROM lineitem WHERE l_quantity < 46),
met AS (SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.place, n.place) AS place, o.l_partkey AS was, n.l_partkey AS now,
  o.place IS NULL OR n.place IS NULL OR o.l_partkey <> n.l_partkey AS differs FROM old o FULL JOIN new n ON n.l_orderkey = o.l_orderkey AND n.place = o.place),
ends AS (SELECT l_orderkey, min(place) FILTER (differs) AS stop FROM met GROUP BY l_orderkey)
SELECT l_orderkey, place::INT AS place, was AS l_partkey, CASE WHEN stop IS NULL OR place < stop THEN 'kept' ELSE 'withdrawn' END AS fate FROM met JOIN ends USING (l_orderkey) WHERE was IS NOT NULL
UNION ALL SELECT l_orderkey, place::INT, now, 'fresh' FROM met JOIN ends USING (l_orderkey) WHERE now IS NOT NULL AND place >= stop
""")
def rolled_back_items(spark, sf_dir):
    """Items of two readings of each list: those before the first difference stay, the rest was rolled back."""
    lines = load(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ITEMS.split(", ")))
    old, new = (rows.select("l_orderkey", place.alias("place"), "l_partkey") for rows in (lines, lines.where("l_quantity < 46")))
    return histories.reconciled(old, new, ["l_orderkey"], "place", "l_partkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders")
def pages_in_order(spark, sf_dir):
    """Pages landed in any order, put in the order of their cursors."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("cursor"), F.when(F.lead("o_orderkey").over(w).isNotNull(), F.col("o_orderkey")).alias("next")
    )
    return chains.pages_in_order(pages, ["o_custkey"], "cursor", "next").select("o_custkey", "o_orderkey", "page")


_CHANGES = """
once AS (SELECT conv_id, turn, role, regexp_replace(text, '[ ]+$', '') AS t1, text FROM conversations),
twice AS (SELECT *, CASE WHEN role = 'user' AND ends_with(t1, '.') THEN 'statement' END AS sub FROM once)
"""


def _transformed(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("sub_type", F.lit(None).cast("string"))
    steps = [
        transform.Transformer("trailing", "text", F.regexp_replace("text", " +$", "")),
        transform.Transformer("statement", "sub_type", F.when((F.col("role") == "user") & F.col("text").endswith("."), "statement").otherwise(F.col("sub_type"))),
    ]
    return transform.transformed(rows, steps)


@query(f"WITH {_CHANGES} SELECT conv_id, turn, role, t1 AS text, sub AS sub_type FROM twice")
def transformed_messages(spark, sf_dir):
    """Messages after two transformers, the second of which reads what the first made."""
    return _transformed(spark, sf_dir)[0].select("conv_id", "turn", "role", "text", "sub_type")


@query(f"WITH {_CHANGES} SELECT count(*) AS rows, count(*) FILTER (t1 IS DISTINCT FROM text) AS trailing, count(*) FILTER (sub IS NOT NULL) AS statement FROM twice")
def transformer_counts(spark, sf_dir):
    """How many rows each transformer changed, seen while the rows are written."""
    rows, seen = _transformed(spark, sf_dir)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "rows long, trailing long, statement long")


_RECORDS = """
records AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id % 3 AS track, event_type <> 'view' AS filled, event_type FROM events),
cited AS (SELECT user_id, seq AS item, seq AS first, seq + item_len AS last FROM (SELECT *, seq % 3 AS item_len FROM records) WHERE event_type = 'error')
"""


def _records(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return load(spark, sf_dir, "events").select(
        "user_id", seq.cast("long").alias("seq"), (F.col("event_id") % 3).alias("track"), (F.col("event_type") != "view").alias("filled"), "event_type"
    )


@query(f"""
WITH {_RECORDS},
heads AS (SELECT c.*, r.track FROM cited c JOIN records r ON r.user_id = c.user_id AND r.seq = c.first),
near AS (SELECT h.user_id, h.item, r.seq, row_number() OVER (PARTITION BY h.user_id, h.item, r.seq > h.last ORDER BY abs(r.seq - h.first)) AS far
  FROM heads h JOIN records r ON r.user_id = h.user_id AND r.track = h.track AND r.filled AND (r.seq < h.first OR r.seq > h.last)),
inside AS (SELECT c.user_id, c.item, r.seq, r.filled, bool_or(r.filled) OVER (PARTITION BY c.user_id, c.item) AS any_filled FROM cited c JOIN records r ON r.user_id = c.user_id AND r.seq BETWEEN c.first AND c.last)
SELECT user_id, item, seq, false AS cited FROM near WHERE far <= 2 UNION ALL SELECT user_id, item, seq, true FROM inside WHERE filled OR NOT any_filled
""")
def evidence_context(spark, sf_dir):
    """What is shown of each citation: its records, and two filled ones of the same track on each side."""
    records = _records(spark, sf_dir)
    cited = records.where("event_type = 'error'").select("user_id", F.col("seq").alias("item"), F.col("seq").alias("first"), (F.col("seq") + F.col("seq") % 3).alias("last"))
    return runs.context(cited, records, ["user_id"])


@query("""
WITH cited AS (SELECT conv_id, conv_id * 2 + turn % 2 AS problem, turn AS first, turn + length(text) % 3 AS last FROM conversations WHERE role = 'user' AND turn % 3 = 0),
ends AS (SELECT conv_id, max(turn) AS e FROM conversations GROUP BY conv_id),
wide AS (SELECT conv_id, problem, greatest(0, first - 1) AS a, least(e, last + 1) AS b FROM cited JOIN ends USING (conv_id)),
hit AS (SELECT DISTINCT w.conv_id, w.problem, c.turn, '[msg-' || c.turn || '] ' || c.role || ':' || chr(10) || c.text AS line FROM wide w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn BETWEEN a AND b),
islands AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, problem ORDER BY turn) AS isle,
  coalesce(sum(length(line)) OVER (PARTITION BY conv_id, problem ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 900 AS kept FROM hit)
SELECT conv_id, problem, min(turn) AS first, max(turn) AS last, count(*) FILTER (kept) AS n, coalesce(sum(length(line)) FILTER (kept), 0)::BIGINT AS chars,
  coalesce(string_agg(line, chr(10) || chr(10) ORDER BY turn) FILTER (kept), '') AS text, bool_or(NOT kept) AS cut FROM islands GROUP BY conv_id, problem, isle
""")
def problem_excerpts(spark, sf_dir):
    """The records around what each problem cites, overlapping ranges as one, up to a budget of characters."""
    said = load(spark, sf_dir, "conversations")
    problem = F.col("conv_id") * 2 + F.col("turn") % 2
    cited = said.where("role = 'user' and turn % 3 = 0").select(
        F.col("conv_id").alias("session_id"), problem.alias("problem"), F.col("turn").alias("first"), (F.col("turn") + F.length("text") % 3).alias("last")
    )
    line = F.concat(F.lit("[msg-"), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(":\n"), "text")
    made = evidence.excerpts(cited, said.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), line.alias("line")), reach=1, budget=900)
    return made.select(F.col("session_id").alias("conv_id"), "problem", "first", "last", "n", "chars", "text", "cut")


@query("""
WITH RECURSIVE sized AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
filled AS (SELECT l_orderkey, i, n AS held, 0 AS pack FROM sized WHERE i = 1
  UNION ALL SELECT s.l_orderkey, s.i, CASE WHEN f.held > 0 AND f.held + s.n > 60 THEN s.n ELSE f.held + s.n END, f.pack + (f.held > 0 AND f.held + s.n > 60)::INT
  FROM filled f JOIN sized s ON s.l_orderkey = f.l_orderkey AND s.i = f.i + 1)
SELECT l_orderkey, l_linenumber, l_partkey, pack FROM filled JOIN sized USING (l_orderkey, i)
""")
def request_chunks(spark, sf_dir):
    """Records of a track in requests of at most sixty messages, the track's order kept."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_quantity").repartition(portions(spark, sf_dir, "lineitem"), "l_orderkey")
    made = runs.pack(lines, ["l_orderkey"], order, "l_quantity", 60)
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "pack")


_RESULTS = """
runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'waiting' END AS status, 1 + o_custkey % 3 AS attempts FROM orders),
results AS (SELECT l_orderkey AS run_id, 1 + l_partkey % 3 AS attempt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS arrival,
  CASE WHEN l_returnflag = 'R' THEN 'broken' END AS error, l_linestatus AS outcome, l_suppkey % 3 AS n FROM lineitem),
judged AS (SELECT t.*, CASE WHEN r.run_id IS NULL THEN 'unknown' WHEN status <> 'running' THEN 'not running' WHEN attempt <> attempts THEN 'other attempt' END AS why FROM results t LEFT JOIN runs r USING (run_id)),
told AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY run_id, why IS NULL ORDER BY arrival) > 1 THEN 'repeated' ELSE why END AS reason FROM judged)
"""


def _reviewed(spark, sf_dir):
    """(runs, problems, results, partitions) of the review queries; runs and results are dealt by run."""
    parts = portions(spark, sf_dir, "lineitem", "orders")
    none = F.lit(None).cast("string")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("waiting")
    made = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), status.alias("status"), (1 + F.col("o_custkey") % 3).alias("attempts"), none.alias("outcome"), none.alias("summary"), none.alias("last_message_id")
    )
    arrival = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))
    problem = F.struct(F.col("l_partkey").alias("title"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    results = lines.repartition(parts, "l_orderkey").select(
        F.col("l_orderkey").alias("run_id"), (1 + F.col("l_partkey") % 3).alias("attempt"), arrival.alias("arrival"), F.when(F.col("l_returnflag") == "R", "broken").alias("error"),
        F.col("l_linestatus").alias("outcome"), none.alias("summary"), none.alias("last_message_id"),
        F.array_repeat(problem, (F.col("l_suppkey") % 3).cast("int")).alias("problems"),
    )
    had = made.where("run_id % 2 = 0").select(F.col("run_id").alias("review_id"), F.lit(0).alias("position"), F.lit(-1).cast("long").alias("title"))
    return made.repartition(parts, "run_id"), had, results, parts


@query(f"""
WITH {_RESULTS}, taken AS (SELECT * FROM told WHERE reason IS NULL),
after AS (SELECT r.run_id, CASE WHEN t.run_id IS NULL THEN status WHEN error IS NULL THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'waiting' END AS status, attempts,
  CASE WHEN error IS NULL THEN t.outcome END AS outcome, CASE WHEN t.run_id IS NOT NULL AND error IS NULL THEN n ELSE (r.run_id % 2 = 0)::INT END AS problems FROM runs r LEFT JOIN taken t USING (run_id))
SELECT run_id, status, attempts, outcome, problems::BIGINT AS problems FROM after
""")
def review_lifecycle(spark, sf_dir):
    """Runs and how many problems they have after results came back, late and repeated ones among them."""
    made, had, results, parts = _reviewed(spark, sf_dir)
    after, problems, _ = reviews.finish(made, had, results, parts=parts)
    held = problems.groupBy(F.col("review_id").alias("run_id")).agg(F.count("*").alias("problems"))
    return after.join(held, "run_id", "left").select("run_id", "status", "attempts", "outcome", F.coalesce("problems", F.lit(0)).alias("problems"))


@query(f"WITH {_RESULTS} SELECT run_id, attempt, arrival::INT AS arrival, reason FROM told WHERE reason IS NOT NULL")
def review_refusals(spark, sf_dir):
    """Results that change nothing, and why."""
    made, _, results, _ = _reviewed(spark, sf_dir)
    return reviews.refused(made, results)


@query("SELECT conv_id AS session_id, turn AS line, role, CASE WHEN conv_id % 5 = 0 THEN 'again: ' || text ELSE text END AS text FROM conversations WHERE conv_id % 5 <> 0 OR turn < 2")
def stored_messages(spark, sf_dir):
    """Messages after three batches: some, then all with those some again, then every fifth session read anew and shorter."""
    said = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("string").alias("line_uuid"), F.lit(0).alias("sub_index"), F.col("turn").alias("line"), "role", "text"
    )
    store = ingest.Store(spark, folder(spark, "store"), shards=16)
    again = said.where("session_id % 5 = 0")
    shorter = again.where("line < 2").withColumn("text", F.concat(F.lit("again: "), "text"))
    for batch, (rows, anew) in enumerate(((said.where("line % 2 = 0"), None), (said, None), (shorter, again.select("session_id")))):
        ingest.ingest_messages(store, rows, batch, anew, at="line")
        store.commit(batch)
    return store.read("messages", said.schema).select("session_id", "line", "role", "text")


_CALLS = """
said AS (SELECT user_id AS session_id, ((props->>'$.k')::INT % 10) AS call_id, event_type = 'click' AS is_call, ts, event_id FROM events WHERE event_type IN ('click', 'purchase')),
mark AS (SELECT max(epoch_us(ts)) // 1000 - 6 * 3600000 AS w FROM said),
near AS (SELECT said.*, w, lead(is_call) OVER o AS next_call, lead(ts) OVER o AS next_ts, lag(is_call) OVER o AS last_call, lag(ts) OVER o AS last_ts
  FROM said, mark WHERE epoch_us(ts) // 1000 < w WINDOW o AS (PARTITION BY session_id, call_id ORDER BY ts, event_id)),
judged AS (SELECT *, CASE WHEN is_call THEN CASE WHEN next_ts <= ts + INTERVAL 3 DAYS THEN CASE WHEN next_call THEN 'superseded' ELSE 'answered' END
    WHEN next_ts IS NOT NULL OR epoch_us(ts + INTERVAL 3 DAYS) // 1000 < w THEN 'unanswered' END
  WHEN last_call AND ts <= last_ts + INTERVAL 3 DAYS THEN NULL ELSE 'orphan' END AS outcome FROM near)
"""


@query(f"""
WITH {_CALLS}
SELECT session_id, call_id, CASE WHEN is_call THEN ts END AS call_at, CASE WHEN NOT is_call THEN ts WHEN outcome = 'answered' THEN next_ts END AS result_at, outcome
FROM judged WHERE outcome IS NOT NULL
""")
def late_results(spark, sf_dir):
    """Calls and the results that came for them, however late in the stream, as a stateful stream settles them."""
    shape = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(shape).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, so that a file will do
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "purchase", "result")
    said = events.select(
        F.col("user_id").alias("session_id"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("call_id"), kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )
    to = folder(spark, "results")
    results.run_through(said, to, timedelta(days=3), "6 hours")
    found = spark.read.parquet(f"{to}/rows")
    return found.select("session_id", "call_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("call_at", "result_at")], "outcome")
