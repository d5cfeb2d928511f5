"""Problems, fixes and schedules: orders are sessions or problems, parts and nations what they belong to."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import decisions
from ..operators import learning, scheduling
from ..operators.read import in_domain_order
from .registry import load, query

AS_OF = datetime(1998, 8, 2, 6, tzinfo=timezone.utc)
_SIZES = ("MACHINERY", "BUILDING", "HOUSEHOLD")


@query("""
SELECT p_partkey AS learning_id, count(l_orderkey) AS problems, count(DISTINCT l_orderkey) AS sessions,
  min(l_shipdate) FILTER (l_returnflag = 'R') AS first_seen, max(l_shipdate) AS last_seen,
  count(DISTINCT l_orderkey) FILTER (l_shipdate >= TIMESTAMP '1998-07-26') AS recent_sessions
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
""")
def learning_rollup(spark, sf_dir):
    """Problems and sessions behind each fix, its window, and sessions of the last seven days."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("learning_id"), "l_orderkey", "l_shipdate", "l_returnflag")
    recent = F.col("l_shipdate") >= F.lit("1998-07-26").cast("timestamp_ntz")
    made = lines.groupBy("learning_id").agg(
        F.count("*").alias("problems"), F.count_distinct("l_orderkey").alias("sessions"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("first_seen"), F.max("l_shipdate").alias("last_seen"),
        F.count_distinct(F.when(recent, F.col("l_orderkey"))).alias("recent_sessions"),
    )
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("learning_id"))
    return parts.join(made, "learning_id", "left").fillna(0, ["problems", "sessions", "recent_sessions"])


@query("""
SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY
  CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END, c_mktsegment, c_custkey)::INT AS place FROM customer
""")
def priority_order(spark, sf_dir):
    """Fixes of a project by priority as listed, unlisted ones last."""
    from pyspark.sql.window import Window

    own = Window.partitionBy("c_nationkey").orderBy(*in_domain_order(F.col("c_mktsegment"), _SIZES), "c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.row_number().over(own).alias("place"))


@query("""
WITH earlier AS (SELECT o_custkey, max(o_orderdate) AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_custkey AS run_id, count(*) FILTER (finished IS NULL OR o_orderdate > finished) AS created,
  count(*) FILTER (o_orderdate <= finished) AS updated FROM orders o LEFT JOIN earlier e ON e.o_custkey = o.o_custkey GROUP BY 1
""")
def run_created_updated(spark, sf_dir):
    """Fixes that a run created (after the last finished run) and those that it updated."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderdate", "o_orderstatus")
    earlier = orders.where("o_orderstatus = 'F'").groupBy("run_id").agg(F.max("o_orderdate").alias("finished"))
    met = orders.join(earlier, "run_id", "left")
    return met.groupBy("run_id").agg(
        F.count_if(F.col("finished").isNull() | (F.col("o_orderdate") > F.col("finished"))).alias("created"),
        F.count_if(F.col("o_orderdate") <= F.col("finished")).alias("updated"),
    )


@query("""
WITH sessions AS (SELECT o_orderkey AS session_id, c_nationkey AS project_id, o_orderdate AS activity_at, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE n_regionkey <> 0 AND o_orderdate > TIMESTAMP '1998-05-04 06:00:00'),
news AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N' AND l_shipdate > TIMESTAMP '1998-07-01') AS typed FROM lineitem GROUP BY 1),
ready AS (SELECT s.*, o_orderstatus = 'O' AS fresh, (o_orderpriority = '1-URGENT' AND (o_orderstatus = 'O' OR o_orderstatus <> 'O')) AS ended
  FROM sessions s LEFT JOIN news ON l_orderkey = session_id WHERE o_orderstatus = 'O' OR coalesce(typed, 0) >= 1),
quiet AS (SELECT * FROM ready WHERE ended OR activity_at <= TIMESTAMP '1998-08-02 02:00:00'),
ranked AS (SELECT session_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY fresh DESC, ended DESC, activity_at, session_id)::INT AS rank, NOT fresh AS new_part_only FROM quiet)
SELECT session_id, project_id, rank, new_part_only FROM ranked WHERE rank <= 5
""")
def nightly_pick(spark, sf_dir):
    """Reviews to queue tonight, five at most a project: orders still open were never reviewed, the others
    were on 1998-07-01; urgent ones have a pull request that ended after that."""
    at = lambda x: F.lit(x).cast("timestamp")
    nation, customer, orders, lines = (load(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    projects = nation.select(F.col("n_nationkey").alias("project_id"), (F.col("n_regionkey") != 0).alias("auto_review"), F.lit(None).cast("timestamp").alias("last_nightly_pick_at"))
    sessions = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("session_id"), F.col("c_nationkey").alias("project_id"), F.col("o_orderdate").cast("timestamp").alias("activity_at")
    )
    done = orders.where("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").alias("run_id"), F.lit("own").alias("analyzer"), F.lit("done").alias("status"),
        at("1998-07-01").alias("created_at"), at("1998-07-01").alias("updated_at"), at("1998-07-01").alias("last_message_at"),
    )
    messages = lines.select(
        F.col("l_orderkey").alias("session_id"), F.when(F.col("l_returnflag") == "N", "user").otherwise("assistant").alias("role"),
        F.lit("message").alias("msg_type"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )
    ended = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("session_id"), F.lit("merged").alias("state"), at("1998-07-02").alias("closed_at"))
    return scheduling.nightly_pick(
        projects, sessions, done, messages, ended, as_of=AS_OF, analyzer="own", within_days=90
    ).select("session_id", "project_id", "rank", "new_part_only")


@query("""
SELECT c_custkey AS project_id FROM customer WHERE c_mktsegment <> 'FURNITURE'
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P'
  OR (o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-08-02 06:00:00' - (c_nationkey * 40 + 1) * INTERVAL 1 DAY)))
""")
def due_projects(spark, sf_dir):
    """Projects whose rhythm asks for a run: new problems, none open, none started within so many days."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    rhythm = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_nationkey") * 40 + 1)
    projects = customer.select(F.col("c_custkey").alias("project_id"), rhythm.alias("fix_run_every_days"))
    owned = orders.withColumn("project_id", F.col("o_custkey"))
    problems = owned.where("o_orderstatus = 'O'").select("project_id", F.lit(None).cast("long").alias("learning_run_id"))
    started = owned.where("o_orderstatus in ('F', 'P')").select(
        "project_id", F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at")
    )
    return scheduling.due_fix_runs(projects, problems, started, AS_OF).select("project_id")


@query("""
WITH RECURSIVE asks AS (
  SELECT o_custkey AS fix_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
    CASE o_orderstatus WHEN 'F' THEN 'skipped' WHEN 'O' THEN 'open' ELSE 'accepted' END AS decision FROM orders),
replay AS (
  SELECT fix_id, 0::BIGINT AS n, 'open' AS decision, 0 AS skips FROM (SELECT DISTINCT fix_id FROM asks)
  UNION ALL
  SELECT r.fix_id, a.n, CASE WHEN r.decision IN ('rejected', a.decision) THEN r.decision WHEN a.decision = 'skipped' AND r.skips >= 2 THEN 'rejected' ELSE a.decision END,
    CASE WHEN r.decision IN ('rejected', a.decision) OR a.decision <> 'skipped' THEN r.skips ELSE r.skips + 1 END
  FROM replay r JOIN asks a ON a.fix_id = r.fix_id AND a.n = r.n + 1)
SELECT fix_id, arg_max(decision, n) AS decision, arg_max(skips, n)::INT AS skip_count FROM replay GROUP BY fix_id
""")
def fix_decisions(spark, sf_dir):
    """Decisions on fixes after all requests in order; the third skip rejects for good."""
    status = F.col("o_orderstatus")
    asked = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fix_id"), F.struct("o_orderdate", "o_orderkey").alias("at"),
        F.when(status == "F", "skipped").when(status == "O", "open").otherwise("accepted").alias("decision"),
        F.lit(None).cast("string").alias("reason"), F.lit("someone").alias("by"), F.lit(0).cast("long").alias("sessions"),
    )
    # requests are numbered so that those of one instant keep an order
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("fix_id").orderBy("at"))
    asked = asked.withColumn("at", F.timestamp_seconds(at))
    return decisions.replay(asked).select("fix_id", "decision", "skip_count")


@query("""
SELECT l_partkey AS fix_id, count(DISTINCT l_orderkey) AS sessions, max(l_quantity) AS worst, sum(l_linenumber)::BIGINT AS evidence
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1 OR max(l_quantity) >= 40 OR sum(l_linenumber) >= 3
""")
def not_one_off(spark, sf_dir):
    """Groups of problems that are more than one session's small matter."""
    by = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fix_id")).agg(
        F.count_distinct("l_orderkey").alias("sessions"), F.max("l_quantity").alias("worst"), F.sum("l_linenumber").alias("evidence")
    )
    return by.where("sessions > 1 or worst >= 40 or evidence >= 3")


@query("""
WITH free AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT c_custkey AS group_id, CASE WHEN ids IS NULL THEN 'skipped' WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 'linked'
  WHEN c_mktsegment = 'FURNITURE' THEN 'dropped' WHEN c_nationkey = 0 THEN 'created' ELSE 'updated' END AS action,
  coalesce(array_to_string(ids, ','), '') AS problem_ids
FROM customer LEFT JOIN free ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def save_groups(spark, sf_dir):
    """What saving each group of problems does; problems of finished orders are marked already."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    ids = orders.groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_set("o_orderkey").alias("problem_ids"))
    segment = F.col("c_mktsegment")
    groups = customer.select(
        F.col("c_custkey").alias("group_id"), F.when(F.col("c_nationkey") != 0, F.col("c_custkey")).alias("learning_id"),
        F.when((segment == "BUILDING") | (F.col("c_acctbal") < 0), "link").when(segment == "FURNITURE", "drop").otherwise("learning").alias("verdict"),
    ).join(ids, "group_id")
    problems = orders.select(F.col("o_orderkey").alias("problem_id"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("learning_run_id"))
    known = customer.select(F.col("c_custkey").alias("learning_id"), F.when(F.col("c_acctbal") < 0, "rejected").otherwise("open").alias("decision"))
    out = learning.save_groups(groups, problems, known)
    return out.select("group_id", "action", F.array_join(F.transform("problem_ids", lambda x: x.cast("string")), ",").alias("problem_ids"))


@query("""
WITH own AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS active, bool_or(o_orderstatus = 'F') AS done FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
news AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT c_custkey AS session_id, CASE WHEN coalesce(active, false) THEN 'skip' WHEN NOT coalesce(done, false) THEN 'full'
  WHEN n.o_custkey IS NOT NULL THEN 'newPart' ELSE 'skip' END AS queue
FROM customer LEFT JOIN own o ON o.o_custkey = c_custkey LEFT JOIN news n ON n.o_custkey = c_custkey
""")
def review_batch(spark, sf_dir):
    """What asking for reviews does: a full one, one of the new part, or nothing."""
    orders = load(spark, sf_dir, "orders").withColumn("session_id", F.col("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    runs = orders.select("session_id", status.alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("own").alias("analyzer"))
    news = orders.where("o_orderdate >= timestamp_ntz '1998-01-01'").select("session_id")
    return learning.review_batch(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), runs, news, "own")


@query("""
SELECT c_custkey AS user_id, c_mktsegment AS slug, CASE WHEN c_nationkey % 2 = 0 THEN 'org' ELSE 'user' END AS owner_kind,
  CASE WHEN c_nationkey % 2 = 0 THEN 'o' || c_nationkey ELSE c_custkey::VARCHAR END AS owner_id, NOT (c_nationkey % 4 = 0) AS created FROM customer
""")
def find_or_create_project(spark, sf_dir):
    """The owner and project of each request: members of an even organisation ask for it, every second has one."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_nationkey", F.col("c_mktsegment").alias("slug"))
    name = F.concat(F.lit("Org"), "c_nationkey")
    members = c.where("c_nationkey % 2 = 0").select("user_id", F.upper(name).alias("org_slug"), F.concat(F.lit("o"), "c_nationkey").alias("org_id"))
    have = c.where("c_nationkey % 4 = 0").select("slug", F.lit("org").alias("owner_kind"), F.concat(F.lit("o"), "c_nationkey").alias("owner_id")).distinct()
    asked = c.select("user_id", name.alias("org_slug"), "slug")
    out = learning.find_or_create(asked, have.withColumn("project_id", F.concat_ws("/", "owner_id", "slug")), members)
    return out.select(F.col("user_id").cast("long").alias("user_id"), "slug", "owner_kind", "owner_id", "created")
