"""Projects, members and synchronisation: customers are users, nations projects, regions organisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert
from ..operators.read import roll_up, settled_owner, user_project_status
from .registry import load, query


@query("""
SELECT n_nationkey AS project_id, n_name AS name, count(o_orderkey) AS session_count, max(o_orderdate) AS last_activity_at
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def project_summary(spark, sf_dir):
    """Sessions and last activity of each project, idle ones last."""
    nation, customer, orders = (load(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("project_id"), "o_orderkey", "o_orderdate")
    projects = nation.select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    out = roll_up(projects, placed, "project_id", session_count=F.count("o_orderkey"), last_activity_at=F.max("o_orderdate"))
    return out.withColumn("session_count", F.coalesce("session_count", F.lit(0))).orderBy(F.col("last_activity_at").desc_nulls_last(), "project_id")


@query("""
WITH counted AS (SELECT r_regionkey AS org_id, r_name AS name, n_nationkey, count(c_custkey) AS n
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT org_id, name, count(n_nationkey) AS projects, sum(n)::BIGINT AS sessions FROM counted GROUP BY ALL
""")
def org_rollup(spark, sf_dir):
    """Projects of each organisation and the sum of their sessions."""
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    orgs = region.select(F.col("r_regionkey").alias("org_id"), F.col("r_name").alias("name"))
    held = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    projects = nation.join(held, "n_nationkey", "left").select(F.col("n_regionkey").alias("org_id"), "n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))
    out = roll_up(orgs, projects, "org_id", projects=F.count("n_nationkey"), sessions=F.sum("n"))
    return out.fillna(0, ["projects", "sessions"])


@query("""
WITH seen AS (SELECT o_custkey AS user_id, o_orderpriority AS version, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen,
         count(*) AS n FROM orders GROUP BY ALL),
latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen DESC, version) AS r, sum(n) OVER (PARTITION BY user_id) AS total FROM seen)
SELECT c_custkey AS user_id, c_nationkey AS project_id, coalesce(total, 0)::BIGINT AS session_count, version, first_seen, last_seen
FROM customer LEFT JOIN latest ON user_id = c_custkey AND r = 1
""")
def sync_status(spark, sf_dir):
    """For each member of a project: sessions, current client version, and when that was first and last seen."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    pairs = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"))
    seen = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("version"), F.col("o_orderdate").alias("at"))
    return user_project_status(pairs, seen)


@query("""
SELECT l_orderkey AS remote, min(l_suppkey) AS owner FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1
""")
def settled_owners(spark, sf_dir):
    """Repositories that all who name an owner agree on."""
    lines = load(spark, sf_dir, "lineitem")
    return settled_owner(lines.select(F.col("l_orderkey").alias("remote"), F.col("l_suppkey").alias("owner")), ["remote"], "owner")


@query("""
SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) AS survivor FROM part
""")
def case_folded_survivor(spark, sf_dir):
    """For each repository the first of its case-folded identity."""
    part = load(spark, sf_dir, "part")
    least = part.groupBy(F.lower("p_brand").alias("a"), F.lower("p_type").alias("b")).agg(F.min("p_partkey").alias("survivor"))
    named = part.select("p_partkey", F.lower("p_brand").alias("a"), F.lower("p_type").alias("b"))
    return named.join(least, ["a", "b"]).select("p_partkey", "survivor")


@query("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def first_last_seen(spark, sf_dir):
    """First and last sighting of each client version of a user."""
    return upsert.first_last_seen(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
