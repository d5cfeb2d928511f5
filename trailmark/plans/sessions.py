"""Session lists, details and facets: conversations are sessions, their turns messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.content import artifact_kind
from ..operators import filters, learning, read, runs, search
from ..operators.read import session_details, session_rows
from .registry import load, query

_SESSIONS = """
SELECT conv_id AS id, count(*) AS message_count, max(turn) AS last_active_at,
       left(trim(split_part(arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> ''), chr(10), 1)), 120) AS title,
       'complete' AS status
FROM conversations GROUP BY conv_id
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = load(spark, sf_dir, "conversations")
    return session_rows(messages.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), F.col("turn").alias("at"), "role", "text"))


@query(_SESSIONS + "ORDER BY last_active_at DESC, id")
def session_list_recent(spark, sf_dir):
    """Sessions, the newest active first."""
    return _sessions(spark, sf_dir).orderBy(*search.sort_keys("recent", False))


@query(f"SELECT * FROM ({_SESSIONS}) ORDER BY last_active_at, id DESC LIMIT 5 OFFSET 5")
def session_list_oldest(spark, sf_dir):
    """The second page of the exactly reversed order."""
    return search.page(_sessions(spark, sf_dir), search.sort_keys("oldest", False), number=2, limit=5)


@query("""
SELECT l_orderkey, l_suppkey, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, l_suppkey) AS r FROM (
    SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)) WHERE r = 1
""")
def dominant_repo(spark, sf_dir):
    """The repository (supplier) most of a session's (order's) messages touch; ties go to the first seen."""
    return runs.dominant(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber")


@query("""
SELECT o_orderkey AS session_id, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS input_tokens,
       coalesce(sum(l_linenumber), 0)::BIGINT AS output_tokens, count(l_orderkey) > 0 AS available
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def token_totals(spark, sf_dir):
    """Token sums of each session, zero where no message recorded any."""
    used = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").alias("output")
    )
    sums = used.groupBy("session_id").agg(F.sum("input").alias("i"), F.sum("output").alias("o"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).join(sums, "session_id", "left").select(
        "session_id", F.coalesce("i", F.lit(0)).alias("input_tokens"), F.coalesce("o", F.lit(0)).alias("output_tokens"),
        F.col("i").isNotNull().alias("available"),
    )


@query("""
WITH calls AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
SELECT o_orderkey AS session_id, count(l_orderkey) AS tool_calls,
       count(*) FILTER (l_returnflag = 'R') AS failures, count(DISTINCT l_linestatus) AS kinds,
       min(l_linenumber) AS first_line, max(l_linenumber) AS last_line
FROM orders LEFT JOIN calls ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def session_detail(spark, sf_dir):
    """Counts of calls, failures and kinds of a session's tool calls; sessions without any stay."""
    calls = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("failed"), F.col("l_linestatus").alias("tool_name"),
    )
    return session_details(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")), calls)


@query("""
SELECT l_linestatus || l_returnflag AS tool_name, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS failures
FROM lineitem GROUP BY 1
""")
def tool_histogram(spark, sf_dir):
    """Calls and failures by tool, the most called first."""
    rows = load(spark, sf_dir, "lineitem").withColumn("tool_name", F.concat("l_linestatus", "l_returnflag"))
    return rows.groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("failures")
    ).orderBy(F.col("calls").desc(), "tool_name")


@query("""
SELECT * FROM (SELECT DISTINCT 'lang' AS facet, lang AS value FROM documents
UNION ALL SELECT DISTINCT 'source', source FROM documents
UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders
UNION ALL SELECT DISTINCT 'role', role FROM conversations) WHERE value IS NOT NULL
""")
def facets_distinct(spark, sf_dir):
    """The values that a list can be filtered by."""
    out = filters.distinct_facets({"lang": F.col("lang"), "source": F.col("source")}, load(spark, sf_dir, "documents"))
    out = out.unionByName(filters.distinct_facets({"priority": F.col("o_orderpriority")}, load(spark, sf_dir, "orders")))
    return out.unionByName(filters.distinct_facets({"role": F.col("role")}, load(spark, sf_dir, "conversations"))).orderBy("facet", "value")


@query("""
SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE c_mktsegment = 'BUILDING' OR n_nationkey IN (3, 7) OR n_regionkey = 2
""")
def visibility_filter(spark, sf_dir):
    """Sessions that a viewer may see: owned, granted by project, or of a member's organisation."""
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    owned = placed.where("c_mktsegment = 'BUILDING'").select("o_orderkey")
    granted = placed.where(F.col("c_nationkey").isin(3, 7)).select("o_orderkey")
    member = placed.join(nation.where("n_regionkey = 2"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey")
    return filters.visible(orders, "o_orderkey", [owned, granted, member]).select("o_orderkey", "o_custkey")


@query("""
WITH grants AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS rank FROM customer),
members AS (SELECT c_custkey, c_nationkey, 2 AS rank FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT c_custkey AS user_id, c_nationkey AS project_id, ['viewer', 'editor', 'admin'][max(rank)] AS scope
FROM (SELECT * FROM grants UNION ALL SELECT * FROM members) GROUP BY 1, 2
""")
def authority_scope(spark, sf_dir):
    """The highest scope of a user in a project; organisation membership is worth editor."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"), "c_acctbal", "c_mktsegment")
    balance = F.col("c_acctbal")
    scope = F.when(balance < 0, "viewer").when(balance < 5000, "editor").otherwise("admin")
    return filters.authority(c.withColumn("scope", scope), c.where("c_mktsegment = 'MACHINERY'"))


@query("""
SELECT l_orderkey, string_agg(DISTINCT lower(l_returnflag), ',' ORDER BY lower(l_returnflag)) AS tags FROM lineitem
GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R')
""")
def tag_overlap_filter(spark, sf_dir):
    """Sessions that carry any of the wanted tags."""
    tagged = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.lower("l_returnflag"))).alias("tags"))
    return tagged.where(filters.any_tag(F.col("tags"), ["r"])).withColumn("tags", F.array_join("tags", ","))


@query("""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-12-31 18:30:00' AND o_orderdate < TIMESTAMP '1996-03-31 18:30:00'
""")
def activity_window(spark, sf_dir):
    """Sessions active on the days from 1996-01-01 to 1996-03-31 of a zone at +05:30."""
    from datetime import datetime, timezone

    now = datetime(1996, 6, 1, tzinfo=timezone.utc)
    bounds = filters.date_window("custom", now, "Asia/Kolkata", "1996-01-01", "1996-03-31")
    since, until = (F.lit(b.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for b in bounds)
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.where(filters.within(F.col("o_orderdate"), since, until))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 6)
OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 6) OR o_orderpriority = '1-URGENT'
""")
def repo_any_source(spark, sf_dir):
    """Sessions that a repository shows up in: by a message, by a commit or by a pull request."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sellers = load(spark, sf_dir, "supplier").where("s_nationkey = 6").select("s_suppkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    messages = lines.join(sellers, lines["l_suppkey"] == sellers["s_suppkey"], "left_semi").select("l_orderkey")
    buyers = load(spark, sf_dir, "customer").where("c_nationkey = 6").select("c_custkey")
    commits = orders.join(buyers, orders["o_custkey"] == buyers["c_custkey"], "left_semi").select("o_orderkey")
    return filters.visible(orders, "o_orderkey", [messages, commits, orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")]).select("o_orderkey")


@query("SELECT event_id, sha256(event_id::VARCHAR) AS sha FROM events WHERE sha256(event_id::VARCHAR) LIKE '6b86b27%'")
def commit_prefix(spark, sf_dir):
    """The rows of the one commit that a prefix of its hash names."""
    commits = load(spark, sf_dir, "events").select("event_id", F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("sha"))
    return filters.commits_named(commits, "6B86B27")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def review_missing(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def review_done(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels")
    return docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("""
SELECT o_custkey AS session_id, o_orderstatus AS analyzer, o_orderkey AS run_id FROM orders o
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND NOT EXISTS (
  SELECT 1 FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderstatus = o.o_orderstatus
  AND n.o_orderpriority IN ('1-URGENT', '2-HIGH') AND n.o_orderdate > o.o_orderdate)
""")
def shown_runs(spark, sf_dir):
    """Finished runs that no newer finished full run replaces."""
    o = F.col("o_orderpriority")
    done = F.when(o.isin("1-URGENT", "2-HIGH", "5-LOW"), "done").otherwise("waiting")
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("analyzer"), F.col("o_orderkey").alias("run_id"),
        done.alias("status"), (o == "5-LOW").alias("new_part_only"), F.col("o_orderdate").alias("created_at"),
    )
    return filters.shown_runs(rows).select("session_id", "analyzer", "run_id")


@query("""
WITH RECURSIVE up AS (
  SELECT p_partkey, (p_partkey // 3)::BIGINT AS ancestor, 1 AS depth FROM part WHERE p_partkey // 3 > 0
  UNION ALL SELECT p_partkey, (ancestor // 3)::BIGINT, depth + 1 FROM up WHERE ancestor // 3 > 0)
SELECT p_partkey, ancestor, depth::INT AS depth FROM up
""")
def recursive_ancestry(spark, sf_dir):
    """Every ancestor of every helper, with its distance."""
    nodes = load(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_partkey div 3, 0)").alias("parent"))
    return runs.ancestry(nodes, "p_partkey", "parent")


@query("""
WITH cited AS (SELECT conv_id, min(turn) - 2 AS a, max(turn) + 2 AS b FROM conversations WHERE role = 'assistant' AND length(text) > 300 GROUP BY conv_id),
near AS (SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS place,
         count(*) OVER (PARTITION BY c.conv_id) AS n FROM conversations c JOIN cited USING (conv_id) WHERE c.turn BETWEEN a AND b)
SELECT conv_id, turn, role, n > 100 AS truncated FROM near WHERE place <= 100
""")
def evidence_range(spark, sf_dir):
    """Messages within two lines of what a finding cites, a hundred at most with a flag."""
    messages = load(spark, sf_dir, "conversations")
    cited = messages.where("role = 'assistant' and length(text) > 300")
    return runs.around(cited, messages.select("conv_id", "turn", "role"), ["conv_id"], "turn", 2)


@query("""
WITH results AS (SELECT l_orderkey, l_suppkey, arg_min(l_returnflag, l_linenumber * 10000000 + l_partkey) AS status,
  arg_min(l_linestatus, l_linenumber * 10000000 + l_partkey) AS result FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT DISTINCT l.l_orderkey AS session_id, l.l_suppkey AS tool_id, status, result FROM lineitem l
LEFT JOIN results r ON r.l_orderkey = l.l_orderkey AND r.l_suppkey = l.l_suppkey
""")
def calls_with_results(spark, sf_dir):
    """Calls with their first result; lines that say N are calls without one."""
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("tool_id"), F.col("l_returnflag").alias("status"),
        F.col("l_linestatus").alias("text"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("line"),
    )
    return read.calls_with_results(lines.select("session_id", "tool_id").distinct(), lines.where("status <> 'N'"))


@query("""
SELECT o_orderkey AS session_id, o_orderpriority AS branch, min(l_linenumber) FILTER (l_shipdate > o_orderdate) AS anchor
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def branch_anchors(spark, sf_dir):
    """Where each branch of a session hangs on: the first message after its start."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    records = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("pos"), seconds("l_shipdate").alias("at"))
    branches = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("branch"), seconds("o_orderdate").alias("start"))
    return read.branch_anchors(records, branches).select("session_id", "branch", "anchor")


@query("""
SELECT l_orderkey AS session_id, coalesce(arg_max(l_partkey, (epoch_ms(l_shipdate) // 1000) * 100000000 + pos) FILTER (l_returnflag <> 'N'),
  arg_max(l_partkey, pos) FILTER (l_linestatus = 'O')) AS message_id
FROM (SELECT *, l_linenumber * 10000000 + l_partkey AS pos FROM lineitem) GROUP BY 1
""")
def last_message_read(spark, sf_dir):
    """The latest message of each session by time, else the last line of its main track."""
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("message_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("ts"), F.when(F.col("l_linestatus") == "O", "main").otherwise("agent:1").alias("track_id"),
        (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"),
    )
    return learning.last_read(rows.withColumn("line", F.col("pos")))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') THEN 'outside'
  WHEN regexp_matches(path, '(^|/)(\.env[^/]*|id_rsa|[^/]*\.(pem|key|p12|pfx))$') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('.ssh', '.aws', '.gnupg'))) > 0 THEN 'secret'
  WHEN len(list_filter(string_split(path, '/'), lambda x: x IN ('node_modules', '.git', 'dist', '__pycache__'))) > 0 THEN 'noise' END AS reason,
  CASE WHEN regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|mp3|mp4|mov|wav)$') THEN 'media'
  WHEN regexp_matches(lower(path), '\.(md|mdx|txt|rst|adoc|html|htm)$') THEN 'docs' ELSE 'code' END AS kind FROM p
""")
def artifact_kinds(spark, sf_dir):
    """What kind of file a path names, and why it must not be uploaded."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://[^/]*/([^?#]*)", 1).alias("path"))
    return pages.withColumns({"reason": filters.unsafe_path(F.col("path")), "kind": artifact_kind(F.col("path"), F.lit(False))})


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'P')
OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'P') OR o_orderpriority = 'P' OR o_orderstatus = 'P'
OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1)
""")
def branch_filter(spark, sf_dir):
    """Sessions that a branch (a letter of a status) shows up in: by a message, a commit, or a pull request's base or head."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    lines = load(spark, sf_dir, "lineitem")
    messages = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("branch"))
    commits = lines.select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_discount") == 0.1, "P").otherwise(F.col("l_linestatus")).alias("branch"))
    pulls = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("base_branch"), F.col("o_orderstatus").alias("head_branch"))
    return filters.on_branch(orders, "o_orderkey", messages, commits, pulls, "P").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def pull_request_filter(spark, sf_dir):
    """Sessions linked to the pull requests (suppliers) of a number."""
    pulls = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("number"))
    return filters.of_pull_request(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", pulls, 7)


@query(f"""
SELECT *, (SELECT count(*) FROM ({_SESSIONS})) AS total, ceil((SELECT count(*) FROM ({_SESSIONS})) / 7.0)::INT AS total_pages
FROM ({_SESSIONS}) ORDER BY last_active_at DESC, id LIMIT 7 OFFSET 7
""")
def session_page_counted(spark, sf_dir):
    """The second page of seven with the number of sessions and of pages."""
    return search.counted_page(_sessions(spark, sf_dir), search.sort_keys("recent", False), number=2, limit=7)


@query("""
SELECT c_name AS user_name, n_name AS project_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE contains(lower(c_name), '1') AND contains(lower(n_name), '_2')
""")
def sync_table_filter(spark, sf_dir):
    """Rows of the sync table whose user and project hold what was typed, in any case."""
    users = load(spark, sf_dir, "customer").select(F.col("c_name").alias("user_name"), F.col("c_nationkey").alias("n_nationkey"))
    projects = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project_name"))
    return filters.holding(users.join(projects, "n_nationkey").drop("n_nationkey"), "1", " _2 ")


@query("""
WITH lines AS (SELECT *, l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + l_quantity::BIGINT AS pos FROM lineitem),
marked AS (SELECT *, (l_returnflag <> 'N' AND NOT coalesce(lag(l_returnflag <> 'N') OVER w, false))::INT AS starts FROM lines
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
placed AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY pos) AS block FROM marked),
found AS (SELECT l_orderkey, block, min(pos) AS first, count(*) FILTER (l_linestatus = 'O') AS messages, count(*) FILTER (l_linestatus <> 'O') AS tool_calls,
  epoch_ms(arg_max(l_shipdate, pos)) - epoch_ms(arg_min(l_shipdate, pos)) AS span FROM placed WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT l_orderkey, block::BIGINT AS block, first, messages, tool_calls, CASE WHEN span >= 0 THEN span END AS duration_ms FROM found
""")
def block_statistics(spark, sf_dir):
    """Duration, messages and calls of every run of an assistant's records."""
    records = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr("l_linenumber * 1000000000000L + l_partkey * 10000000L + l_suppkey * 100L + cast(l_quantity as long)").alias("pos"), F.when(F.col("l_returnflag") != "N", "assistant").otherwise("user").alias("role"),
        F.when(F.col("l_linestatus") == "O", "message").otherwise("toolCall").alias("kind"), F.col("l_shipdate").cast("timestamp").alias("at"),
    )
    return runs.blocks(records, ["l_orderkey"], "pos")
