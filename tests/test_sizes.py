"""What a task sorts does not grow with the tables."""

import os

from trailmark import tables
from trailmark.operators import upsert
from trailmark.plans import QUERIES



def test_portions_grow_with_files(spark, tmp_path):
    (tmp_path / "t").write_bytes(os.urandom(1000))
    assert tables.portions(spark, str(tmp_path / "t")) == spark.sparkContext.defaultParallelism
    (tmp_path / "t").write_bytes(b"x" * (9 * tables.PORTION + 1))
    assert tables.portions(spark, str(tmp_path / "t")) == 10


def test_problems_of_many_lines_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(tables, "PORTION", 10_000)
    plan = QUERIES["replace_problems"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "REPARTITION_BY_NUM" in plan
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "review_id int, position int, title string")
    again = spark.createDataFrame([(1,), (2,)], "review_id int")
    fresh = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], old.schema)
    assert sorted(tuple(r) for r in upsert.replace_problem_rows(old, again, fresh).collect()) == [(1, 0, "x"), (1, 1, "y"), (3, 0, "c")]


def test_reviews_read_results_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "PORTION", 10_000)
    plans = {q: QUERIES[q](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString() for q in ("review_lifecycle", "review_refusals")}
    assert "lineitem" not in plans["review_lifecycle"]  # results that count are written down before
    assert all("REPARTITION_BY_NUM" in plan for plan in plans.values())
