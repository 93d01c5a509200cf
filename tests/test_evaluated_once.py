"""Tables that are read several times are evaluated once, and wide rows move no more than they must."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from registry import QUERIES
from registry.base import derive
from snapmart.operators.datasets import stratified_folds
from snapmart.operators.features import multi_hot
from snapmart.operators.temporal import latest_before, one_per_group
from snapmart.plans.training import training_set

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_not_shuffled_for_keys_that_do_not_repeat(spark):
    # above the broadcast threshold as the planner estimates it
    rows = spark.range(3_000_000).select("id", F.array(F.lit("a")).alias("items"), F.lit(1).alias("wide"))
    assert "SortMergeJoin" not in plan(multi_hot(rows, "items", ["a", "b"], ["id"]))


def test_repeated_keys_still_share_their_items(spark):
    rows = spark.createDataFrame(
        [(1, ["a"]), (1, ["b"]), (2, ["b"]), (None, ["a"]), (None, ["b"]), (3, None)], "k long, items array<string>")
    found = sorted((r["k"] or 0, r["a"], r["b"]) for r in multi_hot(rows, "items", ["a", "b"], ["k"]).collect())
    assert found == [(0, 0, 1), (0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 0, 1), (3, 0, 0)]


def test_only_repeated_keys_are_ranked(spark):
    unique = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k long, t long, v string")
    assert "Window" not in plan(one_per_group(unique, ["k", "t"], [F.col("v").desc()]))
    twice = unique.unionByName(spark.createDataFrame([(1, 2, "w"), (1, 2, "yy")], unique.schema))
    found = one_per_group(twice, ["k", "t"], [F.col("v").desc()]).collect()
    assert sorted(map(tuple, found)) == [(1, 1, "x"), (1, 2, "yy"), (2, 1, "z")]


def test_as_of_join_without_repeated_dates_ranks_nothing(spark):
    left = spark.createDataFrame([(1, date(2020, 2, 1))], "k long, at date")
    right = spark.createDataFrame([(1, date(2020, 1, 1), "a"), (1, date(2020, 3, 1), "b")], "k long, t date, v string")
    found = latest_before(left, right, ["k"], "at", "t")
    assert "row_number" not in plan(found)
    assert [r["v"] for r in found.collect()] == ["a"]


def test_derived_sides_of_the_as_of_join_are_saved(spark):
    assert not any("lineitem" in f for f in QUERIES["q_asof_unmatched"](spark, SF).inputFiles())


def test_pairs_of_the_training_set_are_joined_once(spark):
    lines = derive(spark, SF, "shipped")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "snapshot_date"]
    data = training_set(lines.select(*keys, "l_quantity"), lines.select(*keys, "label"), keys)
    assert not any("lineitem" in f for f in data.inputFiles())


def test_queries_run_with_the_settings_of_the_library(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, "65535")
    QUERIES["q_silver_loan_book"](spark, SF)
    assert spark.conf.get(name) == "8000"


def test_folds_do_not_shuffle_the_hashes_of_all_rows(spark, monkeypatch):
    seen = []
    joined = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, *a, **k: seen.append(joined(self, *a, **k)) or seen[-1])
    rows = spark.range(3_000_000).select("id", (F.col("id") % 2).alias("label"))
    sizes = stratified_folds(rows, "label", ["id"], 2).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in sizes} == {750_000} and len(sizes) == 4
    assert seen and not any("SortMergeJoin" in plan(df) for df in seen)
