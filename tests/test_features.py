from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.operators import datasets
from snapmart.operators import features as feat
from snapmart.operators.ordering import cut_points, running_totals, with_range


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, 10.9, False), (2, 20.0, False), (3, 500.0, True), (4, None, None), (5, None, False)],
        "i int, v double, bad boolean",
    )
    got = {r["i"]: r["v"] for r in feat.impute(df, feat.fit_means(df, {"v": "bad"}), {"v": "bad"}).collect()}
    assert got == {1: 10, 2: 20, 3: 15, 4: None, 5: None}


def test_encode_like_string_indexer(spark):
    rnd = random.Random(1)
    values = [rnd.choice(["a", "b", "c", "Z", "é", "ab", "B", None]) for _ in range(200)]
    values += [f"name {i}" for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = feat.encode(df, feat.fit_indexes(df, ["v"]), {"v": "index"})
    model = StringIndexer(inputCol="v", outputCol="expected", handleInvalid="keep").fit(df)
    both = got.join(model.transform(df).select("i", "expected"), "i")
    assert both.count() == 500
    assert both.filter(F.col("index") != F.col("expected")).count() == 0
    unseen = spark.createDataFrame([(1, "never")], "i int, v string")
    size = len(set(values) - {None})
    assert feat.encode(unseen, feat.fit_indexes(df, ["v"]), {"v": "index"}).first()["index"] == size


def test_scale_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = feat.scale(df, feat.fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in got) == [(-1.0, 0.0), (1.0, 0.0)]


def test_multi_hot(spark):
    df = spark.createDataFrame(
        [(1, "m1", ["x"]), (1, "m2", ["y"]), (2, "m1", None)], "c int, m string, a array<string>"
    )
    values = feat.list_values(df, "a")
    assert values == ["x", "y"]
    per_customer = {(r["c"], r["m"]): (r["x"], r["y"]) for r in feat.multi_hot(df, "a", values, ["c"]).collect()}
    assert per_customer == {(1, "m1"): (1, 1), (1, "m2"): (1, 1), (2, "m1"): (0, 0)}
    per_row = {(r["c"], r["m"]): (r["x"], r["y"]) for r in feat.multi_hot(df, "a", values).collect()}
    assert per_row == {(1, "m1"): (1, 0), (1, "m2"): (0, 1), (2, "m1"): (0, 0)}
    with pytest.raises(ValueError):
        feat.list_values(df, "a", most=1)


@pytest.mark.parametrize("parts", [2, 7])
def test_running_totals_like_window(spark, parts):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < .6 else rnd.choice(["a", None]), i * 0.37 % 5, rnd.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = running_totals(with_range(df, "v", cut_points(df, "v", parts)), ["g"], ["v"], ["n"])
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select(
        "g", "v", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("b"), F.sum("n").over(Window.partitionBy("g")).alias("t")
    )
    a = sorted(((r["g"] or "", r["v"], r["n_before"], r["n_total"]) for r in got.collect()))
    b = sorted(((r["g"] or "", r["v"], r["b"], r["t"]) for r in expected.collect()))
    assert a == b


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"c{i}", 1 if i % 7 == 0 else 0) for i in range(2003)] + [(9999, "none", None)]
    return spark.createDataFrame(rows, "loan_id int, customer string, label int")


def test_split_shares(labelled):
    got = datasets.stratified_split(labelled, "label", ["loan_id", "customer"])
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    ones, zeros = 287, 1716
    assert counts[1, "test"] + counts[0, "test"] == 401
    assert abs(counts[1, "test"] - ones * .2) < 1 and abs(counts[0, "test"] - zeros * .2) < 1
    assert counts[None, None] == 1 and got.count() == 2004


def moved(a, b):
    other = b.select("loan_id", F.col("split").alias("s2"))
    return a.join(other, "loan_id").filter("split <> s2").count()


def test_split_is_stable_and_keeps_copies_together(labelled):
    keys = ["loan_id", "customer"]
    split = datasets.stratified_split(labelled, "label", keys)
    again = datasets.stratified_split(labelled.repartition(5), "label", keys)
    assert moved(split, again) == 0
    other = datasets.stratified_split(labelled, "label", keys, seed=1)
    assert moved(split, other) > 0
    copies = labelled.unionByName(labelled.filter("loan_id = 5")).unionByName(labelled.filter("loan_id = 5"))
    sides = datasets.stratified_split(copies, "label", keys).filter("loan_id = 5")
    assert sides.count() == 3 and sides.select("split").distinct().count() == 1


def test_folds(labelled):
    got = datasets.stratified_folds(labelled, "label", ["loan_id"], 5)
    sizes = {(r["label"], r["fold"]): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    for label, n in ((1, 287), (0, 1716)):
        parts = [sizes[label, f] for f in range(5)]
        assert sum(parts) == n and max(parts) - min(parts) <= 1
    tiny = labelled.filter("loan_id in (0, 1, 2)")
    assert datasets.stratified_folds(tiny, "label", ["loan_id"], 5).filter("fold is null").count() == 0


def test_holdout(spark):
    df = spark.range(30).select(F.expr("add_months(date'2022-01-01', cast(id as int))").alias("snapshot_date"))
    got = {str(r["snapshot_date"]): r["period"] for r in datasets.time_holdout(df).collect()}
    assert len(got) == 18 and got["2024-06-01"] == "oot" and got["2023-01-01"] == "development"
    assert list(got.values()).count("oot") == 1


def test_folds_rank_hashes_inside_shared_buckets(spark):
    """Several hashes to a bucket, so that folds begin inside of some."""
    rows = 150_000
    df = spark.range(rows).select("id", F.lit("a").alias("label"))
    got = {r["id"]: r["fold"] for r in datasets.stratified_folds(df, "label", ["id"], 7).collect()}
    by_hash = sorted(range(rows), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert got == {i: at * 7 // rows for at, i in enumerate(by_hash)}
