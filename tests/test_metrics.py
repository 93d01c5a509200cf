from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapmart.operators import alerts, evaluation
from snapmart.operators.drift import drift, fit_edges, histogram, profile, profile_drift, profile_edges
from snapmart.operators.stability import (
    changes,
    exact_quantiles,
    latest_row,
    merged_stability,
    newest_run,
    rank_distances,
    rank_error,
    score_states,
    stability,
)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else rnd.choice(["a", "b"])
        score = round(rnd.random(), 2 if i % 2 else 6)
        rows.append((group, int(rnd.random() < score), int(score > 0.6), score))
    rows += [("single", 1, 1, 0.9), ("single", 1, 0, 0.1), ("hot", None, 1, 0.5), ("hot", 1, 1, None)]
    return rows


SCHEMA = "g string, label int, prediction int, probability double"


@pytest.mark.parametrize("cuts", [None, [], [0.3, 0.31, 0.9]])
def test_auc(spark, scored, cuts):
    got = {r["g"]: r["auc"] for r in evaluation.auc(
        spark.createDataFrame(scored, SCHEMA), ["g"], cuts=cuts).collect()}
    for g in ("hot", "a", "b", "single"):
        pairs = [(y, s) for k, y, _, s in scored if k == g and y is not None and s is not None]
        assert got[g] == (None if g == "single" else pytest.approx(brute_auc(pairs), abs=1e-12))


def test_auc_of_reversed_scores(spark, scored):
    df = spark.createDataFrame(scored, SCHEMA)
    a = evaluation.auc(df, ["g"])
    b = evaluation.auc(df.withColumn("probability", 1 - F.col("probability")), ["g"])
    total = a.join(b.withColumnRenamed("auc", "reversed"), "g").filter("auc is not null").collect()
    assert all(r["auc"] + r["reversed"] == pytest.approx(1) for r in total)


def test_performance_agrees_with_parts(spark, scored):
    df = spark.createDataFrame(scored, SCHEMA).filter("label is not null and probability is not null")
    whole = {r["g"]: r.asDict() for r in evaluation.performance(df, ["g"]).collect()}
    parts = evaluation.rates(evaluation.confusion(df, ["g"])).collect()
    assert len(whole) == len(parts) == 4
    for r in parts:
        for name, value in r.asDict().items():
            assert whole[r["g"]][name] == (pytest.approx(value) if name != "g" else value)


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([("a", 1, 0, 0.2), ("a", 0, 0, 0.1)], SCHEMA)
    row = evaluation.performance(df, ["g"]).first()
    assert (row["precision"], row["recall"], row["f1"], row["auc"]) == (0.0, 0.0, 0.0, 1.0)


def test_choose_model(spark):
    def chosen(forest):
        table = spark.createDataFrame(
            [("forest", "test", forest), ("logistic", "test", 0.7), ("logistic", "oot", 0.99)],
            "model string, split string, auc double",
        )
        return evaluation.choose_model(table, "forest", "logistic").first()["model"]

    assert (chosen(0.71), chosen(0.7), chosen(0.6)) == ("forest", "logistic", "logistic")


@pytest.mark.parametrize("cuts", [None, [0.5]])
def test_quantiles(spark, scored, cuts):
    df = spark.createDataFrame(scored, SCHEMA)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "probability", cuts=cuts).collect()}
    frame = pd.DataFrame(scored, columns=["g", "label", "prediction", "probability"])
    for g, part in frame.groupby("g")["probability"]:
        for name, q in {"p10": 0.1, "p50": 0.5, "p90": 0.9}.items():
            assert got[g][name] == pytest.approx(part.quantile(q), abs=1e-12)


def test_stability_and_sketch(spark, scored):
    df = spark.createDataFrame(scored, SCHEMA)
    exact = {r["g"]: r for r in stability(df, ["g"]).collect()}
    sketch = {r["g"]: r for r in stability(df, ["g"], accuracy=10000).collect()}
    part = [s for g, _, _, s in scored if g == "hot" and s is not None]
    assert exact["hot"]["mean_probability"] == pytest.approx(np.mean(part))
    assert exact["hot"]["std_probability"] == pytest.approx(np.std(part, ddof=1))
    assert exact["hot"]["p50"] == pytest.approx(sketch["hot"]["p50"], abs=0.01)
    assert exact["single"]["total_predictions"] == 2


def numpy_psi(base, now, bins=10):
    b, edges = np.histogram(base, bins=bins)
    n, _ = np.histogram(now, bins=edges)
    b, n = b / len(base) + 1e-10, n / len(now) + 1e-10
    return float(np.sum((n - b) * np.log(n / b)))


def test_drift_like_numpy(spark):
    rnd = np.random.default_rng(3)
    base = pd.DataFrame({
        "same": rnd.normal(size=500), "grid": rnd.integers(0, 11, 500) / 100, "shifted": rnd.normal(size=500),
        "constant": 3.0, "flag": rnd.random(500) < 0.5, "holes": rnd.normal(size=500), "empty": np.nan,
    })
    now = pd.DataFrame({
        "same": base["same"], "grid": rnd.integers(0, 11, 400).tolist() + [5] * 100,
        "shifted": rnd.normal(size=500) + 2, "constant": [3.0] * 400 + [8.0] * 100,
        "flag": rnd.random(500) < 0.7, "holes": rnd.normal(size=500), "empty": 1.0,
    })
    now["grid"] = now["grid"] / 100
    base.loc[:99, "holes"] = np.nan
    features = list(base.columns)
    table = drift(spark.createDataFrame(base), spark.createDataFrame(now), features)
    got = {r["feature"]: r for r in table.collect()}
    assert set(got) == set(features) - {"empty"}
    for f in got:
        b, n = base[f].dropna().astype(float), now[f].dropna().astype(float)
        assert got[f]["psi"] == pytest.approx(numpy_psi(b, n), abs=1e-9)
        assert got[f]["baseline_mean"] == pytest.approx(b.mean())
        assert got[f]["current_std"] == pytest.approx(n.std())
        assert got[f]["baseline_std"] == pytest.approx(b.std())
    assert got["same"]["psi"] == pytest.approx(0, abs=1e-12) and got["same"]["drift_severity"] == "low"
    assert got["shifted"]["drift_severity"] == "high"


def test_profiles_stand_for_their_snapshots(spark):
    """Saved profiles give the drift of the snapshots, holes, constants and absent features included."""
    base = spark.sql("""select double(id % 17) as a, if(id % 3 = 0, null, id * 0.5) as holes, 3 as constant,
        cast(null as double) as empty, double('NaN') as odd from range(200)""")
    now = spark.sql("""select double(id % 23) as a, id * 0.75 as holes, if(id < 9, 4, 3) as constant,
        1.0d as empty, double(id) as odd from range(150)""")
    names = base.columns
    saved = profile(base, fit_edges(base, names), names)
    assert saved.groupBy("feature").count().filter("count > 10").count() == 0
    current = profile(now, profile_edges(saved), names)
    got = {r["feature"]: r for r in profile_drift(saved, current).collect()}
    want = {r["feature"]: r for r in drift(base, now, names).collect()}
    assert set(got) == set(want) == {"a", "holes", "constant"}
    for f, row in want.items():
        assert got[f]["drift_severity"] == row["drift_severity"]
        for c in ("psi", "baseline_mean", "current_mean", "baseline_std", "current_std"):
            assert got[f][c] == pytest.approx(row[c], abs=1e-9)
    nothing = profile(base.limit(0), fit_edges(base.limit(0), names), names)
    assert nothing.count() == 0 and profile_drift(nothing, nothing).count() == 0
    assert profile(now, profile_edges(nothing), names).count() == 0


def test_merged_states_like_the_rows(spark):
    """Moments are exact, ranks of sketched quantiles within the stated error, over any grouping."""
    rows = spark.sql("""select add_months(date'2024-01-01', cast(id % 4 as int)) as snapshot_date,
        if(id % 11 = 0, null, pow(rand(5), 3)) as probability, cast(id % 3 = 0 as int) as prediction from range(40000)
        union all select date'2024-05-01', null, 1
        union all select date'2024-06-01', 0.25d, null""").withColumn("half", F.month("snapshot_date") <= 2).cache()
    states = score_states(rows, ["snapshot_date", "half"])
    for by in (["snapshot_date"], ["half"], []):
        got = {tuple(r[b] for b in by): r for r in merged_stability(states, by).collect()}
        want = {tuple(r[b] for b in by): r for r in stability(rows.withColumn("one", F.lit(1)), by or ["one"]).collect()}
        assert set(got) == set(want)
        for key, row in want.items():
            assert got[key]["total_predictions"] == row["total_predictions"]
            for c in ("mean_probability", "std_probability", "prediction_rate"):
                assert got[key][c] == (None if row[c] is None else pytest.approx(row[c]))
        errors = rank_distances(rows, merged_stability(states, by), by).collect()
        assert errors and all(e["distance"] <= rank_error() + 1 / e["rows"] for e in errors)
    assert rank_error(100) > rank_error(800) > 0
    assert merged_stability(score_states(rows.limit(0))).count() == 0


def test_histogram_keeps_all_rows(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    now = spark.createDataFrame([(float(i),) for i in range(50, 150)], "v double")
    rows = histogram(base, now, fit_edges(base, ["v"]), ["v"]).collect()
    assert sum(r["base_n"] for r in rows) == 100 and sum(r["now_n"] for r in rows) == 100
    assert [r["now_n"] for r in rows if r["bin"] == -1] == [50]


def metric(spark, names, rows):
    df = spark.createDataFrame(rows, "snapshot_date string, " + ", ".join(f"{n} double" for n in names))
    return df.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


PERF = ["auc", "f1", "precision", "recall", "prediction_rate", "actual_default_rate"]
STAB = ["mean_probability", "std_probability", "prediction_rate", "p10", "p50", "p90"]


def inputs(spark, aucs, severities, rates):
    perf = metric(spark, PERF, [(f"2024-{m:02d}-01", a, .6, .7, .5, .2, .2) for m, a in enumerate(aucs, 1)])
    stab = metric(spark, STAB, [(f"2024-{m:02d}-01", .3, .1, r, .1, .3, .5) for m, r in enumerate(rates, 1)])
    drifted = spark.createDataFrame(
        [(f"f{i}", 0.3 + i, s) for i, s in enumerate(severities)], "feature string, psi double, drift_severity string"
    )
    return perf, drifted, stab


@pytest.mark.parametrize(
    "aucs, severities, rates, expected",
    [
        ([.8, .69], ["low"] * 4, [.2, .2], {("critical", "auc"), ("warning", "auc_change")}),
        ([.76, .74], ["high"] + ["low"] * 4, [.2, .26], {
            ("warning", "auc"), ("warning", "high_drift_share"), ("warning", "prediction_rate_change")}),
        ([.8], ["high", "high", "low"], [.4, .2], {
            ("critical", "high_drift_share"), ("critical", "prediction_rate_change")}),
        ([.9, .9], ["low"], [.2], set()),
    ],
)
def test_alerts(spark, aucs, severities, rates, expected):
    got = alerts.alerts(*inputs(spark, aucs, severities, rates)).collect()
    assert {(r["level"], r["metric"]) for r in got} == expected


def test_report(spark):
    rows = alerts.report_rows(*inputs(spark, [.9, .8], ["high"] * 7 + ["low"] * 3, [.2, .21])).collect()
    values = {(r["section"], r["metric"]): r["value"] for r in rows}
    assert values["performance", "auc_change"] == pytest.approx(-.1)
    assert values["performance", "auc_degradation_warning"] == 1
    assert values["drift", "total_features"] == 10 and values["drift", "high_features"] == 7
    assert sorted(m for s, m in values if s == "high_drift") == ["f2", "f3", "f4", "f5", "f6"]
    assert values["stability", "prediction_rate_warning"] == 0


def test_newest_run_and_changes(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "r1", .5), ("2024-01-01", "r2", .6), ("2024-02-01", "r1", .9)],
        "snapshot_date string, monitoring_date string, auc double",
    )
    table = changes(newest_run(df), ["auc"])
    got = {r["snapshot_date"]: r["auc_change"] for r in table.collect()}
    assert got["2024-01-01"] is None and got["2024-02-01"] == pytest.approx(.3)
    assert latest_row(table).first()["auc"] == .9
    assert latest_row(table.limit(0)).count() == 0
