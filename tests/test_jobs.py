"""The monthly jobs from CSV sources to report rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from registry.base import derive
from snapmart.operators import modeling
from snapmart.plans import extraction, monitoring, training
from snapmart.sources import schemas
from snapmart.sources import snapshots as snap
from snapmart.sources.published import carried_over, publish, read_published, resolve

SF_DIR = "/root/testdata/sf0.001"
GRIDS = {
    "logistic": {"C": [1.0], "maxIter": [20]},
    "forest": {"numTrees": [5], "maxDepth": [4], "minInstancesPerNode": [1]},
}


def write_sources(spark, folder, empty=()):
    paths = {}
    for name, (types, _) in extraction.SOURCES.items():
        rows = derive(spark, SF_DIR, f"raw_{name}").select(*types)
        if name in empty:
            rows = rows.limit(0)
        paths[name] = f"{folder}/{name}.csv"
        rows.coalesce(1).write.option("header", True).csv(paths[name])
    return paths


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    paths = write_sources(spark, folder)
    extraction.run_extraction(spark, paths, str(folder))
    return str(folder), paths


def read(spark, lake, name):
    return read_published(spark, f"{lake}/{name}")


def test_stores(spark, lake):
    folder, _ = lake
    labels, features = read(spark, folder, "gold/label_store"), read(spark, folder, "gold/feature_store")
    assert labels.count() == features.count() > 100
    assert features.filter(F.col("feature_snapshot_date") > F.col("snapshot_date")).count() == 0
    names = training.feature_columns(features, training.IDS)
    assert len(names) == 29 + 4 + 20 + 6  # financials, attributes, clicks, loan types
    assert labels.groupBy("loan_id", "Customer_ID", "snapshot_date").count().filter("count > 1").count() == 0


def test_rerun_of_one_month_changes_nothing(spark, lake):
    folder, paths = lake
    before = read(spark, folder, "gold/feature_store")
    expected = {tuple(r) for r in before.groupBy("snapshot_date").count().collect()}
    sample = before.filter(F.col("snapshot_date") == "1998-03-01").drop("snapshot_date")
    rows = sorted(map(str, sample.collect()))
    extraction.run_extraction(spark, paths, folder, "1998-03-01", "1998-03-01", refit=False)
    after = read(spark, folder, "gold/feature_store")
    assert {tuple(r) for r in after.groupBy("snapshot_date").count().collect()} == expected
    again = after.filter(F.col("snapshot_date") == "1998-03-01").drop("snapshot_date")
    assert sorted(map(str, again.collect())) == rows


def test_a_rerun_rewrites_only_what_changed(spark, lake):
    folder, paths = lake
    before = resolve(spark, f"{folder}/gold/financials")
    extraction.run_extraction(spark, paths, folder, "1998-03-01", "1998-03-01")
    assert resolve(spark, f"{folder}/gold/financials").number == before.number  # no month has changed
    extraction.gold(spark, folder, "1998-03-01", "1998-03-01")
    after = resolve(spark, f"{folder}/gold/financials")
    assert set(after.parts) - carried_over(before, after) == {date(1998, 3, 1)}


def test_no_stores_no_model(spark, tmp_path):
    assert training.run_training(spark, str(tmp_path), GRIDS) is None
    assert training.run_scoring(spark, str(tmp_path), "2001-01-01") is None
    assert not list(tmp_path.iterdir())


def test_month_by_month_equals_a_backfill(spark, lake, tmp_path):
    folder, paths = lake
    extraction.run_extraction(spark, paths, str(tmp_path), end="1997-12-01")
    extraction.run_extraction(spark, paths, str(tmp_path), start="1998-01-01")
    for name in ("financials", "attributes", "combined_features", "label_store", "feature_store"):
        once, twice = read(spark, folder, f"gold/{name}"), read(spark, str(tmp_path), f"gold/{name}")
        assert sorted(once.columns) == sorted(twice.columns)
        twice = twice.select(*[f"`{c}`" for c in once.columns])
        assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_monitoring_of_a_new_lake(spark, tmp_path):
    monitoring.run_monitoring(spark, str(tmp_path), "2001-05-01", datetime(2001, 7, 1))
    found = {r["table_name"]: r["has_data"] for r in read(spark, tmp_path, "monitoring/availability").collect()}
    assert found == {"performance_metrics": False, "prediction_stability": False, "feature_drift": False}
    assert read(spark, tmp_path, "monitoring/alerts").count() == 0


def test_too_deep_trees_are_an_error(spark):
    rows = spark.sql("select id, cast(id % 2 as int) as label, double(id) as x from range(40)")
    with pytest.raises(ValueError, match="30"):
        modeling.train(rows, ["x"], ["id"], "forest", grid={"numTrees": [2], "maxDepth": [50]}, folds=2)


def test_training_scoring_monitoring(spark, lake):
    folder, _ = lake
    best = training.run_training(spark, folder, GRIDS, folds=2)
    assert best in ("logistic", "forest")
    quality = read(spark, folder, "gold/model_quality")
    assert {(r["model"], r["split"]) for r in quality.collect()} == {
        (m, s) for m in ("logistic", "forest") for s in ("train", "test", "oot")
    }
    months = ["2000-12-01", "2001-01-01", "2001-02-01", "2001-03-01", "2001-04-01", "2001-05-01", "2001-06-01"]
    for month in months:
        training.run_scoring(spark, folder, month, "v1", datetime(2001, 7, 1))
    scored = read(spark, folder, "gold/predictions")
    store = read(spark, folder, "gold/feature_store").filter(F.col("snapshot_date").isin(*months))
    assert scored.count() == store.count()
    assert scored.filter(~F.col("probability").between(0, 1) | ~F.col("prediction").isin(0, 1)).count() == 0

    monitoring.run_monitoring(spark, folder, "2001-05-01", datetime(2001, 7, 1))
    monitoring.run_monitoring(spark, folder, "2001-06-01", datetime(2001, 7, 2))
    performance = read(spark, folder, "monitoring/performance_metrics")
    newest = performance.filter(F.col("run_date") == "2001-06-01")
    dates = {str(r["snapshot_date"]) for r in newest.collect()}
    assert dates <= {"2000-12-01", "2001-01-01", "2001-02-01", "2001-03-01", "2001-04-01"}
    assert read(spark, folder, "monitoring/prediction_stability").filter("run_date = '2001-06-01'").count() == 6
    assert read(spark, folder, "monitoring/feature_drift").filter("run_date = '2001-06-01'").count() > 50
    sections = {r["section"] for r in read(spark, folder, "monitoring/report").collect()}
    assert {"drift", "stability"} <= sections
    found = {r["table_name"]: r["has_data"] for r in read(spark, folder, "monitoring/availability").collect()}
    assert found["prediction_stability"] and found["feature_drift"]


def test_later_months_read_saved_profiles(spark, tmp_path):
    lake, names = str(tmp_path), ["x", "y"]
    rows = spark.sql("""select double(id % 7) as x, double(id % 5) * month(d) as y, d as snapshot_date
        from range(60) cross join (select explode(array(date'2024-01-01', date'2024-07-01')) as d)""")
    publish(rows, f"{lake}/gold/feature_store")

    def found(day):
        table = monitoring.drift_from_profiles(spark, lake, names, day)
        return sorted(map(tuple, table.select("feature", F.round("psi", 9), F.round("current_mean", 9)).collect()))

    def wanted(day):
        table = monitoring.drift_table(read(spark, lake, "gold/feature_store"), names, day)
        return sorted(map(tuple, table.select("feature", F.round("psi", 9), F.round("current_mean", 9)).collect()))

    profiles = f"{lake}/monitoring/feature_profiles"
    assert found("2024-07-01") == wanted("2024-07-01") and len(wanted("2024-07-01")) == 2
    first = resolve(spark, profiles).number
    assert found("2024-07-01") == wanted("2024-07-01") and resolve(spark, profiles).number == first  # read back
    saved = monitoring.saved_months(  # None as maker: no month is read again
        spark, profiles, f"{lake}/gold/feature_store", [date(2024, 1, 1), date(2024, 7, 1)], None)
    assert {str(r[0]) for r in saved.select("snapshot_date").distinct().collect()} == {"2024-01-01", "2024-07-01"}
    # a baseline that is written anew gets a new profile
    publish(rows.filter("snapshot_date = '2024-01-01'").withColumn("y", F.col("y") + 3), f"{lake}/gold/feature_store")
    assert found("2024-07-01") == wanted("2024-07-01") and resolve(spark, profiles).number == first + 1
    assert found("2024-02-01") == []  # neither month exists
    assert monitoring.drift_from_profiles(spark, f"{lake}/none", names, "2024-07-01") is None


def test_stability_from_saved_states(spark, tmp_path):
    lake = str(tmp_path)
    rows = spark.sql("""select id / 500 as probability, cast(id % 3 = 0 as int) as prediction,
        add_months(date'2024-01-01', cast(id % 4 as int)) as snapshot_date from range(500)""")
    assert monitoring.stability_from_states(spark, lake, "2024-04-01") is None
    publish(rows, f"{lake}/gold/predictions")
    got = {r["snapshot_date"]: r for r in monitoring.stability_from_states(spark, lake, "2024-04-01", 3).collect()}
    want = {r["snapshot_date"]: r for r in monitoring.stability_history(rows, "2024-04-01", 3).collect()}
    assert set(got) == set(want) and len(want) == 3
    for day, row in want.items():
        assert got[day]["total_predictions"] == row["total_predictions"]
        assert got[day]["mean_probability"] == pytest.approx(row["mean_probability"])
        assert got[day]["p50"] == pytest.approx(row["p50"], abs=0.02)


def test_header_only_source_gives_empty_tables(spark, tmp_path):
    paths = write_sources(spark, tmp_path, empty=("clickstream",))
    header = ",".join(schemas.CLICKSTREAM_TYPES)
    (tmp_path / "clicks.csv").write_text(header + "\n")
    paths["clickstream"] = str(tmp_path / "clicks.csv")
    extraction.run_extraction(spark, paths, str(tmp_path))
    assert extraction.read_silver(spark, str(tmp_path), "clickstream").count() == 0
    assert read(spark, tmp_path, "gold/financials").count() > 0


def test_write_replaces_only_its_dates(spark, tmp_path):
    df = spark.sql("select id, date_add(date'2024-01-01', cast(id % 3 as int)) as snapshot_date from range(30)")
    path, rows = str(tmp_path / "t"), Observation()
    snap.write_snapshots(df, path, rows=rows)
    assert rows.get["rows"] == 30
    snap.write_snapshots(snap.at_snapshot(df, "2024-01-02").limit(4), path)
    counts = {str(r["snapshot_date"]): r["rows"] for r in snap.snapshot_counts(snap.read_snapshots(spark, path)).collect()}
    assert counts == {"2024-01-01": 10, "2024-01-02": 4, "2024-01-03": 10}
    plan = snap.read_snapshots(spark, path, "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_latest_and_range(spark):
    df = spark.sql("select id, add_months(date'2024-01-01', cast(id as int)) as snapshot_date from range(12)")
    assert [r["id"] for r in snap.latest_snapshot(df).collect()] == [11]
    lagged = snap.within_months_before(df, "2024-12-01", 6, 2)
    assert sorted(r["id"] for r in lagged.collect()) == [4, 5, 6, 7, 8, 9]
    spine = snap.months_before(spark, "2024-12-01", 6, 2)
    assert {str(r[0]) for r in spine.collect()} == {str(r["snapshot_date"]) for r in lagged.collect()}
    holes = df.filter("id <> 5")
    assert [str(r[0]) for r in snap.missing_snapshots(spine, holes).collect()] == ["2024-06-01"]
    assert snap.present_snapshots(spine, holes).count() == 5
