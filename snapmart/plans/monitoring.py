"""Monthly monitoring: one grouped job per table of metrics, all months and features at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.alerts import alerts, availability, report_rows
from snapmart.operators.columns import feature_columns, stamp
from snapmart.operators.drift import drift, fit_edges, profile, profile_drift, profile_edges
from snapmart.operators.evaluation import performance
from snapmart.operators.stability import merged_stability, score_states, stability
from snapmart.plans.training import IDS
from snapmart.sources.published import as_date, lagged, publish, read_published, read_version, resolve
from snapmart.sources.snapshots import at_snapshot, within_months_before

#: the least columns of the tables that a new lake may lack
PREDICTIONS = """Customer_ID string, loan_id string, feature_snapshot_date date, prediction int,
    probability double, model_version string, prediction_date timestamp, snapshot_date date"""
LABELS = "loan_id string, Customer_ID string, label int, snapshot_date date"
FEATURES = "Customer_ID string, loan_id string, no_feature double, feature_snapshot_date date, snapshot_date date"

# Months looked back, months until labels are known, distance of the drift baseline.
MONTHS, LABEL_LAG, BASELINE_MONTHS = 6, 2, 6


def performance_history(
    predictions: DataFrame,
    labels: DataFrame,
    run_date: date | str,
    months: int = MONTHS,
    lag: int = LABEL_LAG,
    keys: Sequence[str] = ("Customer_ID", "loan_id", "snapshot_date"),
    date_col: str = "snapshot_date",
) -> DataFrame:
    """Model quality of the months whose labels are known.

    Months without predictions or labels, and months with a single class, are left out.
    """
    pairs = within_months_before(predictions, run_date, months, lag, date_col).join(
        within_months_before(labels, run_date, months, lag, date_col).select(*keys, "label"),
        list(keys),
    )
    # even ranges of the probability, so that the join is not run only to find cut points
    cuts = [i / 64 for i in range(1, 64)]
    return performance(pairs, [date_col], cuts=cuts).filter(F.col("auc").isNotNull())


def drift_table(
    features: DataFrame,
    names: Sequence[str],
    run_date: date | str,
    baseline_months: int = BASELINE_MONTHS,
    date_col: str = "snapshot_date",
) -> DataFrame:
    """Drift of every feature between the run's snapshot and the one some months before."""
    run = F.lit(run_date).cast("date")
    baseline_date = F.add_months(run, -baseline_months)
    table = drift(
        features.filter(F.col(date_col) == baseline_date), at_snapshot(features, run_date, date_col),
        names,
    )
    return stamp(table, snapshot_date=run, baseline_date=baseline_date)


def saved_months(
    spark: SparkSession,
    path: str,
    table: str,
    days: Sequence[date],
    make: Callable[[DataFrame], DataFrame],
) -> DataFrame | None:
    """Summary rows of some months of a published table, made from those months alone that lack them.

    Each summary names the folder that holds its month's rows in the version it was made from, so a
    month that was written anew is summarised anew and all others are read back. None if the table
    does not exist; months that it lacks have no rows.
    """
    source = resolve(spark, table)
    if source is None:
        return None
    folders = {day: source.parts[day].folder for day in days if day in source.parts}
    known = resolve(spark, path)
    made = {} if known is None else {
        (r["snapshot_date"], r["source"])
        for d in folders if d in known.parts
        for r in read_version(spark, known, d, d).select("snapshot_date", "source").distinct().collect()
    }
    for day, folder in folders.items():
        if (day, folder) not in made:
            summary = make(read_version(spark, source, day, day))
            rows = stamp(summary.drop("snapshot_date"), snapshot_date=F.lit(day), source=F.lit(folder))
            known = publish(rows, path, span=(day, day))
    if known is None:
        return None
    first, last = min(days), max(days)
    return read_version(spark, known, first, last).filter(F.col("snapshot_date").isin(*folders) if folders else F.lit(False))


def drift_from_profiles(
    spark: SparkSession,
    lake: str,
    names: Sequence[str],
    run_date: date | str,
    baseline_months: int = BASELINE_MONTHS,
) -> DataFrame | None:
    """:func:`drift_table` of the feature store with the baseline's saved profile.

    The baseline's rows are read only if they changed since its profile was made. The run's own
    profile is made and saved on the way, to be the baseline of a later run. None without a store.
    """
    run, before = as_date(run_date), lagged(run_date, -baseline_months)
    store, path = f"{lake}/gold/feature_store", f"{lake}/monitoring/feature_profiles"

    def own(rows: DataFrame) -> DataFrame:
        return profile(rows, fit_edges(rows, names), names)

    saved = saved_months(spark, path, store, [before, run], own)
    if saved is None:
        return None
    baseline = saved.filter((F.col("snapshot_date") == F.lit(before)) & F.col("feature").isin(*names))
    current = profile(read_published(spark, store, run, run), profile_edges(baseline), names)
    return stamp(profile_drift(baseline, current), snapshot_date=F.lit(run), baseline_date=F.lit(before))


def stability_from_states(
    spark: SparkSession, lake: str, run_date: date | str, months: int = MONTHS
) -> DataFrame | None:
    """:func:`stability_history` from one saved state a month, quantiles from its rank sketch.

    Only months whose predictions changed since are read. None without predictions.
    """
    days = [lagged(run_date, -k) for k in range(months)]
    states = saved_months(
        spark, f"{lake}/monitoring/score_states", f"{lake}/gold/predictions", days, score_states)
    return None if states is None else merged_stability(states)


def stability_history(
    predictions: DataFrame,
    run_date: date | str,
    months: int = MONTHS,
    date_col: str = "snapshot_date",
    accuracy: int | None = None,
) -> DataFrame:
    """Score distribution per month."""
    recent = within_months_before(predictions, run_date, months, 0, date_col)
    return stability(recent, [date_col], accuracy=accuracy)


def run_monitoring(
    spark: SparkSession, lake: str, run_date: date | str, monitoring_date: datetime, sketched: bool = False
) -> None:
    """Write the metric tables of one run, then alerts and report rows from that run's metrics.

    A table that does not exist yet counts as empty, and so do the metrics that follow from it.
    Drift compares with the saved profile of the baseline month. With ``sketched`` the stability of
    the scores comes from one saved state a month, else from all rows, with exact quantiles.
    """
    predictions, labels, store = (
        read_published(spark, f"{lake}/gold/{name}", schema=schema)
        for name, schema in (("predictions", PREDICTIONS), ("label_store", LABELS), ("feature_store", FEATURES))
    )
    run = F.lit(run_date).cast("date")

    tables = {
        "performance_metrics": performance_history(predictions, labels, run_date),
    }
    scores = stability_from_states(spark, lake, run_date) if sketched else None
    tables["prediction_stability"] = stability_history(predictions, run_date) if scores is None else scores
    names = feature_columns(store, IDS)
    drifted = drift_from_profiles(spark, lake, names, run_date)
    tables["feature_drift"] = drift_table(store, names, run_date) if drifted is None else drifted
    metrics = {}
    for name, table in tables.items():
        stamped = stamp(table, monitoring_date=monitoring_date, run_date=run)
        # a rerun that yields no rows any more empties its date
        now = publish(stamped, f"{lake}/monitoring/{name}", "run_date", span=(run_date, run_date))
        metrics[name] = read_version(spark, now, run_date, run_date)
    quality = metrics["performance_metrics"]
    scores = metrics["prediction_stability"]
    newest_drift = metrics["feature_drift"]
    found = availability(
        {"performance_metrics": quality, "feature_drift": newest_drift,
         "prediction_stability": scores}
    )
    publish(found, f"{lake}/monitoring/availability", None)
    publish(alerts(quality, newest_drift, scores), f"{lake}/monitoring/alerts", None)
    publish(report_rows(quality, newest_drift, scores), f"{lake}/monitoring/report", None)
