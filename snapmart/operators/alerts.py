"""Monitoring rules and report rows.

All inputs are metric tables with one row per snapshot or per feature.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.operators.drift import drift_summary, high_drift, severity_counts, top_drift
from snapmart.operators.stability import changes, latest_row

# Alert limits.
AUC_CRITICAL, AUC_WARNING = 0.70, 0.75
AUC_DROP = -0.05
DRIFT_SHARE_CRITICAL, DRIFT_SHARE_WARNING = 0.30, 0.15
RATE_SHIFT_CRITICAL, RATE_SHIFT_WARNING = 0.10, 0.05


def _fired(table: DataFrame, metric: str, value: Column, limit: Column, level: Column) -> DataFrame:
    return table.select(
        level.alias("level"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        limit.cast("double").alias("threshold"),
    ).filter(F.col("level").isNotNull())


def _graded(value: Column, critical: float, warning: float, below: bool) -> tuple[Column, Column]:
    """Level and the limit that was crossed."""
    def crossed(limit: float) -> Column:
        return value < limit if below else value > limit

    level = F.when(crossed(critical), "critical").when(crossed(warning), "warning")
    return F.when(crossed(critical), critical).otherwise(warning), level


def performance_alerts(performance: DataFrame) -> DataFrame:
    """AUC level and AUC drop of the newest snapshot."""
    latest = latest_row(changes(performance, ["auc"]))
    value, change = F.col("auc"), F.col("auc_change")
    by_level = _fired(latest, "auc", value, *_graded(value, AUC_CRITICAL, AUC_WARNING, below=True))
    by_change = _fired(
        latest, "auc_change", change, F.lit(AUC_DROP), F.when(change < AUC_DROP, "warning")
    )
    return by_level.unionByName(by_change)


def drift_alerts(drift: DataFrame) -> DataFrame:
    """Share of features with high drift."""
    value = F.col("high_share")
    return _fired(
        drift_summary(drift), "high_drift_share", value,
        *_graded(value, DRIFT_SHARE_CRITICAL, DRIFT_SHARE_WARNING, below=False),
    )


def stability_alerts(stability: DataFrame) -> DataFrame:
    """Shift of the prediction rate of the newest snapshot, in either direction."""
    value = F.abs("prediction_rate_change")
    return _fired(
        latest_row(changes(stability, ["prediction_rate"])), "prediction_rate_change", value,
        *_graded(value, RATE_SHIFT_CRITICAL, RATE_SHIFT_WARNING, below=False),
    )


def alerts(performance: DataFrame, drift: DataFrame, stability: DataFrame) -> DataFrame:
    """All rules that fired: level, metric, value, threshold."""
    return (
        performance_alerts(performance)
        .unionByName(drift_alerts(drift))
        .unionByName(stability_alerts(stability))
    )


def availability(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per monitoring table, and whether it holds data at all."""
    counts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn("has_data", F.col("rows") > 0)


def performance_series(performance: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Chart data of the performance history, with the alert line."""
    return performance.select(
        date_col, "auc", F.lit(AUC_CRITICAL).alias("auc_line"), "f1", "precision", "recall",
        "prediction_rate", "actual_default_rate",
    ).orderBy(date_col)


def drift_chart(drift: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Chart data of the drift: the most drifted features and the number per severity."""
    return top_drift(drift, n), severity_counts(drift)


def _section(table: DataFrame, section: str, values: Mapping[str, Column]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in values.items()
        ]
    )
    return table.select(F.lit(section).alias("section"), F.inline(rows))


def report_rows(
    performance: DataFrame, drift: DataFrame, stability: DataFrame, listed: int = 5
) -> DataFrame:
    """The monitoring report as rows (section, metric, value).

    A change is left out when there is no previous snapshot. The warnings are 1 or 0.
    """
    latest_quality = latest_row(changes(performance, ["auc"]))
    latest_scores = latest_row(changes(stability, ["prediction_rate"]))
    quality = _section(
        latest_quality, "performance",
        {c: F.col(c) for c in ("auc", "f1", "precision", "recall", "auc_change")}
        | {"auc_degradation_warning": (F.col("auc_change") < AUC_DROP).cast("int")},
    )
    summary = _section(
        drift_summary(drift), "drift",
        {f"{c}_features": F.col(c) for c in ("high", "medium", "low")}
        | {"total_features": F.col("features")},
    )
    worst = high_drift(drift, listed).select(
        F.lit("high_drift").alias("section"), F.col("feature").alias("metric"),
        F.col("psi").alias("value"),
    )
    scores = _section(
        latest_scores, "stability",
        {c: F.col(c) for c in (
            "mean_probability", "std_probability", "prediction_rate", "prediction_rate_change",
        )}
        | {"prediction_rate_warning":
           (F.abs("prediction_rate_change") > RATE_SHIFT_WARNING).cast("int")},
    )
    return reduce(DataFrame.unionByName, [quality, summary, worst, scores]).filter(
        F.col("value").isNotNull()
    )
