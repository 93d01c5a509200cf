"""Drift, changes between snapshots, alerts and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import derive, query, rounded, saved, shared_folder, with_inputs
from registry.evaluation import AUC_SQL, CONFUSION_SQL, RATES_SQL, STABILITY_SQL
from snapmart.operators import alerts as rules
from snapmart.operators.drift import drift_summary, high_drift, severity_counts, top_drift
from snapmart.operators.evaluation import performance
from snapmart.operators.stability import (
    changes,
    latest_row,
    merged_stability,
    rank_distances,
    rank_error,
    score_states,
    stability,
    stability_band,
)
from snapmart.plans.monitoring import drift_from_profiles, drift_table
from snapmart.sources.published import publish

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey",
            "seasonal_price", "seasonal_quantity", "constant"]
RUN_DATE, BASELINE_DATE = "1999-07-01", "1999-01-01"

PAIRS_SQL = (
    "select case when snapshot_date = date '" + BASELINE_DATE + "' then 'b' else 'c' end as period, f, v "
    "from (" + " union all ".join(
        f"select snapshot_date, '{f}' as f, cast({f if f != 'constant' else '7'} as double) as v from {{shipped}}"
        for f in FEATURES
    )
    + f") where snapshot_date in (date '{RUN_DATE}', date '{BASELINE_DATE}')"
)
DRIFT_CTES = {
    "pairs": PAIRS_SQL,
    "bounds": """
        select f, case when min(v) = max(v) then min(v) - 0.5 else min(v) end as lo,
               case when min(v) = max(v) then max(v) + 0.5 else max(v) end as hi
        from pairs where period = 'b' group by 1""",
    "binned": """
        select p.f, period, case when v < lo or v > hi then -1 else len(list_filter(range(1, 10),
               lambda i: v >= lo + i * ((hi - lo) / 10))) end as bin
        from pairs p join bounds b on b.f = p.f""",
    "shares": """
        select f, bin, coalesce(max(case when period = 'b' then share end), 0) + 1e-10 as b,
               coalesce(max(case when period = 'c' then share end), 0) + 1e-10 as c
        from (select f, period, bin, count(*)::double / sum(count(*)) over (partition by f, period) as share
              from binned group by 1, 2, 3) where bin >= 0 group by 1, 2""",
    "drift": """
        select s.f as feature, psi, case when psi < 0.1 then 'low' when psi < 0.25 then 'medium'
                                         else 'high' end as drift_severity,
               baseline_mean, current_mean, baseline_std, current_std
        from (select f, sum((c - b) * ln(c / b)) as psi from shares group by 1) s
        join (select f, avg(v) filter (period = 'b') as baseline_mean,
                     avg(v) filter (period = 'c') as current_mean,
                     stddev_samp(v) filter (period = 'b') as baseline_std,
                     stddev_samp(v) filter (period = 'c') as current_std
              from pairs group by 1) m on m.f = s.f""",
}
DRIFT_NUMBERS = ["psi", "baseline_mean", "current_mean", "baseline_std", "current_std"]


def _drift(spark, sf_dir):
    lines = derive(spark, sf_dir, "shipped").withColumn("constant", F.lit(7))
    return drift_table(lines, FEATURES, RUN_DATE)


@query(
    "q_drift",
    with_inputs(
        DRIFT_CTES,
        "select feature, drift_severity, "
        + ", ".join(f"round({c}, 6) as {c}" for c in DRIFT_NUMBERS)
        + f", '{RUN_DATE}' as snapshot_date, '{BASELINE_DATE}' as baseline_date from drift",
    ),
)
def drifted(spark, sf_dir):
    """Stability index, severity and moments of every feature, six months apart."""
    return rounded(_drift(spark, sf_dir), *DRIFT_NUMBERS)


@query(
    "q_drift_top",
    with_inputs(
        DRIFT_CTES,
        "select feature, drift_severity, round(psi, 6) as psi from drift order by psi desc, feature limit 20",
    ),
)
def most_drifted(spark, sf_dir):
    return rounded(top_drift(_drift(spark, sf_dir)).select("feature", "drift_severity", "psi"), "psi")


@query(
    "q_drift_high",
    with_inputs(
        DRIFT_CTES,
        """
        select feature, round(psi, 6) as psi from drift where drift_severity = 'high'
        order by psi desc, feature limit 5
        """,
    ),
)
def highly_drifted(spark, sf_dir):
    return rounded(high_drift(_drift(spark, sf_dir)).select("feature", "psi"), "psi")


@query(
    "q_drift_counts",
    with_inputs(
        DRIFT_CTES, "select drift_severity, count(*) as features from drift group by 1"
    ),
)
def drift_counts(spark, sf_dir):
    return severity_counts(_drift(spark, sf_dir))


@query(
    "q_drift_summary",
    with_inputs(
        DRIFT_CTES,
        """
        select count(*) as features, count(*) filter (drift_severity = 'high') as high,
               count(*) filter (drift_severity = 'medium') as medium,
               count(*) filter (drift_severity = 'low') as low,
               round(avg(case when drift_severity = 'high' then 1.0::double else 0 end), 6) as high_share
        from drift
        """,
    ),
)
def drift_shares(spark, sf_dir):
    return rounded(drift_summary(_drift(spark, sf_dir)), "high_share")


@query(
    "q_drift_profiles",
    with_inputs(
        DRIFT_CTES,
        "select feature, drift_severity, "
        + ", ".join(f"round({c}, 6) as {c}" for c in DRIFT_NUMBERS)
        + f", '{RUN_DATE}' as snapshot_date, '{BASELINE_DATE}' as baseline_date from drift",
    ),
)
def drift_profiles(spark, sf_dir):
    """The same from the saved profile of the baseline month, whose rows are read once, for the profile."""
    lake = shared_folder(spark)
    lines = derive(spark, sf_dir, "shipped").withColumn("constant", F.lit(7))
    months = lines.filter(F.col("snapshot_date").isin(RUN_DATE, BASELINE_DATE))
    publish(months, f"{lake}/gold/feature_store")
    return rounded(drift_from_profiles(spark, lake, FEATURES, RUN_DATE), *DRIFT_NUMBERS)


QUARTER = "cast(date_trunc('quarter', snapshot_date) as date)"
MERGED_NUMBERS = ["mean_probability", "std_probability", "prediction_rate"]


def _monthly_states(spark, sf_dir):
    """One saved state for each month of the scores, with its quarter."""
    states = saved(score_states(derive(spark, sf_dir, "scored")))
    return states.withColumn("quarter", F.expr(QUARTER))


@query(
    "q_stability_merged",
    with_inputs(
        {"scored_rows": "select * from {scored}"},
        f"""
        select cast({QUARTER} as varchar) as quarter, round(avg(probability), 6) as mean_probability,
               round(stddev_samp(probability), 6) as std_probability,
               round(avg(prediction), 6) as prediction_rate, count(*) as total_predictions
        from scored_rows group by {QUARTER}
        """,
    ),
)
def stability_merged(spark, sf_dir):
    """Moments of every quarter, merged from saved monthly states."""
    merged = merged_stability(_monthly_states(spark, sf_dir), ["quarter"])
    return rounded(merged.select("quarter", *MERGED_NUMBERS, "total_predictions"), *MERGED_NUMBERS)


@query(
    "q_score_sketch",
    with_inputs(
        {"scored_rows": "select * from {scored}"},
        f"""
        select cast({QUARTER} as varchar) as quarter, unnest(['p10', 'p50', 'p90']) as quantile,
               count(*) as rows, 'true' as within
        from scored_rows group by {QUARTER}
        """,
    ),
)
def score_sketch(spark, sf_dir):
    """Whether the quantiles of each quarter, from merged monthly sketches, have ranks within their error."""
    merged = saved(merged_stability(_monthly_states(spark, sf_dir), ["quarter"]))
    rows = derive(spark, sf_dir, "scored").withColumn("quarter", F.expr(QUARTER))
    found = rank_distances(rows, merged, ["quarter"])
    # a sketch of few rows is exact up to one row
    allowed = rank_error() + 1 / F.col("rows")
    return found.select("quarter", "quantile", "rows", (F.col("distance") <= allowed).alias("within"))


METRIC_CTES = {
    "confusion": CONFUSION_SQL,
    "rates": RATES_SQL,
    "areas": AUC_SQL,
    "performance": """
        select r.snapshot_date, a.auc, f1_ as f1, precision_ as "precision", recall_ as recall,
               prediction_rate, actual_default_rate
        from rates r join areas a on a.snapshot_date = r.snapshot_date""",
    "stability": STABILITY_SQL,
}


@query(
    "q_changes",
    with_inputs(
        {"stability": STABILITY_SQL},
        """
        select cast(snapshot_date as varchar) as snapshot_date,
               round(prediction_rate - lag(prediction_rate) over (order by snapshot_date), 6)
                   as prediction_rate_change,
               round(mean_probability - lag(mean_probability) over (order by snapshot_date), 6)
                   as mean_probability_change
        from stability
        """,
    ),
)
def changed(spark, sf_dir):
    """Change of two metrics against the previous month."""
    names = ["prediction_rate", "mean_probability"]
    table = changes(stability(derive(spark, sf_dir, "scored")), names)
    return rounded(
        table.select("snapshot_date", *[f"{n}_change" for n in names]),
        *[f"{n}_change" for n in names],
    )


@query(
    "q_latest",
    with_inputs(
        {"stability": STABILITY_SQL},
        """
        select cast(snapshot_date as varchar) as snapshot_date, round(mean_probability, 6) as mean_probability,
               total_predictions
        from stability order by snapshot_date desc limit 1
        """,
    ),
)
def latest(spark, sf_dir):
    """The metrics of the newest month."""
    row = latest_row(stability(derive(spark, sf_dir, "scored")))
    return rounded(row.select("snapshot_date", "mean_probability", "total_predictions"),
                   "mean_probability")


@query(
    "q_stability_band",
    with_inputs(
        {"stability": STABILITY_SQL},
        """
        select cast(snapshot_date as varchar) as snapshot_date, round(mean_probability, 6) as mean_probability,
               round(mean_probability - std_probability, 6) as band_low,
               round(mean_probability + std_probability, 6) as band_high,
               round(p10, 6) as p10, round(p90, 6) as p90, round(prediction_rate, 6) as prediction_rate
        from stability
        """,
    ),
)
def band(spark, sf_dir):
    names = ["mean_probability", "band_low", "band_high", "p10", "p90", "prediction_rate"]
    return rounded(stability_band(stability(derive(spark, sf_dir, "scored"))), *names)


@query(
    "q_performance_series",
    with_inputs(
        METRIC_CTES,
        """
        select cast(snapshot_date as varchar) as snapshot_date, round(auc, 6) as auc,
               0.7::double as auc_line, round(f1, 6) as f1, round("precision", 6) as "precision",
               round(recall, 6) as recall, round(prediction_rate, 6) as prediction_rate,
               round(actual_default_rate, 6) as actual_default_rate
        from performance
        """,
    ),
)
def series(spark, sf_dir):
    scored = derive(spark, sf_dir, "scored")
    table = rules.performance_series(performance(scored, ["snapshot_date"]))
    return rounded(
        table, "auc", "f1", "precision", "recall", "prediction_rate", "actual_default_rate"
    )


RULES_SQL = {
    "latest_performance": """
        select *, auc - lag(auc) over (order by snapshot_date) as auc_change from performance
        qualify row_number() over (order by snapshot_date desc) = 1""",
    "latest_stability": """
        select *, prediction_rate - lag(prediction_rate) over (order by snapshot_date) as rate_change
        from stability qualify row_number() over (order by snapshot_date desc) = 1""",
    "drifted": "select avg(case when drift_severity = 'high' then 1.0::double else 0 end) as s from drift",
}


@query(
    "q_alerts",
    with_inputs(
        METRIC_CTES | DRIFT_CTES | RULES_SQL,
        """
        select case when auc < 0.70 then 'critical' else 'warning' end as level, 'auc' as metric,
               round(auc, 6) as value, cast(case when auc < 0.70 then 0.70 else 0.75 end as double) as threshold
        from latest_performance where auc < 0.75
        union all
        select 'warning', 'auc_change', round(auc_change, 6), -0.05::double
        from latest_performance where auc_change < -0.05
        union all
        select case when s > 0.30 then 'critical' else 'warning' end, 'high_drift_share', round(s, 6),
               case when s > 0.30 then 0.30 else 0.15 end::double from drifted where s > 0.15
        union all
        select case when abs(rate_change) > 0.10 then 'critical' else 'warning' end,
               'prediction_rate_change', round(abs(rate_change), 6),
               case when abs(rate_change) > 0.10 then 0.10 else 0.05 end::double
        from latest_stability where abs(rate_change) > 0.05
        """,
    ),
)
def alerting(spark, sf_dir):
    """All monitoring rules over saved performance, drift and stability."""
    scored = derive(spark, sf_dir, "scored")
    table = rules.alerts(
        saved(performance(scored, ["snapshot_date"])), saved(_drift(spark, sf_dir)),
        saved(stability(scored)),
    )
    return rounded(table, "value")


@query(
    "q_report",
    with_inputs(
        METRIC_CTES | DRIFT_CTES | RULES_SQL,
        """
        select section, metric, round(value, 6) as value from (
            select 'performance' as section, unnest(['auc', 'f1', 'precision', 'recall', 'auc_change',
                       'auc_degradation_warning']) as metric,
                   unnest([auc, f1, "precision", recall, auc_change,
                       case when auc_change < -0.05 then 1.0 else 0.0 end]) as value
            from latest_performance
            union all
            select 'drift', unnest(['high_features', 'medium_features', 'low_features', 'total_features']),
                   unnest([count(*) filter (drift_severity = 'high'),
                           count(*) filter (drift_severity = 'medium'),
                           count(*) filter (drift_severity = 'low'), count(*)]) from drift
            union all
            select * from (select 'high_drift', feature, psi from drift where drift_severity = 'high'
                           order by psi desc, feature limit 5)
            union all
            select 'stability', unnest(['mean_probability', 'std_probability', 'prediction_rate',
                       'prediction_rate_change', 'prediction_rate_warning']),
                   unnest([mean_probability, std_probability, prediction_rate, rate_change,
                       case when abs(rate_change) > 0.05 then 1.0 else 0.0 end])
            from latest_stability)
        """,
    ),
)
def report(spark, sf_dir):
    scored = derive(spark, sf_dir, "scored")
    table = rules.report_rows(
        saved(performance(scored, ["snapshot_date"])), saved(_drift(spark, sf_dir)),
        saved(stability(scored)),
    )
    return rounded(table, "value")


@query(
    "q_availability",
    """
    select 'orders' as table_name, count(*) as rows, 'true' as has_data from orders
    union all select 'lineitem', count(*), 'true' from lineitem
    union all select 'future orders', 0, 'false'
    """,
)
def available(spark, sf_dir):
    orders = derive(spark, sf_dir, "orders")
    return rules.availability(
        {
            "orders": orders,
            "lineitem": derive(spark, sf_dir, "lineitem"),
            "future orders": orders.filter(F.col("o_orderdate") > F.lit("2100-01-01").cast("date")),
        }
    )
