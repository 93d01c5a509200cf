"""Model quality per month over whole scored tables."""

from __future__ import annotations

from registry.base import derive, query, rounded, table, with_inputs
from snapmart.operators import evaluation
from snapmart.operators.stability import stability
from snapmart.plans.monitoring import performance_history, stability_history

CONFUSION_SQL = """
    select snapshot_date, sum(case when label = 1 and prediction = 1 then 1 else 0 end)::bigint as tp,
           sum(case when label = 0 and prediction = 1 then 1 else 0 end)::bigint as fp,
           sum(case when label = 0 and prediction = 0 then 1 else 0 end)::bigint as tn,
           sum(case when label = 1 and prediction = 0 then 1 else 0 end)::bigint as fn,
           avg(prediction) as prediction_rate, avg(label) as actual_default_rate,
           count(*) as n
    from {scored} group by 1
"""

RATES_SQL = """
    select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision_,
           coalesce(tp / nullif(tp + fn, 0), 0) as recall_,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_,
           (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as hard
    from confusion
"""

AUC_SQL = """
    select snapshot_date,
           (sum(pos * (before + (n + 1) / 2.0::double)) - sum(pos)::double * (sum(pos) + 1) / 2)
           / nullif(sum(pos)::double * (sum(n) - sum(pos)), 0) as auc
    from (select *, coalesce(sum(n) over (partition by snapshot_date order by probability
                    rows between unbounded preceding and 1 preceding), 0)::double as before
          from (select snapshot_date, probability, count(*) as n, sum(label)::double as pos
                from {scored} group by 1, 2))
    group by 1
"""


@query(
    "q_confusion",
    with_inputs(
        {"confusion": CONFUSION_SQL},
        """
        select cast(snapshot_date as varchar) as snapshot_date, tp as true_positives,
               fp as false_positives, tn as true_negatives, fn as false_negatives,
               round(prediction_rate, 6) as prediction_rate,
               round(actual_default_rate, 6) as actual_default_rate, n as total_predictions
        from confusion
        """,
    ),
)
def confusion(spark, sf_dir):
    result = evaluation.confusion(derive(spark, sf_dir, "scored"), ["snapshot_date"])
    return rounded(result, "prediction_rate", "actual_default_rate")


@query(
    "q_prf",
    with_inputs(
        {"confusion": CONFUSION_SQL, "rates": RATES_SQL},
        """
        select cast(snapshot_date as varchar) as snapshot_date, round(precision_, 6) as "precision",
               round(recall_, 6) as recall, round(f1_, 6) as f1, round(hard, 6) as auc
        from rates
        """,
    ),
)
def precision_recall(spark, sf_dir):
    """Precision, recall, F1 and the AUC of hard predictions."""
    table_ = evaluation.confusion(derive(spark, sf_dir, "scored"), ["snapshot_date"])
    result = evaluation.hard_auc(evaluation.rates(table_))
    return rounded(
        result.select("snapshot_date", "precision", "recall", "f1", "auc"),
        "precision", "recall", "f1", "auc",
    )


@query(
    "q_auc",
    with_inputs(
        {"areas": AUC_SQL},
        "select cast(snapshot_date as varchar) as snapshot_date, round(auc, 6) as auc from areas",
    ),
)
def auc(spark, sf_dir):
    """Exact ROC AUC of the scores per month."""
    return rounded(evaluation.auc(derive(spark, sf_dir, "scored"), ["snapshot_date"]), "auc")


@query(
    "q_auc_labels",
    """
    with joined as (select d.lang, l.quality as y, d.n_chars::double as s
                    from labels l join documents d on d.doc_id = l.doc_id),
    cells as (select lang, s, count(*) as n, sum(y)::double as pos from joined group by 1, 2),
    ranked as (select *, coalesce(sum(n) over (partition by lang order by s
                    rows between unbounded preceding and 1 preceding), 0)::double as before from cells)
    select lang, round((sum(pos * (before + (n + 1) / 2.0::double)) - sum(pos) * (sum(pos) + 1) / 2)
                 / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 6) as auc
    from ranked group by 1
    """,
)
def auc_labels(spark, sf_dir):
    """How well the length of a document tells its quality label, per language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")
    return rounded(evaluation.auc(joined, ["lang"], "quality", "n_chars"), "auc")


@query(
    "q_performance",
    with_inputs(
        {"confusion": CONFUSION_SQL, "rates": RATES_SQL, "areas": AUC_SQL},
        """
        select cast(r.snapshot_date as varchar) as snapshot_date, round(a.auc, 6) as auc,
               round(f1_, 6) as f1, round(precision_, 6) as "precision", round(recall_, 6) as recall,
               tp as true_positives, fp as false_positives, tn as true_negatives,
               fn as false_negatives, round(prediction_rate, 6) as prediction_rate,
               round(actual_default_rate, 6) as actual_default_rate, n as total_predictions
        from rates r join areas a on a.snapshot_date = r.snapshot_date
        """,
    ),
)
def performance(spark, sf_dir):
    """All quality metrics of every month from one scan."""
    result = evaluation.performance(derive(spark, sf_dir, "scored"), ["snapshot_date"])
    return rounded(
        result, "auc", "f1", "precision", "recall", "prediction_rate", "actual_default_rate"
    )


RUN_DATE = "2001-11-01"


@query(
    "q_performance_history",
    with_inputs(
        {"confusion": CONFUSION_SQL, "rates": RATES_SQL, "areas": AUC_SQL},
        f"""
        select cast(r.snapshot_date as varchar) as snapshot_date, round(a.auc, 6) as auc,
               round(f1_, 6) as f1, round(precision_, 6) as "precision", round(recall_, 6) as recall,
               tp as true_positives, fp as false_positives, tn as true_negatives,
               fn as false_negatives, round(prediction_rate, 6) as prediction_rate,
               round(actual_default_rate, 6) as actual_default_rate, n as total_predictions
        from rates r join areas a on a.snapshot_date = r.snapshot_date
        where auc is not null and r.snapshot_date in (
            select cast(date '{RUN_DATE}' - to_months(cast(i + 2 as integer)) as date) from range(6) t(i))
        """,
    ),
)
def history(spark, sf_dir):
    """Predictions joined to labels that come later, last six months with known labels."""
    scored = derive(spark, sf_dir, "scored")
    result = performance_history(
        scored.drop("label"),
        scored.select("Customer_ID", "loan_id", "snapshot_date", "label"),
        RUN_DATE,
        keys=["Customer_ID", "loan_id", "snapshot_date"],
    )
    return rounded(
        result, "auc", "f1", "precision", "recall", "prediction_rate", "actual_default_rate"
    )


@query(
    "q_predicted_positives",
    with_inputs(
        {},
        """
        select cast(snapshot_date as varchar) as snapshot_date, count(*) as total_predictions,
               sum(prediction)::bigint as predicted_positives,
               round(avg(prediction), 6) as prediction_rate
        from {scored} group by 1
        """,
    ),
)
def positives(spark, sf_dir):
    scored = derive(spark, sf_dir, "scored")
    return rounded(evaluation.predicted_positives(scored, ["snapshot_date"]), "prediction_rate")


MODELS_SQL = """
    select 'forest' as model, label, prediction, split from (
        select *, case when month(snapshot_date) <= 8 then 'train' when month(snapshot_date) <= 10
                       then 'test' else 'oot' end as split from {scored})
    union all
    select 'logistic', label, case when probability > 0.25e0 then 1 else 0 end,
           case when month(snapshot_date) <= 8 then 'train' when month(snapshot_date) <= 10
                then 'test' else 'oot' end from {scored}
"""
QUALITY_SQL = """
    select model, split, tp, fp, tn, fn, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 as auc,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1
    from (select model, split, sum(case when label = 1 and prediction = 1 then 1 else 0 end) as tp,
                 sum(case when label = 0 and prediction = 1 then 1 else 0 end) as fp,
                 sum(case when label = 0 and prediction = 0 then 1 else 0 end) as tn,
                 sum(case when label = 1 and prediction = 0 then 1 else 0 end) as fn
          from models group by 1, 2)
"""


def _models(spark, sf_dir):
    scored = derive(spark, sf_dir, "scored")
    return spark.sql(MODELS_SQL, scored=scored)


@query(
    "q_model_quality",
    with_inputs(
        {"models": MODELS_SQL, "quality": QUALITY_SQL},
        "select model, split, round(auc, 6) as auc, round(f1, 6) as f1 from quality",
    ),
)
def model_quality(spark, sf_dir):
    """AUC and F1 per model and split."""
    return rounded(evaluation.model_quality(_models(spark, sf_dir)), "auc", "f1")


@query(
    "q_choose_model",
    with_inputs(
        {"models": MODELS_SQL, "quality": QUALITY_SQL},
        """
        select model, round(auc, 6) as auc from quality where split = 'test'
        order by auc desc, model desc limit 1
        """,
    ),
)
def chosen_model(spark, sf_dir):
    quality = evaluation.model_quality(_models(spark, sf_dir))
    return rounded(evaluation.choose_model(quality, "forest", "logistic"), "auc")


STABILITY_SQL = """
    select snapshot_date, avg(probability) as mean_probability,
           stddev_samp(probability) as std_probability, avg(prediction) as prediction_rate,
           quantile_cont(probability, 0.1) as p10, quantile_cont(probability, 0.5) as p50,
           quantile_cont(probability, 0.9) as p90, count(*) as total_predictions
    from {scored} group by 1
"""
STABILITY_COLUMNS = ["mean_probability", "std_probability", "prediction_rate", "p10", "p50", "p90"]
STABILITY_SELECT = (
    "cast(snapshot_date as varchar) as snapshot_date, total_predictions, "
    + ", ".join(f"round({c}, 6) as {c}" for c in STABILITY_COLUMNS)
)


@query(
    "q_stability",
    with_inputs({"stability": STABILITY_SQL}, f"select {STABILITY_SELECT} from stability"),
)
def stable(spark, sf_dir):
    """Score distribution of every month, exact quantiles."""
    return rounded(stability(derive(spark, sf_dir, "scored")), *STABILITY_COLUMNS)


@query(
    "q_stability_history",
    with_inputs(
        {"stability": STABILITY_SQL},
        f"""
        select {STABILITY_SELECT} from stability where snapshot_date in (
            select cast(date '{RUN_DATE}' - to_months(cast(i as integer)) as date) from range(6) t(i))
        """,
    ),
)
def stable_history(spark, sf_dir):
    """Score distribution of the last six months."""
    return rounded(
        stability_history(derive(spark, sf_dir, "scored"), RUN_DATE), *STABILITY_COLUMNS
    )
