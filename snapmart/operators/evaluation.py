"""Model quality from scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.operators.ordering import cut_points, with_range


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def confusion(
    df: DataFrame, by: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """True/false positives/negatives, rates and row count per group, in one pass."""
    y, p = F.col(label), F.col(prediction)
    return (
        df.filter(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            _count((y == 1) & (p == 1)).alias("true_positives"),
            _count((y == 0) & (p == 1)).alias("false_positives"),
            _count((y == 0) & (p == 0)).alias("true_negatives"),
            _count((y == 1) & (p == 0)).alias("false_negatives"),
            F.avg(p.cast("double")).alias("prediction_rate"),
            F.avg(y.cast("double")).alias("actual_default_rate"),
            F.count(F.lit(1)).alias("total_predictions"),
        )
    )


def rates(table: DataFrame) -> DataFrame:
    """Add precision, recall and F1 (0 where undefined) to a confusion table."""
    tp, fp, fn = (
        F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives")
    )

    def share(part: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(part, of), F.lit(0.0))

    return table.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
        }
    )


def hard_auc(table: DataFrame, out: str = "auc") -> DataFrame:
    """Add the ROC AUC of 0/1 predictions: half of (true positive rate + true negative rate)."""
    tp, fp, tn, fn = (
        F.col(c).cast("double")
        for c in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )
    return table.withColumn(out, (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)


def _by_score_range(
    df: DataFrame, by: Sequence[str], label: str, score: str,
    cuts: Sequence[float] | None, **counts: Column,
) -> DataFrame:
    """Row counts per group and score range, and the sum of the ranks that positives have in it.

    Rows are counted per distinct score first. Tied scores share their middle rank. A range is
    ranked in its own task, so one group may hold most of the rows.
    """
    usable = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    if cuts is None:
        cuts = cut_points(usable, score)
    cells = usable.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col(label) == 1).alias("positives"),
        *[c.alias(name) for name, c in counts.items()],
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_score")
    below = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    middle_rank = F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)
    return (
        with_range(cells, "_score", cuts)
        .withColumn("_rank", middle_rank)
        .groupBy(*by, "_range")
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("positives"),
            F.sum(F.col("positives") * F.col("_rank")).alias("_ranks"),
            *[F.sum(name).alias(name) for name in counts],
        )
    )


def _with_rows_below(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the rows in lower score ranges. One input row per group and range."""
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_below", F.coalesce(F.sum("n").over(lower), F.lit(0)))


def _auc() -> Column:
    """Area from the rank sum of the positives; NULL where only one class occurs."""
    positives = F.sum("positives").cast("double")
    negatives = F.sum(F.col("n") - F.col("positives")).cast("double")
    ranks = F.sum(F.col("_ranks") + F.col("positives").cast("double") * F.col("_below"))
    return F.try_divide(ranks - positives * (positives + 1) / 2, positives * negatives)


def auc(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    score: str = "probability",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact ROC AUC per group; NULL where only one class occurs.

    ``cuts`` divide the scores into ranges, see :func:`snapmart.operators.ordering.cut_points`.
    """
    ranges = _with_rows_below(_by_score_range(df, by, label, score, cuts), by)
    return ranges.groupBy(*by).agg(_auc().alias("auc"))


def performance(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    score: str = "probability",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """AUC, F1, precision, recall, confusion counts and rates per group, from one pass."""
    y, p = F.col(label), F.col(prediction)
    ranges = _by_score_range(
        df.filter(p.isNotNull()), by, label, score, cuts,
        tp=_count((y == 1) & (p == 1)),
        fp=_count((y == 0) & (p == 1)),
    )
    rows = F.sum("n")
    counted = _with_rows_below(ranges, by).groupBy(*by).agg(
        _auc().alias("auc"),
        F.sum("tp").alias("true_positives"),
        F.sum("fp").alias("false_positives"),
        F.sum(F.col("n") - F.col("positives") - F.col("fp")).alias("true_negatives"),
        F.sum(F.col("positives") - F.col("tp")).alias("false_negatives"),
        (F.sum(F.col("tp") + F.col("fp")).cast("double") / rows).alias("prediction_rate"),
        (F.sum("positives").cast("double") / rows).alias("actual_default_rate"),
        rows.alias("total_predictions"),
    )
    return rates(counted).select(
        *by, "auc", "f1", "precision", "recall",
        "true_positives", "false_positives", "true_negatives", "false_negatives",
        "prediction_rate", "actual_default_rate", "total_predictions",
    )


def model_quality(
    df: DataFrame, by: Sequence[str] = ("model", "split"), label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """AUC of the hard predictions and F1 per model and data split."""
    return hard_auc(rates(confusion(df, by, label, prediction))).select(*by, "auc", "f1")


def choose_model(
    quality: DataFrame, challenger: str, incumbent: str, split: str = "test", metric: str = "auc"
) -> DataFrame:
    """One row: the challenger if it is strictly better on ``split``, otherwise the incumbent."""
    on_split = quality.filter(F.col("split") == split).agg(
        F.max(F.when(F.col("model") == challenger, F.col(metric))).alias("_challenger"),
        F.max(F.when(F.col("model") == incumbent, F.col(metric))).alias("_incumbent"),
    )
    wins = F.col("_challenger") > F.col("_incumbent")
    return on_split.select(
        F.when(wins, challenger).otherwise(incumbent).alias("model"),
        F.when(wins, F.col("_challenger")).otherwise(F.col("_incumbent")).alias(metric),
    )


def predicted_positives(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction") -> DataFrame:
    """Number and share of predicted positives."""
    p = F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.sum(p).cast("long").alias("predicted_positives"),
        F.avg(p).alias("prediction_rate"),
    )
