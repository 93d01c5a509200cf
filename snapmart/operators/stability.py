"""Stability of scores over snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.operators.ordering import cut_points, with_range

# Reported quantiles.
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
#: values a rank sketch keeps on its coarsest level; a sketch of so few rows is exact
SKETCH_SIZE = 800


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float] = QUANTILES,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Quantiles per group with linear interpolation between neighbours.

    The built-in exact percentile keeps every distinct value of a group in one task's memory.
    Here rows are counted per range of the value, which merges before the shuffle; values are ranked
    only in the ranges that hold a neighbour of a quantile.
    """
    usable = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"))
    if cuts is None:
        cuts = cut_points(usable, "_value")
    placed = with_range(usable, "_value", cuts)
    group = Window.partitionBy(*by)
    earlier = Window.unboundedPreceding, -1
    ranges = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "n_before": F.coalesce(F.sum("n").over(group.orderBy("_range").rowsBetween(*earlier)), F.lit(0)),
        "n_total": F.sum("n").over(group),
    })
    position = {name: F.lit(q) * (F.col("n_total") - 1) for name, q in quantiles.items()}

    def holds(rank):
        return (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))

    wanted = ranges.filter(
        reduce(lambda a, b: a | b, [holds(f(p)) for p in position.values() for f in (F.floor, F.ceil)])
    ).select(
        *[F.col(k).alias(f"_of_{k}") for k in by], F.col("_range").alias("_of"),
        F.col("n_before").alias("_lead"), "n_total",
    )
    alike = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]
    cells = placed.join(wanted, [*alike, F.col("_range") == F.col("_of")]).groupBy(
        *by, "_range", "_value"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("_lead").alias("_lead"), F.max("n_total").alias("n_total"))
    inside = Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(*earlier)
    ranked = cells.withColumn("n_before", F.col("_lead") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def at(rank):
        return F.max(F.when(holds(rank), F.col("_value")))

    neighbours = ranked.groupBy(*by).agg(
        F.max("n_total").alias("n_total"),
        *[at(F.floor(p)).alias(f"_{name}_low") for name, p in position.items()],
        *[at(F.ceil(p)).alias(f"_{name}_high") for name, p in position.items()],
    )
    return neighbours.select(
        *by,
        *[
            (
                F.col(f"_{name}_low")
                + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (p - F.floor(p))
            ).alias(name)
            for name, p in position.items()
        ],
    )


def stability(
    df: DataFrame,
    by: Sequence[str] = ("snapshot_date",),
    score: str = "probability",
    prediction: str = "prediction",
    accuracy: int | None = None,
) -> DataFrame:
    """Mean, sample deviation, quantiles of the score, prediction rate and row count per snapshot.

    Quantiles are exact; with ``accuracy`` they come from a mergeable sketch with relative rank
    error 1/accuracy, which saves ranking the scores.
    """
    basic = [
        F.avg(score).alias("mean_probability"),
        F.stddev_samp(score).alias("std_probability"),
        F.avg(F.col(prediction).cast("double")).alias("prediction_rate"),
        F.count(F.lit(1)).alias("total_predictions"),
    ]
    order = [*by, "mean_probability", "std_probability", "prediction_rate", *QUANTILES,
             "total_predictions"]
    if accuracy is not None:
        sketch = [
            F.percentile_approx(score, q, accuracy).alias(name) for name, q in QUANTILES.items()
        ]
        return df.groupBy(*by).agg(*basic, *sketch).select(*order)
    summary = df.groupBy(*by).agg(*basic)
    ranked = exact_quantiles(df, by, score).select(
        *[F.col(b).alias(f"_{b}") for b in by], *QUANTILES
    )
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return summary.join(ranked, same, "left").select(*order)


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Error of a sketched quantile's rank, as a share of the rows.

    The published error of these sketches is 2.296 / size**0.9021 at 99 %; 1.6 times that holds for
    all but one quantile in ten thousand, merged or not.
    """
    return 1.6 * 2.296 / size**0.9021


def score_states(
    df: DataFrame,
    by: Sequence[str] = ("snapshot_date",),
    score: str = "probability",
    prediction: str = "prediction",
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """What :func:`merged_stability` needs of each snapshot: counts, moments and a rank sketch.

    One pass, merged before the shuffle; a row for each snapshot, a few kilobytes whatever its size.
    """
    value = F.col(score).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_scores"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        F.count(prediction).alias("n_predictions"),
        F.sum(F.col(prediction).cast("double")).alias("positives"),
        F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"),
    )


def merged_stability(states: DataFrame, by: Sequence[str] = ("snapshot_date",), size: int = SKETCH_SIZE) -> DataFrame:
    """:func:`stability` over any grouping of saved states, without their rows.

    Mean, deviation, rate and row count are exact; quantiles are values of the table whose rank is
    within :func:`rank_error` of the one asked for.
    """
    whole = F.sum(F.col("n_scores") * F.col("mean")).over(Window.partitionBy(*by)) / F.nullif(
        F.sum("n_scores").over(Window.partitionBy(*by)), F.lit(0))
    spread = F.col("n_scores") * (F.col("var") + F.pow(F.col("mean") - F.col("_center"), 2))
    merged = states.withColumn("_center", whole).groupBy(*by).agg(
        F.max("_center").alias("mean_probability"),
        F.sqrt(F.sum(spread) / F.nullif(F.sum("n_scores") - 1, F.lit(0))).alias("std_probability"),
        (F.sum("positives") / F.nullif(F.sum("n_predictions"), F.lit(0))).alias("prediction_rate"),
        F.sum("n").alias("total_predictions"),
        F.sum("n_scores").alias("_scores"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("_sketch"),
    )
    value = lambda q: F.when(F.col("_scores") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(q)))
    return merged.select(
        *by, "mean_probability", "std_probability", "prediction_rate",
        *[value(q).alias(name) for name, q in QUANTILES.items()], "total_predictions",
    )


def rank_distances(
    df: DataFrame, quantiles: DataFrame, by: Sequence[str], score: str = "probability"
) -> DataFrame:
    """How far the exact rank of each quantile in ``quantiles`` lies from the one it stands for.

    Rows ``by, quantile, rows, distance``: distance is a share of the rows, 0 if the rank asked for
    falls on a row that has the value. One pass over ``df``, merged before the shuffle.
    """
    found = quantiles.select(*[F.col(b).alias(f"_{b}") for b in by], *QUANTILES)
    alike = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.lit(True))
    rows = df.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("_score")).join(found, alike)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("_score") < F.col(name)).alias(f"{name}_below") for name in QUANTILES],
        *[F.count_if(F.col("_score") <= F.col(name)).alias(f"{name}_upto") for name in QUANTILES],
    )

    def distance(name: str, q: float) -> Column:
        low, high = F.col(f"{name}_below") / F.col("rows"), F.col(f"{name}_upto") / F.col("rows")
        return F.greatest(low - q, q - high, F.lit(0.0))

    each = [
        F.struct(F.lit(name).alias("quantile"), "rows", distance(name, q).alias("distance"))
        for name, q in QUANTILES.items()
    ]
    return counts.select(*by, F.inline(F.array(*each)))


def newest_run(table: DataFrame, date_col: str = "snapshot_date", run_col: str = "monitoring_date") -> DataFrame:
    """Metric rows of several runs: per snapshot the one of the newest run."""
    columns = [c for c in table.columns if c != date_col]
    newest = table.groupBy(date_col).agg(F.max_by(F.struct(*columns), F.col(run_col)).alias("_row"))
    return newest.select(date_col, "_row.*").select(*table.columns)


def changes(
    table: DataFrame, names: Sequence[str], date_col: str = "snapshot_date"
) -> DataFrame:
    """Add ``<name>_change`` against the previous snapshot.

    ``table`` is a metric table with one row per snapshot, so one ordered window is enough.
    """
    in_time = Window.orderBy(date_col)
    return table.withColumns(
        {f"{c}_change": F.col(c) - F.lag(c).over(in_time) for c in names}
    )


def latest_row(table: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """The row of the newest snapshot of a metric table."""
    newest = table.agg(F.max_by(F.struct(*table.columns), F.col(date_col)).alias("_row"))
    return newest.filter(F.col("_row").isNotNull()).select("_row.*")


def stability_band(table: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Chart data: mean score with one deviation to either side, outer quantiles, rate."""
    mean, std = F.col("mean_probability"), F.col("std_probability")
    return table.select(
        date_col,
        mean,
        (mean - std).alias("band_low"),
        (mean + std).alias("band_high"),
        "p10",
        "p90",
        "prediction_rate",
    ).orderBy(date_col)
