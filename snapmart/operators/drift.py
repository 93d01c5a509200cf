"""Feature drift between a baseline and a current snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Severity limits of the stability index, histogram size, share added to each bin.
MEDIUM_DRIFT, HIGH_DRIFT = 0.1, 0.25
BINS, EPS = 10, 1e-10


def severity(psi: Column, medium: float = MEDIUM_DRIFT, high: float = HIGH_DRIFT) -> Column:
    return F.when(psi < medium, "low").when(psi < high, "medium").otherwise("high")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(name: str) -> str:
    """SQL for the column as double, NaN as NULL."""
    return f"nullif(cast({_quoted(name)} as double), double('NaN'))"


def _literal(value: float | None) -> str:
    return "cast(null as double)" if value is None else f"double('{value!r}')"


def fit_edges(baseline: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """One row per feature: lower edge, upper edge and bin width over the baseline's range.

    All features are measured in one pass. A constant feature gets a range of half a unit to
    either side.
    """
    bounds = baseline.agg(
        *[F.expr(f"min({_number(f)})").alias(f"{i}_min") for i, f in enumerate(features)],
        *[F.expr(f"max({_number(f)})").alias(f"{i}_max") for i, f in enumerate(features)],
    )
    names = [f.replace("\\", "\\\\").replace("'", "\\'") for f in features]
    rows = ", ".join(f"'{n}', `{i}_min`, `{i}_max`" for i, n in enumerate(names))
    pad = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    return (
        bounds.selectExpr(f"stack({len(names)}, {rows}) as (feature, low, high)")
        .select("feature", (F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))
        .withColumn("width", (F.col("high") - F.col("low")) / bins)
    )


def _bin(value: Column, low: Column, high: Column, width: Column, bins: int) -> Column:
    """Bin number, counted by comparing with the inner edges; -1 outside the range.

    Dividing by the width instead would put some values that lie on an edge into the wrong bin.
    """
    above = [(value >= low + F.lit(i) * width).cast("int") for i in range(1, bins)]
    return F.when((value < low) | (value > high), -1).otherwise(sum(above[1:], above[0]))


def _binned(rows: DataFrame, edges: DataFrame, features: Sequence[str], bins: int, keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) pairs with the position of the feature and the value's bin; NULL and NaN are skipped."""
    # one row per feature; the edges become constants
    structs = ", ".join(
        f"named_struct('position', {features.index(e['feature'])}, "
        f"'value', {_number(e['feature'])}, 'low', {_literal(e['low'])}, "
        f"'high', {_literal(e['high'])}, 'width', {_literal(e['width'])})"
        for e in edges.collect()
    )
    if not structs:
        structs = "cast(null as struct<position:int,value:double,low:double,high:double,width:double>)"
    pairs = rows.selectExpr(*keep, f"inline(array({structs}))").filter(F.col("value").isNotNull())
    return pairs.withColumn("bin", _bin(F.col("value"), F.col("low"), F.col("high"), F.col("width"), bins))


def _named(counted: DataFrame, features: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features]) if features else F.array().cast("array<string>")
    return counted.withColumn("feature", names[F.col("position")]).drop("position")


def histogram(
    baseline: DataFrame,
    current: DataFrame,
    edges: DataFrame,
    features: Sequence[str],
    bins: int = BINS,
) -> DataFrame:
    """Per (feature, bin) and for both snapshots: count, mean, population variance.

    Rows are turned into (feature, value) pairs and merged before the shuffle, so that only one
    row per feature and bin leaves a task. NULL and NaN are skipped.
    """
    rows = baseline.select(F.lit(True).alias("is_base"), *features).unionByName(
        current.select(F.lit(False).alias("is_base"), *features)
    )
    pairs = _binned(rows, edges, features, bins, ["is_base"])
    of = {
        "base": F.when(F.col("is_base"), F.col("value")),
        "now": F.when(~F.col("is_base"), F.col("value")),
    }
    counted = pairs.groupBy("position", "bin").agg(
        *[F.count(v).alias(f"{p}_n") for p, v in of.items()],
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{p}_mean") for p, v in of.items()],
        *[F.coalesce(F.var_pop(v), F.lit(0.0)).alias(f"{p}_var") for p, v in of.items()],
    )
    return _named(counted, features)


def profile(df: DataFrame, edges: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Per (feature, bin) of one snapshot: the bin's edges, count, mean, population variance.

    A feature without values has no row. The result has at most ``bins + 1`` rows a feature,
    whatever the size of the snapshot; saved, it stands for the snapshot in later comparisons.
    """
    fields = ["low", "high", "width"]
    counted = _binned(df, edges, features, bins).groupBy("position", *fields, "bin").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
    )
    return _named(counted, features).select("feature", *fields, "bin", "n", "mean", "var")


def profile_edges(saved: DataFrame) -> DataFrame:
    """The edges that a profile was made with, as :func:`fit_edges` gives them."""
    return saved.select("feature", "low", "high", "width").distinct()


def profile_drift(baseline: DataFrame, current: DataFrame, eps: float = EPS) -> DataFrame:
    """:func:`drift` of two profiles that share the baseline's edges; no snapshot is read."""
    sides = [
        p.select("feature", "bin", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "mean", "var")])
        for name, p in (("base", baseline), ("now", current))
    ]
    both = sides[0].join(sides[1], ["feature", "bin"], "full_outer")
    return _compared(both.fillna(0, [c for c in both.columns if c not in ("feature", "bin")]), eps)


def drift(
    baseline: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    bins: int = BINS,
    eps: float = EPS,
) -> DataFrame:
    """Population stability index, severity, means and deviations per feature.

    Bins come from the baseline; values outside its range count in the share's denominator but in
    no bin. A feature without values in either snapshot is left out. All features are handled in
    one job.
    """
    return _compared(histogram(baseline, current, fit_edges(baseline, features, bins), features, bins), eps)


def _compared(bin_rows: DataFrame, eps: float) -> DataFrame:
    # one row per feature and bin from here on
    feature = Window.partitionBy("feature")
    whole = {}
    for p in ("base", "now"):
        n = F.sum(f"{p}_n").over(feature)
        whole[f"{p}_rows"] = n
        whole[f"{p}_center"] = F.try_divide(
            F.sum(F.col(f"{p}_n") * F.col(f"{p}_mean")).over(feature), n
        )

    def share(p: str) -> Column:
        return F.col(f"{p}_n") / F.col(f"{p}_rows") + F.lit(eps)

    def deviation(p: str) -> Column:
        """Sample deviation from the spread within bins and that of the bin means."""
        between = F.pow(F.col(f"{p}_mean") - F.col(f"{p}_center"), 2)
        squares = F.sum(F.col(f"{p}_n") * (F.col(f"{p}_var") + between))
        return F.sqrt(F.try_divide(squares, F.first(f"{p}_rows") - 1))

    term = (share("now") - share("base")) * F.ln(share("now") / share("base"))
    return (
        bin_rows.withColumns(whole)
        .filter((F.col("base_rows") > 0) & (F.col("now_rows") > 0))
        .groupBy("feature")
        .agg(
            F.coalesce(F.sum(F.when(F.col("bin") >= 0, term)), F.lit(0.0)).alias("psi"),
            F.first("base_center").alias("baseline_mean"),
            F.first("now_center").alias("current_mean"),
            deviation("base").alias("baseline_std"),
            deviation("now").alias("current_std"),
        )
        .withColumn("drift_severity", severity(F.col("psi")))
        .select(
            "feature", "psi", "drift_severity",
            "baseline_mean", "current_mean", "baseline_std", "current_std",
        )
    )


def top_drift(table: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` features that drifted most."""
    return table.orderBy(F.desc("psi"), "feature").limit(n)


def high_drift(table: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` features of high severity."""
    return top_drift(table.filter(F.col("drift_severity") == "high"), n)


def severity_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("drift_severity").agg(F.count(F.lit(1)).alias("features"))


def drift_summary(table: DataFrame) -> DataFrame:
    """One row: number of features, of each severity, and the share with high drift."""
    is_level = {level: F.col("drift_severity") == level for level in ("high", "medium", "low")}
    return table.agg(
        F.count(F.lit(1)).alias("features"),
        *[F.count_if(c).alias(level) for level, c in is_level.items()],
        F.avg(is_level["high"].cast("double")).alias("high_share"),
    )
