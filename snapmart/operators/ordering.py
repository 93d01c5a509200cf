"""Exact running totals in sorted order when one group may hold a large part of all rows.

A window over a whole group runs in one task. Here each group is cut into consecutive ranges of
its sort order. A range is summed in its own task, and the totals of the ranges before it come
from a table with one row per range. Any cut points give the same exact result; they decide only
how even the tasks are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def default_parts(spark: SparkSession) -> int:
    """As many ranges as the session has shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def order_value(df: DataFrame, name: str) -> Column:
    """A double that never decreases when the column grows, for numeric, date and time columns.

    Dates count in seconds as times do, so that cut points of one also divide the other.
    """
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c) * F.lit(86400.0)
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(c.cast("date"))
        return day * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return c.cast("double")


def cut_points(df: DataFrame, name: str, parts: int | None = None) -> list[float]:
    """Values of a column that split it into about equally large ranges.

    Runs one pass over that column. Only the merged quantile summary, whose size depends on
    ``parts`` and not on the data, reaches the driver. The points enter later plans as constants,
    so a lost and recomputed task sees the same ranges.
    """
    parts = parts or default_parts(df.sparkSession)
    probabilities = [i / parts for i in range(1, parts)]
    values = df.select(order_value(df, name).alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    points = values.approxQuantile("v", probabilities, 1 / (2 * parts))
    return sorted({p for p in points if math.isfinite(p)})


def with_range(df: DataFrame, name: str, cuts: Sequence[float], out: str = "_range") -> DataFrame:
    """Number the range between cut points that each value lies in (NULL gets one of its own)."""
    # a bucketizer wants one cut at least; where it lies does not matter
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="_order", outputCol=out, handleInvalid="keep")
        .transform(df.withColumn("_order", order_value(df, name)))
        .drop("_order")
        .withColumn(out, F.col(out).cast("int"))
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    ranges: Sequence[str] = ("_range",),
) -> DataFrame:
    """Add ``<s>_before`` (total of the rows before, within ``by``) and ``<s>_total`` per summed column.

    ``ranges`` must follow the sort order of ``order``. Rows that tie in ``order`` should have
    been merged before. What the earlier ranges sum up to enters each range as one extra leading
    row, so rows with a NULL group are kept and no join is needed.
    """
    whole_group = Window.partitionBy(*by)
    earlier = whole_group.orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    per_range = df.groupBy(*by, *ranges).agg(*[F.sum(s).alias(s) for s in sums])
    lead = per_range.select(
        *by,
        *ranges,
        F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums],
        *[F.sum(s).over(whole_group).alias(f"{s}_total") for s in sums],
    )
    rows = df.withColumn("_row", F.lit(1))
    inside = Window.partitionBy(*by, *ranges).orderBy("_row", *order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    leading = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(lead, allowMissingColumns=True)
        .withColumns(
            {f"{s}_before": F.sum(s).over(before) for s in sums}
            | {f"{s}_total": F.first(f"{s}_total").over(leading) for s in sums}
        )
        .filter(F.col("_row") == 1)
        .drop("_row")
    )
