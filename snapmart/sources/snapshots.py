"""Snapshot tables: one table per subject, partitioned by snapshot date."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import date
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

T_ = TypeVar("T_")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, read with a given schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_snapshots(
    spark: SparkSession,
    path: str,
    start: date | str | None = None,
    end: date | str | None = None,
    date_col: str = "snapshot_date",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Snapshots dated within [start, end]; on a partitioned table only those are listed and read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return between_dates(reader.parquet(path), date_col, start, end)


def between_dates(
    df: DataFrame,
    date_col: str,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date_col) <= F.lit(end).cast("date"))
    return df


def outside_dates(
    df: DataFrame,
    date_col: str,
    start: date | str | None = None,
    end: date | str | None = None,
) -> DataFrame:
    """The rows that :func:`between_dates` leaves out, those without a date included if it does."""
    if start is None and end is None:
        return df.limit(0)
    day = F.col(date_col)
    outside = F.lit(False) if start is None else day < F.lit(start).cast("date")
    if end is not None:
        outside = outside | (day > F.lit(end).cast("date"))
    return df.filter(day.isNull() | outside)


def at_snapshot(df: DataFrame, on: date | str, date_col: str = "snapshot_date") -> DataFrame:
    """The rows of one snapshot."""
    return df.filter(F.col(date_col) == F.lit(on).cast("date"))


def write_snapshots(
    df: DataFrame,
    path: str,
    date_col: str = "snapshot_date",
    format: str = "parquet",
    rows: Observation | None = None,
    whole: bool = False,
) -> None:
    """Write every snapshot in ``df``, replacing those dates only and keeping all others.

    With ``whole`` the table holds nothing but ``df`` afterwards: dates without rows any more go.

    The rebalance hint shuffles by date and lets adaptive execution split a date that holds much
    of the rows over many tasks and merge small ones, so that files come out evenly sized.
    """
    if rows is not None:
        df = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    writer = (
        df.hint("rebalance", F.col(date_col))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(date_col)
    )
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def write_table(df: DataFrame, path: str, rows: Observation | None = None) -> None:
    """Write a table that holds no separate snapshots, replacing what was there."""
    if rows is not None:
        df = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    df.write.mode("overwrite").parquet(path)


def first_of_month(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.trunc(column.cast("date"), "MM")


def month_spine(start: Column, end: Column, source: DataFrame) -> DataFrame:
    """One row per first of month from ``start`` (floored to its month) to ``end``, inclusive.

    ``start`` and ``end`` are literals or aggregates of ``source``; only the two bounds leave the
    aggregation, so the spine costs one pass whatever the size of ``source``.
    """
    bounds = source.agg(start.cast("date").alias("first"), end.cast("date").alias("last"))
    return bounds.select(
        F.explode(
            F.sequence(F.trunc("first", "MM"), F.col("last"), F.expr("interval 1 month"))
        ).alias("snapshot_date")
    )


def months_before(spark: SparkSession, run_date: date | str, months: int, lag: int = 0) -> DataFrame:
    """The ``months`` monthly dates that end ``lag`` months before the run date."""
    return spark.range(lag, lag + months).select(
        F.add_months(F.lit(run_date).cast("date"), (-F.col("id")).cast("int")).alias("snapshot_date")
    )


def within_months_before(
    df: DataFrame, run_date: date | str | Column, months: int, lag: int = 0,
    date_col: str = "snapshot_date",
) -> DataFrame:
    """Rows of the snapshots in :func:`months_before`, as a range filter that prunes partitions.

    Months without data are simply absent from the result.
    """
    run = run_date if isinstance(run_date, Column) else F.lit(run_date).cast("date")
    return df.filter(
        (F.col(date_col) > F.add_months(run, -(months + lag)))
        & (F.col(date_col) <= F.add_months(run, -lag))
    )


def present_snapshots(spine: DataFrame, df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Spine dates that have data."""
    return spine.join(df.select(F.col(date_col).alias("snapshot_date")).distinct(), "snapshot_date")


def missing_snapshots(spine: DataFrame, df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Spine dates that have no data."""
    found = df.select(F.col(date_col).alias("snapshot_date")).distinct()
    return spine.join(found, "snapshot_date", "left_anti")


def newest_date(df: DataFrame, date_col: str = "snapshot_date") -> date | None:
    return df.agg(F.max(date_col)).first()[0]


def latest_snapshot(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot. Its date is looked up first, so that the scan can be pruned."""
    return df.filter(F.col(date_col) == F.lit(newest_date(df, date_col)))


def snapshot_counts(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    return df.groupBy(date_col).agg(F.count(F.lit(1)).alias("rows"))


def union_snapshots(*tables: DataFrame) -> DataFrame:
    """All rows of several snapshot tables, matched by column name; absent columns become NULL."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names.

    Only a local session that names none gets a local folder: on a cluster the machines would not
    see the same files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="snapmart-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# ---- what a job leaves on disk ---------------------------------------------------------------

# Rows that one part of a table should hold, bytes of source files, parts at most.
# Parts run one after the other, each with the cost of starting its jobs.
PART_ROWS, PART_BYTES, MOST_PARTS = 8_000_000, 256 * 1024 * 1024, 16


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are over, on all machines.

    It does so for shuffles that nothing refers to any more, once the driver's memory is collected:
    every half hour by itself, which a job that writes one table after the other does not wait for.
    """
    spark._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Delete the files of a saved table that nothing still to run reads."""
    spark = table.sparkSession
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def parts_for(rows: int) -> int:
    """In how many parts a table of so many rows is worked on."""
    return max(1, min(MOST_PARTS, math.ceil(rows / PART_ROWS)))


def even_runs(sizes: Sequence[tuple[T_, int]], parts: int) -> list[list[T_]]:
    """The things that have these sizes, in their order, in runs of about equal size."""
    whole, runs, before = max(sum(n for _, n in sizes), 1), {}, 0
    for thing, n in sizes:
        runs.setdefault(before * parts // whole, []).append(thing)
        before += n
    return list(runs.values())


def part_of(df: DataFrame, key: str, part: int, parts: int) -> DataFrame:
    """One of the parts of a table: all rows of a key are in the same, rows without one in some part."""
    return df if parts == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def write_in_parts(build: Callable[[int, int], DataFrame], path: str, parts: int) -> DataFrame:
    """Write ``build(part, parts)`` of one part after the other to one table and read it back.

    What the shuffles of a part take on disk is given back before the next one starts.
    """
    for part in range(parts):
        df = build(part, parts)
        schema, spark = df.schema, df.sparkSession
        df.write.mode("append").parquet(path)
        release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)
