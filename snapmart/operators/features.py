"""Feature preparation. Fitting and applying are separate steps, so that what is learned on one
range of snapshots can be saved and applied to later ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.functions.numbers import whole
from snapmart.operators.columns import fitted_values
from snapmart.operators.ordering import default_parts, running_totals
from snapmart.sources.snapshots import shared_folder, write_table


# ---- mean imputation -------------------------------------------------------------------------


def fit_means(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """One row: per column the mean over the rows whose flag is false. All in one pass."""
    return df.agg(
        *[F.avg(F.when(~F.col(flag), F.col(c))).alias(c) for c, flag in flags.items()]
    )


def impute(df: DataFrame, means: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Replace flagged values by the mean and truncate to int; unflagged NULL stays NULL."""
    mean = fitted_values(means)
    return df.withColumns(
        {
            c: whole(F.when(F.col(flag), mean[c]).otherwise(F.col(c)))
            for c, flag in flags.items()
        }
    )


# ---- frequency label encoding ----------------------------------------------------------------


def fit_indexes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (column, value, index): 0 for the most frequent value, ties in alphabetical order.

    All columns are counted in one pass. The values of a column are ranked by (count, value)
    without one task that sorts them all: equally frequent values are cut into alphabetical
    ranges at a sample of the values. What one task sees per column are the distinct counts and
    their ranges; there can be no more distinct counts than the square root of twice the rows.
    """
    pairs = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names])
        )
    )
    counts = (
        pairs.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # sampled and ranked from one evaluation
    path = shared_folder(df.sparkSession)
    write_table(counts, path)
    return rank_values(df.sparkSession.read.schema(counts.schema).parquet(path))


def rank_values(counts: DataFrame) -> DataFrame:
    """Rows (column, value, index) from counts (column, value, n), as :func:`fit_indexes`."""
    ranked = running_totals(
        counts.select(
            "column",
            "value",
            (-F.col("n")).alias("_less"),
            _text_range(F.col("value"), _sample_values(counts, "value")).alias("_range"),
            F.lit(1).cast("long").alias("index"),
        ),
        by=["column"],
        order=["value"],
        sums=["index"],
        ranges=["_less", "_range"],
    )
    return ranked.select("column", "value", F.col("index_before").cast("double").alias("index"))


def _sample_values(df: DataFrame, name: str) -> list[str]:
    """Values picked by their hash, in order: one per shuffle partition, so that ranges grow with it."""
    parts = default_parts(df.sparkSession)
    picked = (
        df.groupBy(F.pmod(F.xxhash64(name), F.lit(parts)).alias("_part"))
        .agg(F.min_by(name, F.xxhash64(F.lit(1), F.col(name))).alias("_value"))
        .collect()
    )
    return sorted({row["_value"] for row in picked}, key=lambda v: v.encode())


def _text_range(c: Column, cuts: Sequence[str]) -> Column:
    """How many of the sorted cut texts are not above the value, as a balanced tree of tests."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c < cuts[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts))


def encode(
    df: DataFrame, indexes: DataFrame, columns: Mapping[str, str]
) -> DataFrame:
    """Add the index of each value (``columns``: value column to index column).

    NULL and values that were not seen in fitting get the next free index. The index table is
    used once per column; where it was fitted in the same job, save it and read it back first.
    """
    sizes = indexes.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    known = {r["column"]: float(r["n"]) for r in sizes.filter(F.col("column").isin(*columns)).collect()}
    for name, out in columns.items():
        lookup = indexes.filter(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("index").alias("_index")
        )
        df = df.join(lookup, F.col(name).cast("string") == F.col("_value"), "left").select(
            *df.columns, F.coalesce("_index", F.lit(known.get(name, 0.0))).alias(out)
        )
    return df


# ---- standard scaling ------------------------------------------------------------------------


def fit_scaler(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation per column (1 for a constant column)."""
    moments = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in names],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in names],
    )
    return moments.select(
        *[f"{c}_mean" for c in names],
        *[F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")).alias(f"{c}_std")
          for c in names],
    )


def scale(df: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    fitted = fitted_values(scaler)
    return df.withColumns(
        {c: (F.col(c) - fitted[f"{c}_mean"]) / fitted[f"{c}_std"] for c in names}
    )


# ---- lists to columns ------------------------------------------------------------------------


def list_values(df: DataFrame, name: str, most: int = 1000) -> list[str]:
    """The distinct items of an array column, in order. They become columns, so more than
    ``most`` is an error rather than a truncated list."""
    found = df.select(F.explode(name).alias("item")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{name} holds more than {most} distinct items")
    return sorted(row["item"] for row in found)


def explode_list(df: DataFrame, name: str, out: str) -> DataFrame:
    """One row per array item; rows with an empty or NULL array drop out."""
    return df.withColumn(out, F.explode(name))


def multi_hot(
    df: DataFrame, name: str, values: Sequence[str], keys: Sequence[str] | None = None
) -> DataFrame:
    """Add one 0/1 column per value of an array column.

    With ``keys``, a row gets 1 if any row of its key holds the value. Items are tested in place
    and merged by key before the shuffle; the rows are not multiplied by exploding them. Only keys
    with several rows are joined back, from a saved table: where it is small, the wide rows
    stay where they are. Without ``keys`` it is a projection.
    """
    holds = {v: F.coalesce(F.array_contains(name, v), F.lit(False)).cast("int") for v in values}
    if keys is None:
        return df.withColumns(holds)
    merged = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(f"_{v}") for v, c in holds.items()]
    ).filter(F.col("_rows") > 1).drop("_rows")
    path = shared_folder(df.sparkSession)
    write_table(merged, path)
    merged = df.sparkSession.read.schema(merged.schema).parquet(path)
    # a row without a key, or alone with it, has no one to share with and keeps its own values
    return df.join(merged, list(keys), "left").select(
        *df.columns, *[F.coalesce(F.col(f"`_{v}`"), c).alias(v) for v, c in holds.items()]
    )


def pivot_flags(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str]) -> DataFrame:
    """One row per key with one 0/1 column per value of a plain column."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.max(F.lit(1))).fillna(0, list(values))
