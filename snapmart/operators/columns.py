"""Column-wise table operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapmart.functions import text


def apply_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns in one projection; values that do not fit become NULL."""
    def cast(name: str, kind: str) -> Column:
        if kind == "int":
            return text.to_int(F.col(name))
        return F.col(name).try_cast(kind)

    return df.withColumns({name: cast(name, kind) for name, kind in types.items()})


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.drop(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def not_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is false; a NULL flag excludes the row."""
    return df.filter(~F.col(flag))


def zero_fill(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL by 0 in the named columns, or in every numeric column."""
    if names is None:
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=list(names))


def stamp(df: DataFrame, **values: object) -> DataFrame:
    """Add run metadata as constant columns."""
    return df.withColumns(
        {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    )


def feature_columns(df: DataFrame, ids: Sequence[str]) -> list[str]:
    """The names of the numeric and boolean columns that are no ids."""
    usable = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if f.name not in ids and isinstance(f.dataType, usable)]


def fitted_values(stats: DataFrame) -> dict[str, Column]:
    """The one row of a fitted table as constants.

    Only this row reaches the driver. As constants, the values can be pushed into scans and are
    the same in every task, also in one that is run again after a loss.
    """
    row = stats.first()
    kinds = {f.name: f.dataType for f in stats.schema.fields}
    return {name: F.lit(row[name]).cast(kind) for name, kind in kinds.items()}
