"""Projection, numeric row filter and feature casts."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import is_number, to_double


def project_attributes(df: DataFrame, attributes: Sequence[str], row_id: str = "line_id") -> DataFrame:
    """Keep the row id and the listed attributes, nothing else."""
    return df.select(row_id, *attributes)


def filter_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose ``columns`` (default: all) all hold a number.

    One conjunction, so the null checks reach the file scan together.
    """
    names = list(df.columns if columns is None else columns)
    if not names:
        return df
    return df.where(reduce(and_, [is_number(F.col(c), df.schema[c].dataType) for c in names]))


def cast_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the listed columns into doubles in place."""
    return df.withColumns({c: to_double(F.col(c)) for c in columns})


def _array_is_numeric(name: str):
    values = F.col(name).cast("array<double>")
    infinity = F.lit(float("inf"))
    return F.col(name).isNotNull() & F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != infinity)
    )


def feature_width(df: DataFrame, features: Sequence[str] | str) -> int:
    """Number of features of a row; 0 for an array column without any array.

    ``features`` is a list of columns or the name of one, which may hold arrays;
    arrays of different lengths are refused.
    """
    if not isinstance(features, str):
        return len(features)
    if not isinstance(df.schema[features].dataType, T.ArrayType):
        return 1
    widths = df.where(F.col(features).isNotNull()).agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"{features!r} holds arrays of {widths[0]} to {widths[1]} values")
    return widths[0] or 0


def feature_array(
    df: DataFrame, features: Sequence[str] | str, target: str, row_id: str = "line_id", also: Sequence[str] = ()
) -> DataFrame:
    """Clean rows as ``row_id, target, features array<double>``, and the columns ``also``.

    ``features`` is a list of columns, or the name of one array column that
    already holds all of them.
    """
    if isinstance(features, str) and isinstance(df.schema[features].dataType, T.ArrayType):
        clean = df.where(_array_is_numeric(features))
        values = F.col(features).cast("array<double>")
    else:
        names = [features] if isinstance(features, str) else list(features)
        if target in names:
            raise ValueError(f"target {target!r} cannot be a feature too")
        clean = filter_numeric(df, names)
        values = F.array(*[to_double(F.col(c)) for c in names])
    return clean.select(
        F.col(row_id).cast("bigint").alias("line_id"),
        F.col(target).cast("string").alias("value"),
        values.alias("features"),
        *also,
    )
