"""Erasing target values and splitting rows, repeatably."""

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import below_percent, hash_text

_SPLIT_SALT = "split"


def erased_rows(percent: float, seed: int = 42, row_id: str = "line_id") -> Column:
    """True for the rows ``erase`` blanks; larger percents include smaller ones."""
    return below_percent(F.col(row_id), percent, seed)


def erase(df: DataFrame, target: str, percent: float, seed: int = 42, row_id: str = "line_id") -> DataFrame:
    """Blank ``target`` completely at random in about ``percent`` of the rows.

    A narrow projection: no shuffle, and the same rows on every evaluation.
    """
    return _blank(df, target, erased_rows(percent, seed, row_id))


def erase_exact(df: DataFrame, target: str, percent: float, seed: int = 42, row_id: str = "line_id") -> DataFrame:
    """Blank ``target`` in exactly ``rows * percent / 100`` rows, rounded, halves up."""
    return _blank(df, target, exactly_erased_rows(df, percent, seed, row_id))


def exactly_erased_rows(df: DataFrame, percent: float, seed: int = 42, row_id: str = "line_id") -> Column:
    """The condition behind ``erase_exact``: the rows first in (hash, id) order.

    Rather than sort the table, find the last row to erase: count rows per
    leading four hash digits, step into the group the cut falls in, count it by
    the next four, and order only the few rows of that last group. Each count
    has at most 65,536 groups of even size whatever the data, and erasing is
    then one comparison per row. Ids that repeat at the cut are refused.
    """
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must be within 0..100, not {percent}")
    marks = df.select(hash_text(F.col(row_id), seed).alias("mark"), F.col(row_id).alias("id"))
    prefix, left = "", None
    for _ in range(2):
        digits = len(prefix) + 4
        sizes = (
            marks.where(F.col("mark").startswith(prefix))
            .groupBy(F.substring("mark", 1, digits).alias("prefix"))
            .count()
            .orderBy("prefix")
            .collect()
        )
        if left is None:
            total = sum(group["count"] for group in sizes)
            left = int(total * Fraction(str(percent)) / 100 + Fraction(1, 2))
            if left in (0, total):
                return F.lit(left > 0)
        for group in sizes:
            if left <= group["count"]:
                prefix = group["prefix"]
                break
            left -= group["count"]
    near = (
        marks.where(F.col("mark").startswith(prefix))
        .orderBy("mark", "id")
        .limit(left + 1)
        .groupBy("mark", "id")
        .agg(F.count("*").alias("rows"))
        .orderBy("mark", "id")
        .collect()
    )
    last, seen = None, 0
    for last in near:
        seen += last["rows"]
        if seen >= left:
            break
    if seen > left:
        raise ValueError(f"{row_id!r} is no key: {last['id']!r} has several rows at the cut, so no exact number can be erased")
    mark = hash_text(F.col(row_id), seed)
    return (mark < F.lit(last["mark"])) | ((mark == F.lit(last["mark"])) & (F.col(row_id) <= F.lit(last["id"])))


def _blank(df: DataFrame, target: str, erased: Column) -> DataFrame:
    return df.withColumn(target, F.when(~erased, F.col(target)))


def in_training_part(percent: float = 70, seed: int = 1234, row_id: str = "line_id") -> Column:
    """True for the training share; independent of which rows are erased."""
    return below_percent(F.col(row_id), percent, f"{_SPLIT_SALT}:{seed}")


def split(df: DataFrame, percent: float = 70, seed: int = 1234, row_id: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Training and test part; every row is in exactly one of them."""
    training = in_training_part(percent, seed, row_id)
    return df.where(training), df.where(~training)
