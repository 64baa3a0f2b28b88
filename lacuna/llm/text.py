"""Words and tables that several operators share."""

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: every ASCII character that is no digit and no small letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A lambda of a higher-order function computes the columns it refers to anew
    for each element, and adjacent projections are merged into one; bound as a
    lambda variable, the value is computed once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def lowered(text: Column) -> Column:
    """Only A-Z become small; null becomes an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def words_of(text: Column) -> Column:
    """Runs of digits, small letters and non-ASCII characters, in text order."""
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def bounded_sample(df: DataFrame, rows: int, seed: int, *keys: str) -> DataFrame:
    """About ``rows`` rows, never more, drawn from the whole table by a hash of ``keys``.

    A count sets the share that the hash lets through, so only about that many
    rows are sorted, however large the table is. Equal tables give equal samples.
    """
    n = df.count()
    chance = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))
    if n > 2 * rows:
        df = df.where(chance < int((1 << 40) * 1.2 * rows / n))
    return df.orderBy(chance, *keys).limit(rows)
