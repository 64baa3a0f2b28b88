"""Category <-> numeric code, with code 0 for "missing or unknown"."""

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs for part in pair])


def code_of(column: Column, codes: Mapping[str, int] | Callable[[Column], Column]) -> Column:
    """Numeric code of a category; null and unlisted categories give 0.0.

    ``codes`` is a mapping, or a function from the column to a column of codes,
    such as an expression or a pandas UDF; where it gives null the code is 0.0.
    """
    if callable(codes):
        return F.coalesce(codes(column).cast("double"), F.lit(0.0))
    table = _literal_map((name, float(code)) for name, code in codes.items())
    return F.coalesce(F.try_element_at(table, column.cast("string")), F.lit(0.0))


def category_of(column: Column, codes: Mapping[str, int]) -> Column:
    """Category of a numeric code; code 0 and unlisted codes give null."""
    table = _literal_map((int(code), name) for name, code in codes.items())
    return F.try_element_at(table, column.cast("int"))


@dataclass(frozen=True)
class Encoder:
    """An expression from categories to codes, and the way back.

    ``codes`` lists the categories that codes are turned back into. Codes are
    whole numbers from 1; 0 stands for missing or unknown.
    """

    encode: Callable[[Column], Column]
    codes: Mapping[str, int]

    @property
    def classes(self) -> int:
        """The greatest code."""
        return max(self.codes.values(), default=0)


def fit_encoder(df: DataFrame, target: str, encode: Callable[[Column], Column], max_classes: int = 1000) -> Encoder:
    """The encoder of an expression, its way back found by one aggregation of ``target``.

    Where several categories have one code, it is turned back into the first of
    them in alphabetic order. Only that table reaches the driver; more than
    ``max_classes`` codes, fractions and codes below 0 are refused.
    """
    code = code_of(F.col(target), encode)
    found = df.where(F.col(target).isNotNull()).groupBy(code.alias("code")).agg(F.min(F.col(target).cast("string")).alias("category"))
    listed = found.where("code <> 0").limit(max_classes + 1).collect()
    if len(listed) > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} codes")
    if any(r["code"] < 0 or r["code"] != int(r["code"]) for r in listed):
        raise ValueError("codes must be whole numbers from 0")
    return Encoder(encode, {r["category"]: int(r["code"]) for r in sorted(listed, key=lambda r: r["code"])})


def as_encoder(codes: Mapping[str, int] | Encoder) -> Encoder:
    """A mapping as an encoder: its codes must be 1..n, one for each category."""
    if isinstance(codes, Encoder):
        return codes
    if sorted(codes.values()) != list(range(1, len(codes) + 1)):
        raise ValueError("codes must be 1..n, one for each category")
    return Encoder(lambda column: code_of(column, codes), codes)


def discover_codes(df: DataFrame, target: str, max_classes: int = 1000) -> dict[str, int]:
    """Codes 1..n for the categories found in ``target``, in alphabetic order.

    Only the distinct categories reach the driver, and no more than
    ``max_classes`` of them: a target with more is refused, not cut.
    """
    found = (
        df.where(F.col(target).isNotNull())
        .select(F.col(target).cast("string").alias("category"))
        .distinct()
        .limit(max_classes + 1)
        .collect()
    )
    if len(found) > max_classes:
        raise ValueError(f"{target!r} has more than {max_classes} categories")
    return {name: i + 1 for i, name in enumerate(sorted(r.category for r in found))}
