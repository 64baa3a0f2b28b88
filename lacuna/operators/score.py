"""Scoring imputed values against the originals."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import Encoder, code_of, to_text


def score_detail(
    imputed: DataFrame, original: DataFrame, target: str, row_id: str = "line_id", also: Sequence[str] = ()
) -> DataFrame:
    """``line_id, original_value, imputed_value, error`` with error 0 or 1, and the columns ``also`` of ``imputed``.

    Give ``original`` narrowed to the rows of interest where possible; only its
    id and target are read. Spark picks the join from the sizes it sees.
    """
    truth = original.select(
        F.col(row_id).cast("bigint").alias("line_id"), to_text(F.col(target)).alias("original_value")
    )
    return imputed.join(truth, "line_id").select(
        "line_id",
        "original_value",
        "imputed_value",
        (~F.col("imputed_value").eqNullSafe(F.col("original_value"))
         | F.col("original_value").isNull()).cast("int").alias("error"),
        *also,
    )


def score_codes(
    imputed: DataFrame, original: DataFrame, target: str, codes: Mapping[str, int] | Encoder, row_id: str = "line_id"
) -> DataFrame:
    """As ``score_detail``, but comparing ``imputed_code`` with the original's code."""
    truth = original.select(
        F.col(row_id).cast("bigint").alias("line_id"),
        to_text(F.col(target)).alias("original_value"),
        code_of(F.col(target), codes.encode if isinstance(codes, Encoder) else codes).alias("original_code"),
    )
    return imputed.join(truth, "line_id").select(
        "line_id",
        "original_value",
        "imputed_value",
        (F.col("imputed_code") != F.col("original_code")).cast("int").alias("error"),
    )


def summarize(detail: DataFrame) -> DataFrame:
    """One row ``n, total_error, avg_percent_error``; the percent of nothing is null."""
    errors = F.count_if(F.col("error") == 1)
    return detail.agg(
        F.count("*").alias("n"),
        errors.alias("total_error"),
        F.try_divide(errors * F.lit(100.0), F.count("*")).alias("avg_percent_error"),
    )
