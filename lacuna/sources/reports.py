"""Report sinks. Rows go straight from the executors to files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_detail(detail: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scored rows, sorted by id across the files."""
    detail.orderBy("line_id").write.mode(mode).parquet(path)


def store_cell(rows: DataFrame, path: str, method: str, percent: float) -> None:
    """Rows of one cell of a comparison in a table with partitions by method and percent.

    An earlier result of the same cell is replaced; other cells stay.
    """
    cell = rows.withColumns({"method": F.lit(method), "percent": F.lit(float(percent))})
    cell.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "percent").parquet(path)


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One-row summaries or a comparison grid, as a single small file."""
    summary.coalesce(1).write.mode(mode).parquet(path)
