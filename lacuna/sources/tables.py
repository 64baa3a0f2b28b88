"""Table sources."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

#: Bits of a generated id that hold the row's place in its file.
ROW_BITS = 40


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every column stays text, blank lines are skipped."""
    return spark.read.option("header", True).csv(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_text(df: DataFrame) -> DataFrame:
    """The same rows with every column as text, as a CSV reader would give them."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def with_row_id(df: DataFrame, key: str | None = None, name: str = "line_id") -> DataFrame:
    """Add a ``bigint`` row id, once, before anything is erased.

    With ``key`` the id is that natural key and costs nothing. Rows read from
    parquet files get the place of their file and of the row in it, which every
    job sees alike. Other rows are numbered and written out, because such
    numbers follow the splits.
    """
    if key is not None:
        return df.withColumn(name, F.col(key).cast("bigint"))
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return write_and_reread(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    if {"_file", "_row"} & set(df.columns):
        return write_and_reread(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    # One row per file, numbered by path; no data column is read for it.
    files = df.select(F.col("_metadata.file_path").alias("_path")).distinct()
    numbered = files.select("_path", (F.row_number().over(Window.orderBy("_path")) - 1).cast("bigint").alias("_place"))
    # Broadcast, as a join by path would send all rows of a file to one task.
    joined = placed.join(F.broadcast(numbered), F.col("_file") == F.col("_path"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft("_place", ROW_BITS) + F.col("_row")).alias(name))
