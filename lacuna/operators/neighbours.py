"""k-nearest-neighbour imputation."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .blocks import ROWS_PER_BLOCK, candidate_pairs, make_blocks, nearest_in_pairs
from .clean import feature_array, feature_width


# Fixed value: up to so many rows per key, Spark's ranking windows drop the rest before the shuffle.
_LIMITED_BY_SPARK = 1000
_SALTS = 64


def distance_to_row(
    df: DataFrame, features: Sequence[str] | str, target: str, row: DataFrame, row_id: str = "line_id"
) -> DataFrame:
    """Distance of every known row to one given row.

    ``row`` is that single row; its features enter as one scalar subquery, so
    this is one scan of ``df`` without a join. Features are as in ``nearest``.
    """
    point = feature_array(row, features, target, row_id).select("features").scalar()
    # A column of its own, as a subquery can't stand inside a function of arrays.
    known = feature_array(df, features, target, row_id).where(F.col("value").isNotNull()).withColumn("point", point)
    squares = F.zip_with("features", "point", lambda a, b: (a - b) * (a - b))
    return known.select(
        F.col("line_id").alias("neighbour_id"),
        "value",
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)).alias("distance"),
    )


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Adds ``rank`` and keeps the first k rows of each key.

    Beyond the size up to which Spark limits groups before a shuffle, rows are
    ranked within salted parts of a key first, so no task gets a whole hot key.
    """
    if k > _LIMITED_BY_SPARK:
        salted = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
        within = Window.partitionBy(*keys, "salt").orderBy(*order)
        df = salted.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("rank", "salt")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _lowest_ids_per_place(known: DataFrame, k: int, also: Sequence[str] = ()) -> DataFrame:
    """Of known rows with equal features (and equal ``also``), the k lowest ids.

    Exact: such rows are equally far from everything and ties go to the lowest
    id, so no further copy can be among k neighbours. The limit is applied
    before the shuffle too, so a place that holds a third of all rows sends at
    most k rows per task and salt.
    """
    # Leading with a hash lets Spark sort by a number and look at the arrays
    # only where two hashes are equal.
    return _first(known.withColumn("place", F.xxhash64("features")), ["place", "features", *also], ["line_id"], k).drop("place", "rank")


@dataclass(frozen=True)
class Places:
    """The rows that a search reads, as a written table: the missing ones and the known ones without needless copies."""

    rows: DataFrame
    width: int
    k: int

    @property
    def known(self) -> DataFrame:
        return self.rows.where(F.col("value").isNotNull())

    @property
    def asking(self) -> DataFrame:
        return self.rows.where(F.col("value").isNull())

    def for_k(self, k: int) -> "Places":
        if self.k < k:
            raise ValueError(f"the places are for {self.k} neighbours, {k} are asked for")
        return self


def places_of(df: DataFrame, features: Sequence[str] | str, target: str, k: int, row_id: str = "line_id") -> Places:
    """``Places`` of ``df`` for up to k neighbours. Several searches over the same rows can share them."""
    points = feature_array(df, features, target, row_id)
    known = _lowest_ids_per_place(points.where(F.col("value").isNotNull()), k)
    rows = known.unionByName(points.where(F.col("value").isNull()).select(*known.columns))
    return Places(write_and_reread(rows, "places"), feature_width(df, features), k)


def nearest(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    k: int,
    row_id: str = "line_id",
    rows_per_block: int = ROWS_PER_BLOCK,
    places: Places | None = None,
) -> DataFrame:
    """The k nearest known rows of each row whose target is missing.

    Returns ``line_id, neighbour_id, value, d2, rank``; ``d2`` is the squared
    Euclidean distance, and equal distances are ordered by neighbour id.
    ``places``, made from the same arguments, saves making them here.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    width = feature_width(df, features)
    if not width:
        return feature_array(df, features, target, row_id).where("false").select(
            "line_id", F.col("line_id").alias("neighbour_id"), "value", F.lit(0.0).alias("d2"), F.lit(0).alias("rank")
        )
    places = (places or places_of(df, features, target, k, row_id)).for_k(k)
    blocks = make_blocks(places.rows, places.known, k, width, rows_per_block)
    if blocks.missing_rows and not blocks.known_rows:
        raise ValueError(f"{target!r} is missing in every usable row, so there is nothing to impute from")
    found = nearest_in_pairs(blocks, candidate_pairs(blocks, k, width), k, width).drop("since", "until")
    return _first(found, ["line_id"], ["d2", "neighbour_id"], k)


def nearest_by_step(
    df: DataFrame, features: Sequence[str] | str, target: str, step: str, ks: Sequence[int],
    row_id: str = "line_id", rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The nearest known rows at several steps of nested missingness, by one search.

    ``step`` is a column with the first step (from 0) at which a row's target is
    missing, or ``len(ks)`` if it never is; a row without a target is missing at
    all of them. ``ks`` has the number of neighbours for each step and must not
    fall. Returns ``line_id, step, neighbour_id, value, d2, rank``.
    """
    ks = list(ks)
    if not ks or min(ks) < 1 or sorted(ks) != ks:
        raise ValueError("ks must be at least 1 and must not fall")
    last = len(ks) - 1
    points = feature_array(df, features, target, row_id, [F.least(F.coalesce(F.col(step), F.lit(len(ks))), F.lit(len(ks))).cast("int").alias("step")])
    points = points.withColumn("step", F.when(F.col("value").isNull(), 0).otherwise(F.col("step")))
    width = feature_width(df, features)
    known = points.where(F.col("value").isNotNull() & (F.col("step") > 0)).withColumn("step", F.col("step") - 1)
    asking = points.where(F.col("step") <= last).withColumn("value", F.lit(None).cast("string"))
    blocks = make_blocks(points, _lowest_ids_per_place(known, ks[-1], ["step"]), ks[-1], width, rows_per_block, asking, last)
    if blocks.missing_rows and not blocks.known_rows:
        raise ValueError(f"{target!r} is missing in every usable row, so there is nothing to impute from")
    found = nearest_in_pairs(blocks, candidate_pairs(blocks, ks[-1], width), ks, width)
    each = found.withColumn("step", F.explode(F.sequence("since", "until"))).drop("since", "until")
    wanted = F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("step") + 1)
    return _first(each, ["line_id", "step"], ["d2", "neighbour_id"], ks[-1]).where(F.col("rank") <= wanted)


def votes(neighbours: DataFrame) -> DataFrame:
    """Neighbours per class: ``line_id, value, votes``."""
    return neighbours.groupBy("line_id", "value").agg(F.count("*").alias("votes"))


def majority(value: str = "value") -> Column:
    """Most frequent value; of equally frequent ones the lowest."""
    return F.mode(value, True)


def knn_impute(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    k: int,
    row_id: str = "line_id",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``line_id, imputed_value`` for the rows whose target is missing."""
    neighbours = nearest(df, features, target, k, row_id, rows_per_block)
    # Same key as the ranking window, so voting needs no further shuffle.
    return neighbours.groupBy("line_id").agg(majority().alias("imputed_value"))
