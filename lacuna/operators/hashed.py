"""Approximate k-nearest neighbours by locality-sensitive buckets.

Each of several tables projects the features on a few random directions and cuts
every projection at its quantiles, so buckets hold about as many known rows as
wanted, whatever the data. Rows near each other mostly share a bucket in some
table. A missing row is compared with the known rows of its buckets only; the
distances are the true ones. What no table brings together is missed, which is
what makes the search approximate: its recall has to be measured.

Where one feature outweighs the others, all projections nearly agree and some
buckets are strips of many more rows than wanted. In those each run of missing
rows meets only the known rows that are near enough along the widest feature,
which finds the same neighbours as comparing all.

The cost is that of one bucket per table and row, so it grows in proportion to
the rows however many features there are, where the exact search of many
independent features is quadratic.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .blocks import _nearest_columns, _with_end
from .neighbours import Places, majority, nearest, places_of

TABLES, PROJECTIONS = 10, 2
#: Known rows that a bucket should hold, and the most cells that a projection is cut into.
BUCKET_ROWS, CELLS = 512, 512
#: Rows of either side that are compared in one task at once; fuller buckets are cut into tiles.
TILE = 8192
#: Known rows up to which a bucket is compared as a whole; beyond, in runs of so many asked rows along one feature,
#: each with at least so many known rows on either side.
SMALL, RUN, REACH = 512, 64, 64
#: Distances that are held at once in a small bucket, and rows that a task reads before it compares them.
CELLS_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 1 << 16
#: Lists of neighbours that a task merges, or hands on, at once.
LISTS_AT_ONCE = 1 << 14
#: Buckets up to which their sizes are broadcast.
MOST_BROADCAST = 1 << 22
#: Rows that a partition of the buckets should hold at most.
PARTITION_ROWS = 1 << 19


def _projector(directions: np.ndarray):
    """Arrow UDF from features to their projections."""
    width = directions.shape[1]

    @F.arrow_udf("array<double>")
    def project(features: pa.Array) -> pa.Array:
        rows = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return _lists(rows @ directions.T)

    return project


def _bucketer(directions: np.ndarray, cuts: list[np.ndarray], tables: int):
    """Arrow UDF from features to the bucket of each table; no two tables share a bucket."""
    width, each = directions.shape[1], len(directions) // tables

    @F.arrow_udf("array<bigint>")
    def buckets(features: pa.Array) -> pa.Array:
        rows = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        places = rows @ directions.T
        found = np.zeros((len(rows), tables), np.int64)
        for i, own in enumerate(cuts):
            table = i // each
            found[:, table] = found[:, table] * (CELLS + 1) + np.searchsorted(own, places[:, i], side="right")
        return _lists(found * tables + np.arange(tables))

    return buckets


def _lists(values: np.ndarray) -> pa.ListArray:
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(values).ravel()))


def _picked(d2: np.ndarray, k: int) -> np.ndarray:
    """Marks the k least per row; columns are in id order, so of equal distances the lowest ids come first."""
    if d2.shape[1] <= k:
        return np.ones(d2.shape, bool)
    inside = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1][:, None]
    tied = np.flatnonzero(inside.sum(axis=1) > k)
    inside[tied] = _nearest_columns(inside[tied], d2[tied], k)
    return inside


def _distances(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(asked), len(known)))
    for f in range(asked.shape[1]):
        apart = np.subtract.outer(asked[:, f], known[:, f])
        apart *= apart
        d2 += apart
    return d2


def _nearest_in_bucket(asked: np.ndarray, known: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``asked``, rows of ``known`` and squared distances of the up to k nearest; ``known`` is in id order.

    Runs of asked rows along the widest feature meet the known rows around them
    first. No row farther along that feature than the k-th distance found there
    can be nearer, so a fuller bucket costs each run only the rows within it.
    """
    if len(known) <= SMALL:
        run, lead = max(1, CELLS_AT_ONCE // len(known)), None
    else:
        run, lead = RUN, int(np.argmax(known.max(axis=0) - known.min(axis=0)))
        by_place = np.argsort(known[:, lead], kind="stable")
        places = known[by_place, lead]
    order = np.arange(len(asked)) if lead is None else np.argsort(asked[:, lead], kind="stable")
    for start in range(0, len(asked), run):
        mine = order[start:start + run]
        rows = asked[mine]
        columns = np.arange(len(known))
        if lead is None:
            d2 = _distances(rows, known)
        else:
            first, last = rows[0, lead], rows[-1, lead]
            a = max(0, int(np.searchsorted(places, first)) - REACH - k)
            b = min(len(known), int(np.searchsorted(places, last)) + REACH + k)
            columns = np.sort(by_place[a:b])
            d2 = _distances(rows, known[columns])
            if b - a < k:
                reach = np.inf
            else:
                # Taken as wider by more than a rounding, so that no row as near is left out.
                reach = np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1].max()) * (1 + 1e-12) + 1e-150
            to_a = min(a, int(np.searchsorted(places, np.nextafter(first - reach, -np.inf), side="left")))
            to_b = max(b, int(np.searchsorted(places, np.nextafter(last + reach, np.inf), side="right")))
            if (to_a, to_b) != (a, b):
                columns = np.sort(by_place[to_a:to_b])
                d2 = _distances(rows, known[columns])
        inside = _picked(d2, k)
        row, col = np.nonzero(inside)
        yield mine[row], columns[col], d2[inside]


def _compared(k: int, width: int):
    """Function for ``mapInArrow``: sorted rows in, up to k nearest known rows of a bucket's tile per missing row out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                waiting = table if waiting is None else pa.concat_tables([waiting, table])
                if waiting.num_rows < ROWS_AT_ONCE:
                    continue
            if waiting is None or not waiting.num_rows:
                continue
            bucket = waiting["bucket"].to_numpy()
            # The last bucket may go on in the next batch: keep its rows back.
            done = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1]))
            if not done:
                continue
            whole, waiting = waiting.slice(0, done).combine_chunks(), waiting.slice(done)
            bucket, tile = bucket[:done], whole["tile"].to_numpy()
            if tile.any():
                order = np.lexsort((tile, bucket))
                whole, bucket, tile = whole.take(pa.array(order)).combine_chunks(), bucket[order], tile[order]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1
            values = whole["value"].combine_chunks()
            is_known, ids = values.is_valid().to_numpy(zero_copy_only=False), whole["line_id"].to_numpy()
            rows = whole["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = []
            for start, end in zip([0, *cuts], [*cuts, done]):
                there, asked = np.flatnonzero(is_known[start:end]) + start, np.flatnonzero(~is_known[start:end]) + start
                if not len(there) or not len(asked):
                    continue
                there = there[np.argsort(ids[there], kind="stable")]
                out += [(asked[row], there[col], d2) for row, col, d2 in _nearest_in_bucket(rows[asked], rows[there], k)]
            if out:
                row, col, d2 = (np.concatenate(part) for part in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(ids[col]), values.take(pa.array(col)), pa.array(d2)],
                    names=["line_id", "neighbour_id", "value", "d2"],
                )

    return compare


def _listed(k: int, width: int):
    """As ``_compared``, with one row per missing row and bucket, which holds lists of its nearest."""
    compare = _compared(k, width)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in compare(batches):
            line = found["line_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            ends = pa.array(np.append(starts, len(line)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, found[name]) for name in ("neighbour_id", "value", "d2")]
            whole = pa.RecordBatch.from_arrays([pa.array(line[starts]), *lists], names=["line_id", "ids", "vals", "d2s"])
            yield from (whole.slice(i, LISTS_AT_ONCE) for i in range(0, len(starts), LISTS_AT_ONCE))

    return listed


def _merged(k: int):
    """Function for ``mapInArrow``: lists sorted by row in, the k nearest of each row with their rank out.

    Tables find the same neighbours; what they say of them is equal, so each counts once.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in _with_end(batches):
            if batch is not None:
                waiting.append(batch)
                rows += batch.num_rows
                if rows < LISTS_AT_ONCE:
                    continue
            if not rows:
                continue
            whole = pa.Table.from_batches(waiting)
            line = whole["line_id"].to_numpy()
            # The last row may have more lists in the next batch: keep them back.
            done = rows if batch is None else int(np.searchsorted(line, line[-1]))
            waiting, rows = whole.slice(done).to_batches(), rows - done
            if not done:
                continue
            whole = whole.slice(0, done).combine_chunks()
            lists = {name: whole[name].combine_chunks() for name in ("ids", "vals", "d2s")}
            line = np.repeat(line[:done], lists["ids"].value_lengths().to_numpy())
            ids, d2 = lists["ids"].flatten().to_numpy(), lists["d2s"].flatten().to_numpy()
            order = np.lexsort((d2, ids, line))
            same = (line[order[1:]] == line[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
            order = order[np.concatenate([[True], ~same])]
            order = order[np.lexsort((ids[order], d2[order], line[order]))]
            starts = np.flatnonzero(np.concatenate([[True], line[order[1:]] != line[order[:-1]]]))
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) + 1
            order, rank = order[rank <= k], rank[rank <= k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(line[order]), pa.array(ids[order]), lists["vals"].flatten().take(pa.array(order)), pa.array(d2[order]), pa.array(rank.astype(np.int32))],
                names=["line_id", "neighbour_id", "value", "d2", "rank"],
            )

    return merge


def nearest_hashed(
    df: DataFrame, features: Sequence[str] | str, target: str, k: int, row_id: str = "line_id",
    tables: int = TABLES, projections: int = PROJECTIONS, bucket_rows: int = BUCKET_ROWS, seed: int = 7,
    places: Places | None = None,
) -> DataFrame:
    """As ``nearest``, but some of the k nearest may be missed, and farther rows stand in for them.

    Returns ``line_id, neighbour_id, value, d2, rank`` with true squared
    distances. Every missing row gets k neighbours, if there are as many known
    places: rows whose buckets hold fewer are searched exactly. ``places`` is as in ``nearest``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    places = (places or places_of(df, features, target, k, row_id)).for_k(k)
    width, known, asking = places.width, places.known, places.asking
    n = known.count()
    cells = min(CELLS, math.ceil((n / bucket_rows) ** (1 / projections)))
    if not width or cells <= 1:
        return nearest(df, features, target, k, row_id, places=places)
    directions = np.random.default_rng(seed).standard_normal((tables * projections, width))
    shares = [i / cells for i in range(1, cells)]
    # As many numbers as there are cells reach the driver.
    projected = known.select(_projector(directions)("features").alias("p"))
    quantiles = projected.agg(*[F.percentile_approx(F.col("p")[i], shares, 1000).alias(f"cuts_{i}") for i in range(len(directions))]).first()
    bucketer = _bucketer(directions, [np.array(cuts) for cuts in quantiles], tables)
    both = known.unionByName(asking).select("line_id", "value", "features", bucketer("features").alias("buckets"))
    both = write_and_reread(both, "hashed")
    # Only buckets with rows of either side matter. Fuller ones are cut into tiles, of which every two meet.
    sizes = both.select("value", F.explode("buckets").alias("_bucket")).groupBy("_bucket").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("m"))
    sizes = sizes.where("n > 0 AND m > 0").select("_bucket", F.ceil(F.col("n") / TILE).alias("n_tiles"), F.ceil(F.col("m") / TILE).alias("m_tiles"))
    if tables * cells**projections <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)
    placed = both.withColumn("bucket", F.explode("buckets")).drop("buckets").join(sizes, F.col("bucket") == F.col("_bucket"))
    is_known, mark = F.col("value").isNotNull(), F.xxhash64("line_id")
    own_n, own_m, every = F.pmod(mark, F.col("n_tiles")), F.pmod(mark, F.col("m_tiles")), F.col("m_tiles")
    # A known row meets all parts of the missing side, a missing row all parts of the known one.
    meets = F.when(is_known, F.sequence(own_n * every, own_n * every + every - 1)).otherwise(
        F.sequence(own_m, own_m + (F.col("n_tiles") - 1) * every, every)
    )
    spread = placed.withColumn("tile", F.explode(meets))
    # Much work in few bytes: partitions by rows, as those by bytes would leave cores idle.
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(both.count() * tables / PARTITION_ROWS))
    dealt = spread.select("bucket", "tile", "line_id", "value", "features").repartition(parts, "bucket", "tile")
    # Spark sorts fastest by one number; the few buckets of several tiles are parted in the task.
    found = dealt.sortWithinPartitions("bucket").mapInArrow(
        _listed(k, width), "line_id bigint, ids array<bigint>, vals array<string>, d2s array<double>"
    )
    # A list per table is one row to move and sort; the neighbours in it are merged in the tasks.
    listed = found.repartition("line_id").sortWithinPartitions("line_id")
    ranked = listed.mapInArrow(_merged(k), "line_id bigint, neighbour_id bigint, value string, d2 double, rank int")
    ranked = write_and_reread(ranked, "ranked")
    full = ranked.where(F.col("rank") == min(k, n)).select(F.col("line_id").alias("_line"))
    short = write_and_reread(asking.select("line_id").join(full, F.col("line_id") == F.col("_line"), "left_anti"), "short")
    if short.isEmpty():
        return ranked
    rest = asking.join(short.select(F.col("line_id").alias("_line")), F.col("line_id") == F.col("_line"), "left_semi")
    exact = nearest(known.unionByName(rest.select(*known.columns)), "features", "value", k)
    kept = ranked.join(short.select(F.col("line_id").alias("_line")), F.col("line_id") == F.col("_line"), "left_anti")
    return kept.unionByName(exact.select(*kept.columns))


def knn_impute_hashed(df: DataFrame, features: Sequence[str] | str, target: str, k: int, row_id: str = "line_id", **options) -> DataFrame:
    """``line_id, imputed_value`` by the vote of the neighbours that ``nearest_hashed`` finds."""
    return nearest_hashed(df, features, target, k, row_id, **options).groupBy("line_id").agg(majority().alias("imputed_value"))
