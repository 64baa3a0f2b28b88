"""Small blocks of nearby rows, and which pairs of blocks have to be compared.

Exact nearest neighbours without comparing all pairs:

1. rows are sorted along a Z-order curve over their features and cut into
   blocks of bounded size; known and missing rows share the blocks;
2. each block stores the box around its known rows, the box around its missing
   rows, and for each missing row a distance within which k known rows are
   certain to lie (measured on its neighbours along the curve);
3. blocks are grouped into a tree of boxes, and the missing side of each block
   walks down it, keeping a branch only if its box comes within that distance;
4. where a block's missing rows lie so wide apart that many branches remain,
   as around a dense cluster, each of them walks down the tree by itself.

Boxes say little about many features. Beyond ``UNROLLED`` of them, rows are sorted
along cells around centres from a bounded sample, the first of which are pivots:
each block also stores the range of its rows' distances to every pivot. By the
triangle inequality two blocks whose ranges are apart for any pivot are at least
as far apart, and a few rows near a pivot bound the k-th distance from above.

One search can also answer several steps of missingness at once, where a row that
is missing at one step stays so at the later ones. A known row counts up to its
last known step, a missing row asks from its first missing step on, and distances
that are certain are measured to rows known at the last step.

Skipping a branch never loses a neighbour. Sums run in feature order and
rounding is monotone, so a box distance never exceeds the distance of a row
inside the box, and the comparison is safe to the last bit.
"""

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

ROWS_PER_BLOCK = 1024
# Known rows looked at on each side of a missing row along the curve.
CURVE_REACH = 64
CURVE_BITS = 62
QUANTILE_STEPS = 128
# A tree node has at most 2**FAN_BITS children.
FAN_BITS = 4
# Up to this many features, box distances are written out term by term, which
# Spark compiles; beyond, they loop over arrays to keep the plan small, and
# pivots help to bound distances.
UNROLLED = 16
# Rows that centres are chosen from, centres of cells, and how many of them are pivots.
CENTRE_SAMPLE, CENTRES, PIVOTS = 4096, 256, 24
# Known rows looked at on each side of a missing row among many features.
WIDE_REACH = 1024
# Pivot distances are rounded; ranges are taken as wider by this share.
SLACK = 1e-9
# A block that keeps more branches than this at any level sends its rows singly.
BRANCHES = 256
# Node boxes are broadcast up to this many bytes and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20

BLOCK_SCHEMA = """
    part int, seq bigint, n int, m int,
    lo array<double>, hi array<double>, q_lo array<double>, q_hi array<double>,
    bound double,
    ids array<bigint>, vals array<string>, coords array<double>,
    q_ids array<bigint>, q_bounds array<double>, q_coords array<double>,
    c int, until array<int>, since array<int>,
    p_lo array<double>, p_hi array<double>, qp_lo array<double>, qp_hi array<double>, q_pivots array<double>
"""


@dataclass(frozen=True)
class Blocks:
    """The written block table and the few facts needed to plan the search."""

    table: DataFrame
    top: int
    known_rows: int
    missing_rows: int
    pivots: int = 0


def make_blocks(
    points: DataFrame, known: DataFrame, k: int, width: int, rows_per_block: int = ROWS_PER_BLOCK,
    asking: DataFrame | None = None, last_step: int = 0,
) -> Blocks:
    """Blocks over the missing rows of ``points`` and over ``known``.

    Both have columns ``line_id, value, features``; ``known`` is the known part
    of ``points`` without needless copies. With several steps, ``known`` has
    ``step``, the last at which a row is known, and ``asking`` the missing rows
    with the first step at which they are missing; ``k`` is for the last step.
    """
    if asking is None:
        known = known.withColumn("step", F.lit(0))
        asking = points.where(F.col("value").isNull()).withColumn("step", F.lit(0))
    rows, edges = _feature_quantiles(points, width)
    centres = _centres(points, width) if width > UNROLLED else np.zeros((0, width))
    curve = _curve_position(edges, _curve_steps(edges), centres)
    # Blocks end where a cell of about a block's size ends: where the curve
    # jumps, a block across the jump would have a needlessly large box.
    cell_bits = int(math.log2(max(1, rows / rows_per_block)))
    sorted_points = (
        known.unionByName(asking.select(*known.columns))
        .withColumn("z", curve("features"))
        # The id as second key lets a range boundary fall inside equal positions.
        .repartitionByRange("z", "line_id")
        .sortWithinPartitions("z", "line_id")
        .select(F.spark_partition_id().alias("part"), "line_id", "value", "features", "z", "step")
    )
    pack = _block_packer(k, width, rows_per_block, CURVE_BITS - cell_bits, centres[:PIVOTS], last_step)
    table = write_and_reread(sorted_points.mapInArrow(pack, BLOCK_SCHEMA), "blocks")
    facts = table.agg(
        F.coalesce(F.max("part"), F.lit(0)).alias("part"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("seq"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("known"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
    ).first()
    span = 1 << int(facts["seq"]).bit_length()
    return Blocks(
        table=table.withColumn("block", F.col("part").cast("bigint") * span + F.col("seq")),
        top=facts["part"] * span + facts["seq"],
        known_rows=facts["known"],
        missing_rows=facts["missing"],
        pivots=min(PIVOTS, len(centres)),
    )


def _centres(points: DataFrame, width: int) -> np.ndarray:
    """Centres of cells, in an order of short steps behind the first ``PIVOTS``.

    Chosen farthest first from a bounded sample, drawn by a hash of the id, so
    equal tables give equal centres. They steer the search only.
    """
    drawn = points.orderBy(F.xxhash64("line_id"), "line_id").limit(CENTRE_SAMPLE).select("features").collect()
    sample = np.array([r["features"] for r in drawn], np.float64).reshape(-1, width)
    if not len(sample):
        return sample
    gaps = np.full(len(sample), np.inf)
    chosen = [0]
    while len(chosen) < min(CENTRES, len(sample)):
        gaps = np.minimum(gaps, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if gaps.max() == 0:
            break
        chosen.append(int(gaps.argmax()))
    return sample[chosen]


def _chain(centres: np.ndarray) -> np.ndarray:
    """Rank of each centre along a path that always goes on to the nearest one left."""
    rank, at = np.full(len(centres), -1), 0
    for place in range(len(centres)):
        rank[at] = place
        gaps = ((centres - centres[at]) ** 2).sum(axis=1)
        gaps[rank >= 0] = np.inf
        at = int(gaps.argmin())
    return rank


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row to each centre."""
    found = np.empty((len(rows), len(centres)))
    for i, centre in enumerate(centres):
        found[:, i] = np.sqrt(((rows - centre) ** 2).sum(axis=1))
    return found


def _feature_quantiles(points: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Row count and about 129 quantiles per feature: all that the driver sees."""
    steps = [i / QUANTILE_STEPS for i in range(QUANTILE_STEPS + 1)]
    edges = np.zeros((width, QUANTILE_STEPS + 1))
    if width <= UNROLLED:
        # One row per point: no rows are made of its features.
        cuts = [F.percentile_approx(F.col("features")[i], steps, 1000).alias(f"edges_{i}") for i in range(width)]
        rows, *found = points.agg(F.count("*"), *cuts).first()
        if rows:
            edges[:] = found
        return rows, edges
    found = (
        points.select(F.posexplode("features").alias("feature", "v"))
        .groupBy("feature")
        .agg(F.count("*").alias("rows"), F.percentile_approx("v", steps, 1000).alias("edges"))
        .collect()
    )
    for row in found:
        edges[row["feature"]] = row["edges"]
    return (found[0]["rows"] if found else 0), edges


def _curve_steps(edges: np.ndarray) -> list[int]:
    """Which feature each bit of the curve halves: always the widest one left.

    Distances are unscaled, so narrow features are hardly ever halved and the
    cells come out about as wide in every direction.
    """
    low, high = QUANTILE_STEPS // 20, QUANTILE_STEPS - QUANTILE_STEPS // 20
    spread = edges[:, high] - edges[:, low]
    full = edges[:, -1] - edges[:, 0]
    spread = np.where(spread > 0, spread, full / QUANTILE_STEPS)
    steps: list[int] = []
    while len(steps) < CURVE_BITS and spread.max() > 0:
        widest = int(spread.argmax())
        steps.append(widest)
        spread[widest] /= 2
    return steps


def _curve_position(edges: np.ndarray, steps: list[int], centres: np.ndarray):
    """Arrow UDF from a feature array to its position on the curve.

    Features are first turned into approximate ranks, so crowded ranges get as
    many cells as their rows need. With centres, the nearest one's place on their
    path comes first, and the curve orders the rows of one cell.
    """
    order = _chain(centres)
    cell_bits = int(len(centres)).bit_length()
    ranks = {}
    for feature in set(steps):
        values, first = np.unique(edges[feature], return_index=True)
        ranks[feature] = (values, first / QUANTILE_STEPS)
    width = edges.shape[0]

    @F.arrow_udf("bigint")
    def position(features: pa.Array) -> pa.Array:
        rows = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        left = {
            f: np.minimum(np.interp(rows[:, f], values, rank), 1 - 2**-53)
            for f, (values, rank) in ranks.items()
        }
        z = np.zeros(len(rows), dtype=np.int64)
        for f in steps:
            doubled = left[f] * 2
            bit = doubled >= 1
            left[f] = doubled - bit
            z = (z << 1) | bit
        if len(centres):
            nearest = np.concatenate([_distances(rows[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])
            z = (order[nearest] << (CURVE_BITS - cell_bits)) | (z >> max(0, len(steps) - (CURVE_BITS - cell_bits)))
        return pa.array(z.astype(np.int64))

    return position


def _block_packer(k: int, width: int, rows_per_block: int, cell_shift: int, pivots: np.ndarray, last_step: int):
    """Function for ``mapInArrow``: sorted rows in, one row per block out."""
    window = max(WIDE_REACH if len(pivots) else CURVE_REACH, k)
    # Rows handled together: bounds the memory of the neighbour window.
    chunk = max(1, (1 << 22) // (2 * window * width))

    def bounds(queries, places, known):
        """Squared distance to the k-th nearest of the known rows around each query."""
        if len(known) < k:
            return np.full(len(queries), np.inf)
        offsets = np.arange(min(2 * window, len(known)))
        result = np.empty(len(queries))
        for start in range(0, len(queries), chunk):
            part = slice(start, start + chunk)
            first = np.clip(places[part] - window, 0, len(known) - len(offsets))
            near = first[:, None] + offsets
            total = np.zeros(near.shape)
            for f in range(width):
                gap = queries[part, f][:, None] - known[near, f]
                total += gap * gap
            result[part] = np.partition(total, k - 1, axis=1)[:, k - 1]
        return result

    def box(rows):
        if len(rows):
            return rows.min(axis=0).tolist(), rows.max(axis=0).tolist()
        return None, None

    def describe(part, seq, ids, values, rows, is_known, limits, steps):
        mine = np.flatnonzero(is_known)
        # Ascending ids make "first column" the same as "lowest id" later on.
        mine = mine[np.argsort(ids[mine], kind="stable")]
        asked = np.flatnonzero(~is_known)
        lo, hi = box(rows[mine])
        q_lo, q_hi = box(rows[asked])
        known_pivots, q_pivots = _distances(rows[mine], pivots), _distances(rows[asked], pivots)
        p_lo, p_hi = box(known_pivots)
        qp_lo, qp_hi = box(q_pivots)
        return {
            "c": len(mine), "until": steps[mine], "since": steps[asked],
            "p_lo": p_lo, "p_hi": p_hi, "qp_lo": qp_lo, "qp_hi": qp_hi, "q_pivots": q_pivots.ravel(),
            # Only rows that are known throughout bound a distance.
            "part": part, "seq": seq, "n": int((steps[mine] == last_step).sum()), "m": len(asked),
            "lo": lo, "hi": hi, "q_lo": q_lo, "q_hi": q_hi,
            "bound": float(limits[asked].max()) if len(asked) else None,
            "ids": ids[mine], "vals": values.take(pa.array(mine)).to_pylist(),
            "coords": rows[mine].ravel(),
            "q_ids": ids[asked], "q_bounds": limits[asked], "q_coords": rows[asked].ravel(),
        }

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        waiting = None
        schema = None
        earlier = np.empty((0, width))
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                waiting = table if waiting is None else pa.concat_tables([waiting, table])
                # Sorting happened upstream; wait for a fair run of rows.
                if waiting.num_rows < 8 * rows_per_block:
                    continue
            if waiting is None or not waiting.num_rows:
                continue
            whole = waiting.combine_chunks()
            ids = whole["line_id"].to_numpy()
            values = whole["value"].combine_chunks()
            rows = whole["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            is_known = values.is_valid().to_numpy(zero_copy_only=False)
            steps = whole["step"].to_numpy()
            firm = is_known & (steps == last_step)
            cells = whole["z"].to_numpy() >> cell_shift
            starts = [
                cut
                for a, b in _runs(cells)
                for cut in range(a, b, rows_per_block)
            ]
            # The last block may go on in the next batch: keep its rows back.
            done = len(cells) if batch is None else starts[-1]
            around = np.concatenate([earlier, rows[firm]])
            places = len(earlier) + np.cumsum(firm)
            limits = np.full(len(cells), np.inf)
            open_rows = ~is_known
            open_rows[done:] = False
            limits[open_rows] = bounds(rows[open_rows], places[open_rows], around)
            part = whole["part"][0].as_py()
            out = []
            for a, b in zip(starts, starts[1:] + [len(cells)]):
                if a >= done:
                    break
                cut = slice(a, b)
                out.append(describe(part, seq, ids[cut], values[cut], rows[cut], is_known[cut], limits[cut], steps[cut]))
                seq += 1
            finished = rows[:done][firm[:done]]
            earlier = np.concatenate([earlier, finished])[-window:]
            waiting = waiting.slice(done)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_block_arrow_schema())

    return pack


def _with_end(batches):
    """The batches, then ``None`` once."""
    yield from batches
    yield None


def _runs(cells: np.ndarray):
    """(start, end) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(cells)) + 1
    return zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cells)]]))


def _block_arrow_schema() -> pa.Schema:
    doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
    return pa.schema([
        ("part", pa.int32()), ("seq", pa.int64()), ("n", pa.int32()), ("m", pa.int32()),
        ("lo", doubles), ("hi", doubles), ("q_lo", doubles), ("q_hi", doubles),
        ("bound", pa.float64()),
        ("ids", longs), ("vals", pa.list_(pa.string())), ("coords", doubles),
        ("q_ids", longs), ("q_bounds", doubles), ("q_coords", doubles),
        ("c", pa.int32()), ("until", pa.list_(pa.int32())), ("since", pa.list_(pa.int32())),
        ("p_lo", doubles), ("p_hi", doubles), ("qp_lo", doubles), ("qp_hi", doubles), ("q_pivots", doubles),
    ])


def candidate_pairs(blocks: Blocks, k: int, width: int) -> DataFrame:
    """``(q_block, k_block, picks)``: every pair that may hold a k-nearest row.

    ``picks`` lists the missing rows to compare, as position in the block and
    squared distance beyond which nothing matters; null stands for all rows.
    """
    asking = blocks.table.where("m > 0")
    together = _write_spread(_block_walk(asking, blocks, k, width), blocks)
    pairs = together.withColumn("picks", F.lit(None).cast("array<struct<pos: int, reach: double>>"))
    # A block that was followed to the end has at least one pair.
    left_over = asking.join(together, F.col("block") == F.col("q_block"), "left_anti")
    if left_over.isEmpty():
        return pairs
    return pairs.unionByName(_write_spread(_row_walk(left_over, blocks, k, width), blocks))


def _write_spread(pairs: DataFrame, blocks: Blocks) -> DataFrame:
    """Write pairs evenly over files. They are few bytes but much work each, so
    partitions sized by bytes would leave most cores idle."""
    spark = pairs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.top + 1))
    return write_and_reread(pairs.repartition(parts, "q_block", "k_block"), "pairs")


def _block_walk(asking: DataFrame, blocks: Blocks, k: int, width: int) -> DataFrame:
    """``(q_block, k_block)`` for the blocks that stay with few branches all the way."""
    frontier = asking.select(F.col("block").alias("q_block"), "q_lo", "q_hi", "qp_lo", "qp_hi", F.col("bound").alias("reach"))
    # Dealt out by number: by bytes, one task would get them all.
    parts = 2 * asking.sparkSession.sparkContext.defaultParallelism
    frontier = frontier.repartition(parts, "q_block").withColumn("at", _first_nodes(blocks))
    # No group outgrows BRANCHES * 2**FAN_BITS rows. With broadcast nodes the
    # rows stay partitioned by block, so all levels together shuffle once.
    branches = Window.partitionBy("q_block")
    for nodes, found_by in _levels(blocks, width):
        reached = frontier.join(nodes, F.col("at") == found_by).select(
            "q_block", "q_lo", "q_hi", "qp_lo", "qp_hi", F.col("node").alias("at"),
            _box_gap(width, blocks.pivots).alias("gap"),
            F.least("reach", F.min(F.when(F.col("n") >= k, _box_span(width, blocks.pivots))).over(branches)).alias("reach"),
        )
        frontier = (
            reached.where("gap <= reach")
            .withColumn("open", F.count("*").over(branches))
            .where(F.col("open") <= BRANCHES)
            .drop("gap", "open")
        )
    return frontier.select("q_block", F.col("at").alias("k_block"))


def _row_walk(asking: DataFrame, blocks: Blocks, k: int, width: int) -> DataFrame:
    """``(q_block, k_block, picks)`` with every missing row walking down by itself."""
    point = F.slice("q_coords", F.col("pos") * width + 1, F.lit(width))
    to_pivots = F.slice("q_pivots", F.col("pos") * blocks.pivots + 1, F.lit(blocks.pivots))
    frontier = (
        asking.select(F.col("block").alias("q_block"), "q_coords", "q_pivots", F.posexplode("q_bounds").alias("pos", "reach"))
        .select("q_block", "pos", "reach", point.alias("q_lo"), to_pivots.alias("qp_lo"))
        .withColumns({"q_hi": F.col("q_lo"), "qp_hi": F.col("qp_lo"), "at": _first_nodes(blocks)})
    )
    row = ["q_block", "pos"]
    for nodes, found_by in _levels(blocks, width):
        reached = frontier.join(nodes, F.col("at") == found_by).select(
            *row, "q_lo", "q_hi", "qp_lo", "qp_hi", "reach", F.col("node").alias("at"), _box_gap(width, blocks.pivots).alias("gap"),
            F.when(F.col("n") >= k, _box_span(width, blocks.pivots)).alias("span"),
        )
        # One row may reach every node when features are many: an aggregate and
        # a join spread that over tasks, where a window would not. Written out,
        # since both of them read it.
        reached = write_and_reread(reached.where("gap <= reach"), "reached")
        caps = reached.groupBy(*row).agg(F.min("span").alias("cap"))
        frontier = (
            reached.join(caps, row)
            .withColumn("reach", F.least("reach", "cap"))
            .where("gap <= reach")
            .select(*row, "q_lo", "q_hi", "qp_lo", "qp_hi", "reach", "at")
        )
    # At most a block's worth of rows per pair.
    return frontier.groupBy("q_block", F.col("at").alias("k_block")).agg(
        F.collect_list(F.struct("pos", "reach")).alias("picks")
    )


def _first_nodes(blocks: Blocks) -> Column:
    """The few nodes at the top of the tree, one row each."""
    last = blocks.top >> _top_shift(blocks)
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))


def _top_shift(blocks: Blocks) -> int:
    return (max(blocks.top.bit_length() - 1, 0) // FAN_BITS) * FAN_BITS


def _levels(blocks: Blocks, width: int):
    """``(nodes, key)`` per level, top first; ``key`` is what the level above calls ``at``."""
    leaves = blocks.table.where("c > 0").select(
        F.col("block").alias("node"), F.col("n").cast("bigint").alias("n"), "lo", "hi", "p_lo", "p_hi"
    )
    for shift in range(_top_shift(blocks), -1, -FAN_BITS):
        nodes = _nodes_at(leaves, shift, width, blocks.pivots)
        # At most this many nodes can exist at this height, whatever the data.
        if ((blocks.top >> shift) + 1) * (16 * (width + blocks.pivots) + 64) <= BROADCAST_BYTES:
            nodes = F.broadcast(nodes)
        yield nodes, F.col("node") if shift == _top_shift(blocks) else F.shiftright("node", FAN_BITS)


def _nodes_at(leaves: DataFrame, shift: int, width: int, pivots: int) -> DataFrame:
    """Boxes and row counts of the tree nodes ``shift`` bits above the blocks."""
    if shift == 0:
        return leaves
    return leaves.groupBy(F.shiftright("node", shift).alias("node")).agg(
        F.sum("n").alias("n"),
        F.expr(f"array({', '.join(f'min(lo[{i}])' for i in range(width))})").alias("lo"),
        F.expr(f"array({', '.join(f'max(hi[{i}])' for i in range(width))})").alias("hi"),
        F.expr(f"array({', '.join(f'min(p_lo[{i}])' for i in range(pivots))})").cast("array<double>").alias("p_lo"),
        F.expr(f"array({', '.join(f'max(p_hi[{i}])' for i in range(pivots))})").cast("array<double>").alias("p_hi"),
    )


def _sum_of_squares(term: str, width: int) -> Column:
    """Sum of the squares of ``term``, feature by feature in order.

    In ``term``, ``{i}`` stands for the feature and ``{side}`` for where the
    boxes are found. It is SQL text because one parsed expression plans much
    faster than hundreds of column objects.
    """
    if width <= UNROLLED:
        terms = [term.replace("{side}", "").replace("{i}", f"[{i}]") for i in range(width)]
        return F.expr(" + ".join(f"({t}) * ({t})" for t in terms))
    inner = term.replace("{side}", "side.").replace("{i}", "")
    zipped = "arrays_zip(q_lo, q_hi, lo, hi)"
    return F.expr(f"aggregate({zipped}, 0D, (total, side) -> total + ({inner}) * ({inner}))")


def _box_gap(width: int, pivots: int = 0) -> Column:
    """Squared distance that two boxes are apart at least."""
    boxes = _sum_of_squares(
        "greatest({side}q_lo{i} - {side}hi{i}, {side}lo{i} - {side}q_hi{i}, 0D)", width
    )
    if not pivots:
        return boxes
    apart = f"greatest(p.qp_lo - p.p_hi, p.p_lo - p.qp_hi) - {SLACK}D * (p.p_hi + p.qp_hi)"
    ranges = F.expr(f"aggregate(arrays_zip(qp_lo, qp_hi, p_lo, p_hi), 0D, (most, p) -> greatest(most, {apart}))")
    return F.greatest(boxes, ranges * ranges)


def _box_span(width: int, pivots: int = 0) -> Column:
    """Squared distance that two boxes are apart at most."""
    boxes = _sum_of_squares("greatest({side}q_hi{i} - {side}lo{i}, {side}hi{i} - {side}q_lo{i})", width)
    if not pivots:
        return boxes
    around = F.expr(f"aggregate(arrays_zip(qp_hi, p_hi), double('infinity'), (least, p) -> least(least, (p.qp_hi + p.p_hi) * (1 + {SLACK}D)))")
    return F.least(boxes, around * around)


def nearest_in_pairs(blocks: Blocks, pairs: DataFrame, ks: int | Sequence[int], width: int) -> DataFrame:
    """Up to k nearest known rows per missing row within each pair of blocks.

    With several steps ``ks`` has a k for each, and a row that is among the
    nearest at any of them comes once, with the steps at which both sides take part.
    """
    ks = [ks] if isinstance(ks, int) else list(ks)
    asked = blocks.table.where("m > 0").select(F.col("block").alias("q_block"), "q_ids", "q_bounds", "q_coords", "q_pivots", "since")
    known = blocks.table.where("c > 0").select(F.col("block").alias("k_block"), "ids", "vals", "coords", "lo", "hi", "p_lo", "p_hi", "until")
    # The lighter missing side travels to the known side, which moves only once.
    work = pairs.join(asked, "q_block").join(known, "k_block").drop("q_block", "k_block")
    return work.mapInArrow(
        _pair_search(ks, width, blocks.pivots), "line_id bigint, neighbour_id bigint, value string, d2 double, since int, until int"
    )


def _gaps(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each row to a box, in the same order as everywhere."""
    total = np.zeros(len(rows))
    for f in range(rows.shape[1]):
        apart = np.maximum(np.maximum(rows[:, f] - hi[f], lo[f] - rows[:, f]), 0.0)
        total += apart * apart
    return total


def _nearest_columns(inside: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """Of the marked places at most the k nearest per row.

    Columns are in id order, so of equal distances the lowest ids take the room.
    """
    many = np.flatnonzero(inside.sum(axis=1) > k)
    if len(many):
        part = np.where(inside[many], d2[many], np.inf)
        kth = np.partition(part, k - 1, axis=1)[:, k - 1][:, None]
        closer, level = part < kth, part == kth
        room = k - closer.sum(axis=1, keepdims=True)
        inside[many] = closer | (level & (level.cumsum(axis=1) <= room))
    return inside


def _pair_search(ks: list[int], width: int, pivots: int):
    """Function for ``mapInArrow``: one input row per pair of blocks."""
    schema = pa.schema([
        ("line_id", pa.int64()), ("neighbour_id", pa.int64()), ("value", pa.string()), ("d2", pa.float64()),
        ("since", pa.int32()), ("until", pa.int32()),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}

            def numbers(name, i):
                return column[name][i].values.to_numpy(zero_copy_only=False)

            for i in range(batch.num_rows):
                limits = numbers("q_bounds", i)
                queries = numbers("q_coords", i).reshape(-1, width)
                q_ids, since, until = numbers("q_ids", i), numbers("since", i), numbers("until", i)
                to_pivots = numbers("q_pivots", i).reshape(len(q_ids), pivots)
                if column["picks"][i].is_valid:
                    picks = column["picks"][i].values
                    chosen = picks.field("pos").to_numpy()
                    queries, q_ids, since, to_pivots, limits = queries[chosen], q_ids[chosen], since[chosen], to_pivots[chosen], picks.field("reach").to_numpy()
                # Leave out rows beyond reach of the other side's box, on both sides.
                gaps = _gaps(queries, numbers("lo", i), numbers("hi", i))
                if pivots:
                    p_lo, p_hi = numbers("p_lo", i), numbers("p_hi", i)
                    apart = np.maximum(to_pivots - p_hi, p_lo - to_pivots) - SLACK * (p_hi + to_pivots)
                    gaps = np.maximum(gaps, np.maximum(apart.max(axis=1), 0) ** 2)
                near = np.flatnonzero(gaps <= limits)
                if not len(near):
                    continue
                queries, q_ids, since, limits = queries[near], q_ids[near], since[near], limits[near]
                known = numbers("coords", i).reshape(-1, width)
                near = np.flatnonzero(_gaps(known, queries.min(axis=0), queries.max(axis=0)) <= limits.max())
                if not len(near):
                    continue
                known = known[near]
                d2 = np.zeros((len(queries), len(known)))
                for f in range(width):
                    apart = np.subtract.outer(queries[:, f], known[:, f])
                    apart *= apart
                    d2 += apart
                inside, until = d2 <= limits[:, None], until[near]
                if len(ks) == 1:
                    inside = _nearest_columns(inside, d2, ks[0])
                else:
                    steps = [
                        _nearest_columns(inside & (since <= step)[:, None] & (until >= step), d2, k) for step, k in enumerate(ks)
                    ]
                    inside = np.logical_or.reduce(steps)
                row, col = np.divmod(np.flatnonzero(inside), len(known))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(q_ids[row]),
                            pa.array(numbers("ids", i)[near[col]]),
                            column["vals"][i].values.take(pa.array(near[col])),
                            pa.array(d2[row, col]),
                            pa.array(since[row]),
                            pa.array(until[col]),
                        ],
                        schema=schema,
                    )

    return search
