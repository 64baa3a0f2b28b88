"""Hard negatives of anchor vectors by a packed R-tree.

Vectors are whole numbers, compared by inner product. They are packed by
sort-tile-recursive: cut into slabs along one coordinate after another until a
tile holds few enough vectors for a task, and within a tile again down to leaves
and up to a root, so that every node of the tree has a minimum bounding box. A
box gives an interval for each product of a coordinate, and their sums bound the
inner product of the anchor with anything inside.

An anchor walks the nodes above the tiles by joins and drops those that cannot
matter; within a tile a best-first queue does the same, box by box. A box is
pruned if its interval lies outside all score windows that are still open, or its
upper end strictly below the k-th best score found so far; at equality a smaller
id could still win. The first scores come from the tile that the anchor itself is
in. Nothing is pruned that could be in a result, so results are exact.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

#: Factor that turns components into whole numbers.
SCALE = 256
#: Largest component after scaling; larger ones are set to it, so that scores fit into a long.
MOST = 1 << 22
#: Anchors are the rows whose id is divisible by this.
ANCHOR_STEP = 100
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's score must lie.
LOW, HIGH = 30, 90
#: Vectors a tile should hold, most slabs per cut (a power of 2), vectors per leaf, children per node.
TILE_ROWS, SLABS, LEAF, FAN = 16_384, 16, 256, 8
#: Anchors that search a tile in one call.
ANCHORS = 512
#: A tile too full for cuts to help is dealt out into at most so many.
PARTS = 1 << 20
#: Stands for a null id, which comes after all others, and for a missing bound.
NO_ID, NO_BOUND = 2**63 - 1, -(2**63)

_TILE = "width int, tile bigint, ids array<bigint>, labels array<bigint>, rows array<bigint>, vectors array<int>, lo array<bigint>, hi array<bigint>"
_BOX = "width int, node bigint, lo array<bigint>, hi array<bigint>"
_FOUND = "anchor bigint, place int, id bigint, row bigint, score bigint"


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, q, width) of the rows that take part; equal rows are one.

    Rows with a null label, a null or empty vector, or a null or non-finite
    component take no part. ``q`` holds floor(256 * x); a null vec_id stays null.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite, F.lit(False))

    def whole(x):
        return F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("bigint")

    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    moved = F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    rows = vectors.where(usable).select(vec_id.alias("vec_id"), moved.alias("label"), F.transform("embedding", whole).alias("q"), F.size("embedding").alias("width"))
    # Grouped by a hash first, so arrays are compared where it is equal.
    return rows.withColumn("h", F.xxhash64("q")).groupBy("h", "vec_id", "label", "q", "width").agg(F.lit(0).alias("one")).select(
        F.monotonically_increasing_id().alias("row"), "h", "vec_id", "label", "q", "width"
    )


def _marked(rows: DataFrame, step: int) -> DataFrame:
    """Adds ``anchor`` and ``searched``, and drops rows that are neither.

    Rows equal in vector and label tie in every score and the smaller id wins, so
    of each such group only as many ids as a result can hold need be searched,
    one more for positives, as an anchor is none of its own. Exact, and a vector
    that a third of all rows hold is no heavier than any other.
    """
    group = Window.partitionBy("h", "width", "label", "q").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    anchor = F.coalesce(F.col("vec_id") % step == 0, F.lit(False))
    few = rows.withColumn("place", F.row_number().over(group)).where(F.col("place") <= max(POSITIVES + 1, NEGATIVES))
    few = few.withColumn("searched", F.lit(True)).select("row", "vec_id", "label", "q", "width", "searched")
    # Anchors beyond those places only ask.
    asking = rows.where(anchor).join(few.select(F.col("row").alias("_row")), F.col("row") == F.col("_row"), "left_anti")
    more = asking.withColumn("searched", F.lit(False)).select(few.columns)
    return few.unionByName(more).withColumn("anchor", anchor)


def _tiled(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """Adds ``tile``; returns the number of cuts too.

    Each cut is one aggregation: quantiles of one coordinate per slab so far. A
    tile's number is its slab of every cut, ``SLABS`` to a digit, and then its
    part, for slabs that stay too full because of equal coordinates.
    """
    counted = F.sum(F.col("searched").cast("long"))
    tiled, cut = rows.withColumn("path", F.lit(0).cast("bigint")), 0
    while True:
        at = F.get("q", F.pmod(F.lit(cut), F.col("width")))
        sizes = tiled.groupBy("width", "path").agg(counted.alias("n"), F.percentile_approx(F.when(F.col("searched"), at), [i / SLABS for i in range(1, SLABS)], 1000).alias("all"))
        # One row of a few numbers per slab that is too full.
        full = write_and_reread(sizes.where(F.col("n") > tile_rows), "slabs").withColumnsRenamed({"width": "_width", "path": "_path"})
        most = full.agg(F.max("n")).first()[0]
        if most is None or cut > math.log(max(2, most), 2):
            break
        # As many slabs as make tiles of the wanted size, at most SLABS.
        slabs = F.least(F.lit(SLABS), F.ceil(F.col("n") / tile_rows))
        step = F.lit(SLABS) / slabs
        bounds = F.transform(F.sequence(F.lit(1), slabs.cast("int") - 1), lambda i: F.get("all", F.floor(i * step).cast("int") - 1))
        joined = tiled.join(full.select("_width", "_path", bounds.alias("bounds")), (F.col("width") == F.col("_width")) & (F.col("path") == F.col("_path")), "left")
        slab = F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b < at)))
        tiled = joined.withColumn("path", F.col("path") * SLABS + slab).drop("_width", "_path", "bounds")
        tiled, cut = write_and_reread(tiled, "tiled"), cut + 1
    parts = full.select("_width", "_path", F.least(F.lit(PARTS), F.ceil(F.col("n") / tile_rows)).alias("parts"))
    spread = tiled.join(parts, (F.col("width") == F.col("_width")) & (F.col("path") == F.col("_path")), "left")
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    return spread.withColumn("tile", F.col("path") * PARTS + part).drop("_width", "_path", "parts", "path"), cut


def pack(vectors: np.ndarray, order: np.ndarray, capacity: int, axis: int = 0) -> list[np.ndarray]:
    """Sort-tile-recursive: groups of at most ``capacity`` rows of ``vectors``, near in space."""
    pages = -(-len(order) // capacity)
    if pages <= 1:
        return [order]
    left = max(1, vectors.shape[1] - axis)
    slabs = max(2, int(np.ceil(pages ** (1 / left))))
    order = order[np.argsort(vectors[order, axis % vectors.shape[1]], kind="stable")]
    size = -(-pages // slabs) * capacity
    return [group for at in range(0, len(order), size) for group in pack(vectors, order[at:at + size], capacity, axis + 1)]


class PackedTree:
    """An R-tree over the rows of one tile, packed bottom up."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.leaves = pack(vectors, np.arange(len(vectors)), leaf)
        lo = np.array([vectors[rows].min(axis=0) for rows in self.leaves])
        hi = np.array([vectors[rows].max(axis=0) for rows in self.leaves])
        #: Children of each inner node, and boxes of all nodes; leaves come first, the root last.
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lo)
        level = np.arange(len(lo))
        while len(level) > 1:
            groups = pack(((lo + hi) // 2)[level], np.arange(len(level)), fan)
            own = [level[g] for g in groups]
            level = np.arange(len(lo), len(lo) + len(own))
            self.children += own
            lo = np.concatenate([lo, [lo[g].min(axis=0) for g in own]])
            hi = np.concatenate([hi, [hi[g].max(axis=0) for g in own]])
        self.lo, self.hi, self.vectors = lo, hi, vectors

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each node's box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T

    def search(self, least: np.ndarray, most: np.ndarray, wanted, visit) -> int:
        """Visits leaves best first; ``wanted(least, most)`` says whether a box may matter now. Returns the number of leaves."""
        root = len(self.children) - 1
        queue, visited = [(-most[root], root)], 0
        while queue:
            _, node = heapq.heappop(queue)
            if not wanted(least[node], most[node]):
                continue
            if node < len(self.leaves):
                visit(self.leaves[node])
                visited += 1
            else:
                for child in self.children[node]:
                    if wanted(least[child], most[child]):
                        heapq.heappush(queue, (-most[child], child))
        return visited


def _exact(anchors: np.ndarray, vectors: np.ndarray):
    """Both as doubles where every inner product is exact in them, else as whole numbers."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)
    kind = np.float64 if bound < 2**52 else np.int64
    return anchors.astype(kind), vectors.astype(kind)


class Best:
    """The k best of the rows offered so far: greatest score first, then smallest id."""

    def __init__(self, k: int, kth: int):
        self.k, self.kth = k, int(kth)
        self.rows = np.zeros((3, 0), np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores):
            all_rows = np.concatenate([self.rows, [scores.astype(np.int64), ids, rows]], axis=1)
            self.rows = all_rows[:, np.lexsort((all_rows[2], all_rows[1], -all_rows[0]))[: self.k]]
            if self.rows.shape[1] == self.k:
                self.kth = max(self.kth, int(self.rows[0, -1]))


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    values = column[i].values
    return (values.fill_null(NO_ID) if values.null_count else values).to_numpy(zero_copy_only=False)


def _pack_tile(key: tuple, group: pa.Table) -> pa.Table:
    """The rows of a tile as one row."""
    width = key[0].as_py()
    vectors = group.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    boxes = vectors.reshape(-1, width)
    lists = [*(group.column(c).combine_chunks() for c in ("vec_id", "label", "row")), pa.array(vectors.astype(np.int32)), pa.array(boxes.min(axis=0)), pa.array(boxes.max(axis=0))]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
    return pa.table([pa.array([width], pa.int32()), pa.array([key[1].as_py()]), *columns], ["width", "tile", "ids", "labels", "rows", "vectors", "lo", "hi"])


def _pack_node(key: tuple, group: pa.Table) -> pa.Table:
    """The box around the boxes of a node's children."""
    lo, hi = (np.array(group.column(c).to_pylist(), np.int64) for c in ("lo", "hi"))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()]), pa.array([lo.min(axis=0)], pa.list_(pa.int64())), pa.array([hi.max(axis=0)], pa.list_(pa.int64()))], ["width", "node", "lo", "hi"])


def _search(k: int, same_label: bool, low: int, high: int, leaf: int):
    """Function for ``mapInArrow``: one input row is a block of anchors and a tile.

    Each anchor has one or more open lists, each with its score window and the
    k-th best score that is known already: one of its own label without a window,
    or one of other labels per positive.
    """

    def one(anchor, own_id, label, scores, kths, tile, tree, least, most):
        ids, labels, rows, vectors = tile
        floors = np.full(len(kths), NO_BOUND) if same_label else -(-low * scores // 100)
        tops = np.full(len(kths), NO_ID) if same_label else high * scores // 100
        bests = [Best(k, kth) for kth in kths]
        limits = np.maximum(floors, kths)
        open_lists = limits <= tops

        def wanted(lowest, greatest):
            return bool(((greatest >= limits) & (lowest <= tops) & open_lists).any())

        def visit(found):
            found = found[(labels[found] == label) & (ids[found] != own_id)] if same_label else found[labels[found] != label]
            products = vectors[found] @ anchor
            for place, best in enumerate(bests):
                near = (products >= limits[place]) & (products <= tops[place])
                if near.any():
                    best.offer(products[near], ids[found[near]], rows[found[near]])
                    limits[place] = max(limits[place], best.kth)

        tree.search(least, most, wanted, visit)
        return bests

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            width = column["width"].to_pylist()
            for i in range(batch.num_rows):
                tile = [_numbers(column[name], i) for name in ("ids", "labels", "rows")]
                anchors, vectors = _exact(*(_numbers(column[name], i).reshape(-1, width[i]) for name in ("a_vectors", "vectors")))
                tree = PackedTree(vectors, leaf)
                least, most = tree.intervals(anchors)
                a_rows, a_ids, a_labels = (_numbers(column[name], i) for name in ("a_rows", "a_ids", "a_labels"))
                scores, kths = (column[name][i].as_py() for name in ("a_scores", "a_kths"))
                found = []
                for a in range(len(anchors)):
                    bests = one(anchors[a], a_ids[a], a_labels[a], np.array(scores[a], np.int64), np.array(kths[a], np.int64), [*tile, vectors], tree, least[a], most[a])
                    for place, best in enumerate(bests):
                        head = np.repeat([[a_rows[a]], [place]], best.rows.shape[1], axis=1)
                        found.append(np.concatenate([head, best.rows]))
                anchor, place, score, ids, rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(rows), pa.array(score)],
                    ["anchor", "place", "id", "row", "score"],
                )

    return search


def _box(vectors: Column, pick) -> Column:
    """Least or greatest of each coordinate over an array of vectors."""
    return F.aggregate(vectors, F.element_at(vectors, 1), lambda box, v: F.zip_with(box, v, lambda a, b: pick(a, b)))


def _blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of at most about ``ANCHORS`` anchors of one tile, with the box around them and the bounds of their lists.

    ``anchors`` has width, tile, row, vec_id, label, q, scores and kths.
    """
    sizes = anchors.groupBy(F.col("width").alias("_width"), F.col("tile").alias("_tile")).agg(F.ceil(F.count("*") / ANCHORS).alias("parts"))
    placed = anchors.join(sizes, (F.col("width") == F.col("_width")) & (F.col("tile") == F.col("_tile"))).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    all_of = placed.groupBy("width", "tile", "part").agg(F.collect_list(F.struct("row", "vec_id", "label", "q", "scores", "kths")).alias("a"))
    return all_of.select(
        F.monotonically_increasing_id().alias("block"), "width", F.col("tile").alias("own"), F.col("a.row").alias("a_rows"), F.col("a.vec_id").alias("a_ids"), F.col("a.label").alias("a_labels"),
        F.flatten("a.q").alias("a_vectors"), F.col("a.scores").alias("a_scores"), F.col("a.kths").alias("a_kths"),
        _box(F.col("a.q"), F.least).alias("a_lo"), _box(F.col("a.q"), F.greatest).alias("a_hi"),
    )


def _interval(pick) -> Column:
    """Least or greatest possible inner product between the boxes of a block and a node."""
    corners = F.arrays_zip("a_lo", "a_hi", "lo", "hi")
    return F.aggregate(corners, F.lit(0).cast("bigint"), lambda total, c: total + pick(c["a_lo"] * c["lo"], c["a_lo"] * c["hi"], c["a_hi"] * c["lo"], c["a_hi"] * c["hi"]))


class _Index:
    """Written tiles, and the boxes of the nodes above them by level."""

    def __init__(self, rows: DataFrame, cuts: int):
        tiles = rows.where("searched").groupBy("width", "tile").applyInArrow(_pack_tile, _TILE)
        self.tiles = write_and_reread(tiles, "tiles")
        boxes = self.tiles.select("width", F.col("tile").alias("node"), "lo", "hi")
        levels = [boxes]
        for fan in [PARTS, *[SLABS] * cuts]:
            up = levels[0].withColumn("node", F.floor(F.col("node") / fan))
            levels.insert(0, write_and_reread(up.groupBy("width", "node").applyInArrow(_pack_node, _BOX), "nodes"))
        self.levels, self.fans = levels, [1, *[SLABS] * cuts, PARTS]

    def pairs(self, blocks: DataFrame) -> DataFrame:
        """(block, tile): the other tiles that may matter to a block; its box and limits walk down level by level."""
        reach = blocks.select("block", "width", "own", "a_lo", "a_hi", "floor", "top").withColumn("at", F.lit(0).cast("bigint"))
        for boxes, fan in zip(self.levels, self.fans, strict=True):
            nodes = boxes.withColumns({"parent": F.floor(F.col("node") / fan), "_width": F.col("width")}).drop("width")
            met = reach.join(nodes, (F.col("width") == F.col("_width")) & (F.col("at") == F.col("parent")))
            near = (_interval(F.greatest) >= F.col("floor")) & (_interval(F.least) <= F.col("top"))
            reach = met.where(near).withColumn("at", F.col("node")).select(reach.columns)
        return reach.where("at <> own").select("block", F.col("at").alias("tile"))

    def search(self, blocks: DataFrame, pairs: DataFrame, name: str, *how) -> DataFrame:
        """anchor, place, id, row, score of what the blocks find in their paired tiles."""
        asked = pairs.withColumnsRenamed({"tile": "_tile", "block": "_block"}).join(blocks, F.col("block") == F.col("_block")).withColumnRenamed("width", "_width")
        work = self.tiles.join(asked, (F.col("width") == F.col("_width")) & (F.col("tile") == F.col("_tile")))
        work = work.select("width", "ids", "labels", "rows", "vectors", "a_rows", "a_ids", "a_labels", "a_vectors", "a_scores", "a_kths")
        return write_and_reread(work.mapInArrow(_search(*how), _FOUND), name)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _two_rounds(index: _Index, anchors: DataFrame, k: int, name: str, same_label: bool, low: int, high: int, leaf: int) -> DataFrame:
    """The k best per anchor and list: first from the anchor's own tile, then from all tiles that can still matter."""
    how = (k, same_label, low, high, leaf)
    limits = [F.lit(NO_BOUND), F.lit(NO_ID)] if same_label else [F.ceil(F.array_min("all") * low / 100), F.floor(F.array_max("all") * high / 100)]
    blocks = write_and_reread(_blocks(anchors), "blocks")
    near = index.search(blocks, blocks.select("block", F.col("own").alias("tile")), name, *how)
    known = _first(near, k).where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("known"))
    again = anchors.drop("kths").join(known.withColumnRenamed("anchor", "_anchor"), F.col("row") == F.col("_anchor"), "left")
    places = F.sequence(F.lit(0), F.size("scores") - 1)
    kths = F.transform(places, lambda p: F.coalesce(F.try_element_at("known", p), F.lit(NO_BOUND)))
    blocks = write_and_reread(_blocks(again.withColumn("kths", kths)), "blocks")
    # What a box must reach: the lowest limit and the highest window of any list in the block.
    known_low = F.array_min(F.flatten("a_kths"))
    bounded = blocks.withColumn("all", F.flatten("a_scores")).withColumns({"floor": F.greatest(limits[0].cast("bigint"), known_low), "top": limits[1].cast("bigint")})
    far = index.search(blocks, index.pairs(bounded), name, *how)
    return _first(near.unionByName(far), k)


def hard_negatives(
    vectors: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, tile_rows: int = TILE_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``vectors`` (vec_id, embedding, label).

    An anchor's positives are the best other rows of its label; for each, the
    best rows of other labels whose score lies within ``low`` to ``high`` percent
    of the positive's score are its negatives. Equal scores go by the smaller id,
    a null id last. Rows that equal each other in all three columns count as one,
    unlike rows with one id each take part, but none is a positive of its own id.
    Vectors of different widths are not compared. Rows with a null label or
    vector, an empty vector or a null or non-finite component take no part.
    """
    if max(positives + 1, negatives) > max(POSITIVES + 1, NEGATIVES):
        raise ValueError(f"at most {POSITIVES} positives and {NEGATIVES} negatives")
    rows = write_and_reread(usable_vectors(vectors), "usable")
    tiled, cuts = _tiled(write_and_reread(_marked(rows, anchor_step), "marked"), tile_rows)
    tiled = write_and_reread(tiled, "tiled")
    index = _Index(tiled, cuts)
    anchors = tiled.where("anchor").drop("searched", "anchor")
    none = F.array(F.lit(NO_BOUND))
    best = _two_rounds(index, anchors.withColumns({"scores": none, "kths": none}), positives, "positives", True, 0, 0, leaf)
    best = write_and_reread(best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "best")
    # At most as many entries per anchor as it has positives.
    scores = best.groupBy(F.col("anchor").alias("_anchor")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("_anchor")).drop("_anchor")
    asked = write_and_reread(asked.withColumn("kths", F.transform("scores", lambda s: F.lit(NO_BOUND))), "asked")
    found = _two_rounds(index, asked, negatives, "negatives", False, low, high, leaf)
    names = anchors.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"))
    chosen = best.withColumnsRenamed({"anchor": "_anchor", "place": "_place"})
    return found.join(chosen, (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place"))).join(names, F.col("anchor") == F.col("_row")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
