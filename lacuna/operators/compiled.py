"""Fitted learners as plain tables, and scoring by columns made from them.

A tree or forest becomes one row per node, a perceptron one row per weight. Such
a table can be stored, looked at and joined like any other, and rows are scored
by expressions that Spark compiles, or by any SQL engine that reads the table.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"
WEIGHTS = "layer int, source int, target int, weight double"


def node_table(spark: SparkSession, model: DecisionTreeClassificationModel | RandomForestClassificationModel) -> DataFrame:
    """One row per node: tree, node (the root is 1, children of n are 2n and 2n + 1), feature, threshold, left, right, shares.

    A row goes left if its feature is at most the threshold. Leaves have no
    feature; ``shares`` are the classes' shares of the training rows there.
    """
    trees = model.trees if isinstance(model, RandomForestClassificationModel) else [model]
    rows = []
    for number, tree in enumerate(trees):
        waiting = [(1, tree._call_java("rootNode"))]
        while waiting:
            node, at = waiting.pop()
            inner = at.getClass().getSimpleName() == "InternalNode"
            counts = list(at.impurityStats().stats())
            total = sum(counts)
            shares = [c / total if total else 0.0 for c in counts]
            split = at.split() if inner else None
            rows.append((number, node, *((split.featureIndex(), split.threshold(), 2 * node, 2 * node + 1) if inner else (None,) * 4), shares))
            if inner:
                waiting += [(2 * node, at.leftChild()), (2 * node + 1, at.rightChild())]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), NODES)


def _best(values: Sequence[Column]) -> Column:
    """Place of the greatest value, the first of equal ones."""
    most = F.greatest(*values) if len(values) > 1 else values[0]
    return F.coalesce(*[F.when(v == most, F.lit(i)) for i, v in enumerate(values)])


def tree_class(nodes: Sequence[Row], features: Column) -> Column:
    """Class index of an array of features, by the rows of a node table.

    Trees of a forest add up their leaves' shares; the first of the classes with
    the greatest sum wins.
    """
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes:
        trees.setdefault(row["tree"], {})[row["node"]] = row

    def leaf(own, node):
        row = own[node]
        if row["feature"] is None:
            return F.array(*[F.lit(float(s)) for s in row["shares"]])
        goes_left = F.get(features, F.lit(row["feature"])) <= F.lit(float(row["threshold"]))
        return F.when(goes_left, leaf(own, row["left"])).otherwise(leaf(own, row["right"]))

    found = [leaf(own, 1) for own in trees.values()]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), found)
    # array_position counts from 1 and finds the first.
    return (F.array_position(total, F.array_max(total)) - 1).cast("int")


def walk_nodes(points: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``line_id, class`` of ``points`` (line_id, features) by joins with a node table, level by level.

    For models too large for one expression: rows meet the nodes of one level at
    a time, and the leaves' shares are summed per row.
    """
    nodes = nodes.withColumnsRenamed({"tree": "_tree", "node": "_node"})
    trees = [F.lit(r["_tree"]) for r in nodes.where("_node = 1").select("_tree").orderBy("_tree").collect()]
    at = points.select("line_id", "features", F.explode(F.array(*trees)).alias("tree"), F.lit(1).alias("node"))
    done = []
    for _ in range(depth + 1):
        met = at.join(nodes, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")))
        done.append(met.where("feature IS NULL").select("line_id", F.posexplode("shares").alias("class", "share")))
        goes_left = F.get("features", F.col("feature")) <= F.col("threshold")
        at = met.where("feature IS NOT NULL").select("line_id", "features", "tree", F.when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"))
    shares = reduce(DataFrame.unionByName, done).groupBy("line_id", "class").agg(F.sum("share").alias("share"))
    return shares.groupBy("line_id").agg(F.max_by("class", F.struct("share", -F.col("class"))).alias("class"))


def weight_table(spark: SparkSession, model: MultilayerPerceptronClassificationModel, layers: Sequence[int]) -> DataFrame:
    """One row per weight: layer, source (null for the constant), target, weight; units count from 0."""
    flat, rows, at = model.weights.toArray().tolist(), [], 0
    for layer, (ins, outs) in enumerate(zip(layers, layers[1:])):
        # All targets of the first source, then of the next one; the constants come last.
        for source in [*range(ins), None]:
            for target in range(outs):
                rows.append((layer, source, target, flat[at]))
                at += 1
    if at != len(flat):
        raise ValueError(f"layers {list(layers)} need {at} weights, the model has {len(flat)}")
    return spark.createDataFrame(rows, WEIGHTS)


def perceptron_class(weights: Sequence[Row], features: Column) -> Column:
    """Class index of an array of features, by the rows of a weight table."""
    layers: dict[int, dict[int, list]] = {}
    for row in weights:
        layers.setdefault(row["layer"], {}).setdefault(row["target"], []).append((row["source"], row["weight"]))
    values = features
    for layer in sorted(layers):
        sums = []
        for _, entries in sorted(layers[layer].items()):
            terms = [F.lit(float(w)) * (F.lit(1.0) if source is None else F.get(values, F.lit(source))) for source, w in sorted(entries, key=lambda e: (e[0] is None, e[0]))]
            sums.append(reduce(lambda a, b: a + b, terms))
        if layer < max(layers):
            sums = [F.lit(1.0) / (F.lit(1.0) + F.exp(-s)) for s in sums]
            values = F.array(*sums)
    # Softmax keeps the order, so the greatest sum is the most probable class.
    return _best(sums)
