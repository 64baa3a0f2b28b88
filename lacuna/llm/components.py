"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread


def _lowest(directed: DataFrame) -> DataFrame:
    """(a, low): the lowest neighbour of each node, written so that a join can deal its rows anew."""
    return write_and_reread(directed.groupBy("a").agg(F.min("b").alias("low")), "lowest")


def _pointed(directed: DataFrame, larger_only: bool) -> DataFrame:
    """Points the neighbours of each node, and the node, to the lowest of them."""
    low = _lowest(directed).select(F.col("a").alias("_a"), F.least("a", "low").alias("low"))
    joined = directed.join(low, F.col("a") == F.col("_a"))
    if larger_only:
        joined = joined.where(F.col("b") > F.col("a"))
    to = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("_a").alias("a"), F.col("low").alias("b")))
    return to.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the lowest node reachable.

    Large-star and small-star steps in turn, each written as a table, until every
    node points straight at a root. A hub's edges are spread by its neighbours
    and summed before each shuffle. Edges with a null end and loops add nothing.
    """
    edges = write_and_reread(
        edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while True:
        nodes = edges.groupBy("a").agg(F.count("*").alias("n"))
        several = nodes.where("n > 1").limit(1).count()
        if not several and not edges.join(nodes.select(F.col("a").alias("_a")), F.col("b") == F.col("_a"), "left_semi").limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = write_and_reread(_pointed(both, larger_only=True), "edges")
        edges = write_and_reread(_pointed(edges, larger_only=False), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
