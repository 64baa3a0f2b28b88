"""Euclidean distance as plain column arithmetic."""

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Sum of squared differences, added in the order the features are given."""
    if len(left) != len(right) or not left:
        raise ValueError("both sides need the same features, at least one")
    return reduce(add, [(a - b) * (a - b) for a, b in zip(left, right)])


def euclidean(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return F.sqrt(squared_distance(left, right))
