"""Repeatable pseudo-random marks computed from a row's own id.

A mark depends on nothing but the seed and the id, so it needs no shuffle, is
the same in every job, on every retry of a lost task and in other SQL engines.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(row_id: Column, seed: int | str) -> Column:
    """32 hexadecimal digits, spread evenly over the ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def percent_cut(percent: float) -> str:
    """Text below which ``percent`` of all hash texts sort.

    Hash texts are compared as text, so no number parsing is needed. ``g``
    sorts after every hexadecimal digit and stands for 100 percent.
    """
    if not 0 <= percent <= 100:
        raise ValueError(f"percent must be within 0..100, not {percent}")
    cut = math.ceil(percent * 2**32 / 100)
    return "g" if cut >= 2**32 else f"{cut:08x}"


def below_percent(row_id: Column, percent: float, seed: int | str) -> Column:
    """True for about ``percent`` of the rows; sets are nested as percent grows."""
    return hash_text(row_id, seed) < F.lit(percent_cut(percent))
