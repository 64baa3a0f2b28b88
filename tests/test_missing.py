import pytest
from pyspark.sql import functions as F

from lacuna.operators import erase, erase_exact, split


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20000).select(F.col("id").alias("line_id"), F.lit("x").alias("t"))


def erased(df):
    return {r["line_id"] for r in df.where("t IS NULL").collect()}


def test_share_is_close_and_sets_are_nested(rows):
    sets = [erased(erase(rows, "t", p)) for p in (0, 10, 20, 30, 40, 50, 100)]
    for percent, found in zip((0, 10, 20, 30, 40, 50, 100), sets):
        assert abs(len(found) - 200 * percent) < 300
    assert all(a <= b for a, b in zip(sets, sets[1:]))
    assert len(sets[0]) == 0 and len(sets[-1]) == 20000


def test_same_seed_same_rows_whatever_the_partitions(rows):
    assert erased(erase(rows, "t", 10)) == erased(erase(rows.repartition(13), "t", 10))
    assert erased(erase(rows, "t", 10, seed=1)) != erased(erase(rows, "t", 10, seed=2))


@pytest.mark.parametrize("percent, count", [(0, 0), (7, 1400), (33, 6600), (100, 20000)])
def test_exact_count(rows, percent, count):
    assert len(erased(erase_exact(rows, "t", percent))) == count


def test_exact_on_few_rows_and_rounding(spark):
    few = spark.range(5).select(F.col("id").alias("line_id"), F.lit("x").alias("t"))
    assert len(erased(erase_exact(few, "t", 50))) == 3
    assert len(erased(erase_exact(few, "t", 10))) == 1
    assert len(erased(erase_exact(few.where("line_id < 0"), "t", 10))) == 0


def test_exact_takes_the_first_in_hash_order(rows):
    import hashlib

    order = sorted(range(20000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert erased(erase_exact(rows, "t", 13)) == set(order[:2600])


def test_split_is_complete_and_apart(rows):
    train, test = split(rows)
    assert abs(train.count() - 14000) < 300
    assert train.count() + test.count() == 20000
    assert train.join(test, "line_id").count() == 0


def test_erasing_needs_no_shuffle(rows):
    plan = erase(rows, "t", 10)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
