import pytest
from pyspark.sql import functions as F

from lacuna.functions import category_of, code_of, discover_codes, euclidean, is_number, percent_cut, to_double, to_long
from lacuna.plans import HEADACHE, IRIS


def values(df, name):
    return [row[name] for row in df.collect()]


@pytest.mark.parametrize(
    "text, numeric",
    [
        ("5.1", True), ("-3", True), ("+2.50", True), ("0", True), ("007", True),
        ("1e5", False), (".5", False), ("5.", False), (" 5", False), ("5 ", False), ("?", False),
        ("", False), (None, False), ("5\n", False), ("٣", False), ("NaN", False), ("--5", False), ("5.1.2", False),
    ],
)
def test_is_number_on_text(spark, text, numeric):
    df = spark.createDataFrame([(text,)], "v string")
    assert values(df.select(F.coalesce(is_number(F.col("v")), F.lit(False)).alias("ok")), "ok") == [numeric]
    assert df.where(is_number(F.col("v"))).count() == int(numeric)


def test_is_number_on_numeric_columns(spark):
    df = spark.createDataFrame([(1.0,), (1e12,), (1e-9,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    kept = df.where(is_number(F.col("v"), df.schema["v"].dataType))
    assert sorted(values(kept, "v")) == [1e-9, 1.0, 1e12]


def test_casts_give_null_for_other_text(spark):
    df = spark.createDataFrame([("5",), ("-7",), ("5.5",), ("1e5",), ("x",), (None,), ("99999999999999999999",)], "v string")
    assert values(df.select(to_long(F.col("v")).alias("n")), "n") == [5, -7, None, None, None, None, None]
    assert values(df.select(to_double(F.col("v")).alias("n")), "n") == [5.0, -7.0, 5.5, 1e5, None, None, 1e20]


@pytest.mark.parametrize("preset", [IRIS, HEADACHE])
def test_codes_round_trip(spark, preset):
    names = list(preset.codes)
    df = spark.createDataFrame([(n,) for n in [*names, "other", None]], "v string")
    coded = df.select(code_of(F.col("v"), preset.codes).alias("code"))
    assert values(coded, "code") == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert values(coded.select(category_of(F.col("code"), preset.codes).alias("v")), "v") == [*names, None, None]


def test_discover_codes_is_alphabetic_and_refuses_too_many(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    assert discover_codes(df, "v") == {"a": 1, "b": 2, "c": 3}
    with pytest.raises(ValueError, match="more than 2"):
        discover_codes(df, "v", max_classes=2)


def test_euclidean(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert values(df.select(euclidean([F.col("a"), F.col("b")], [F.col("c"), F.col("d")]).alias("x")), "x") == [5.0]


def test_percent_cut_bounds():
    assert percent_cut(0) == "00000000" and percent_cut(100) == "g" and percent_cut(50) == "80000000"
    with pytest.raises(ValueError):
        percent_cut(101)
