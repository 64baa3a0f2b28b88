import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import score_codes, score_detail, summarize
from lacuna.plans import METHODS, compare_grid, impute, run_experiment

DETAIL = "line_id long, original_value string, imputed_value string, error int"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        c = i % 3
        x, y = rng.normal(size=2) * 0.3
        rows.append((i, float(x + 3 * c), float(y - 2 * c), "abc"[c]))
    rows[7] = (*rows[7][:3], None)
    return spark.createDataFrame(rows, "line_id long, x double, y double, t string").cache()


def test_score_counts_null_originals_as_errors(spark):
    imputed = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "line_id long, imputed_value string")
    original = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (9, "b")], "line_id long, t string")
    detail = score_detail(imputed, original, "t").orderBy("line_id").collect()
    assert [tuple(r) for r in detail] == [(1, "a", "a", 0), (2, "b", "a", 1), (3, None, "a", 1)]


def test_score_codes_compares_codes(spark):
    imputed = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 0.0), (3, None, 0.0)], "line_id long, imputed_value string, imputed_code double"
    )
    original = spark.createDataFrame([(1, "a"), (2, "a"), (3, "unlisted")], "line_id long, t string")
    errors = {r.line_id: r.error for r in score_codes(imputed, original, "t", {"a": 1}).collect()}
    assert errors == {1: 0, 2: 1, 3: 0}


def test_summary(spark):
    detail = spark.createDataFrame([(1, "a", "a", 0), (2, "a", "b", 1), (3, "a", "b", 1)], DETAIL)
    assert [tuple(r) for r in summarize(detail).collect()] == [(3, 2, 200.0 / 3)]
    assert [tuple(r) for r in summarize(detail.where("line_id > 9")).collect()] == [(0, 0, None)]


@pytest.mark.parametrize("method", METHODS)
def test_experiment_scores_exactly_the_missing_rows(points, method):
    report = run_experiment(points, ["x", "y"], "t", method, 20)
    detail = report.detail.collect()
    assert report.detail.columns == ["line_id", "original_value", "imputed_value", "error"]
    truth = {r.line_id: r.t for r in points.collect()}
    assert all(truth[r.line_id] == r.original_value for r in detail)
    assert 7 in {r.line_id for r in detail}
    assert all(r.error == (r.original_value != r.imputed_value) for r in detail)
    n, wrong, percent = report.summary.first()
    assert n == len(detail) and wrong == sum(r.error for r in detail)
    assert percent == pytest.approx(100 * wrong / n) and percent < 15


def test_grid(points):
    grid = compare_grid(points, ["x", "y"], "t", methods=["knn", "tree"], percents=[10, 50], k="percent")
    rows = grid.collect()
    assert grid.columns == ["method", "percent", "n", "total_error", "avg_percent_error"]
    assert [(r.method, r.percent) for r in rows] == [("knn", 10), ("tree", 10), ("knn", 50), ("tree", 50)]
    assert rows[0].n == rows[1].n and rows[2].n == rows[3].n > rows[0].n
    alone = run_experiment(points, ["x", "y"], "t", "knn", 50, k=50).summary.first()
    assert tuple(alone) == tuple(rows[2])[2:]


def test_unknown_method(points):
    with pytest.raises(ValueError, match="method"):
        impute(points, ["x", "y"], "t", "other")


def test_only_needed_columns_are_read(spark, tmp_path):
    wide = spark.range(200).select(
        F.col("id").alias("line_id"), (F.col("id") % 7).cast("double").alias("x"), F.lit("u").alias("unused"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"),
    )
    wide.write.parquet(str(tmp_path / "w"))
    report = run_experiment(spark.read.parquet(str(tmp_path / "w")), ["x"], "t", "tree", 20)
    assert "unused" not in report.detail._jdf.queryExecution().executedPlan().toString()
