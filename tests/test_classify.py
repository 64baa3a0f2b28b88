import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import erase, forest_impute, in_training_part, perceptron_impute, tree_impute
from lacuna.plans import IRIS

IMPUTERS = [tree_impute, forest_impute, perceptron_impute]


@pytest.fixture(scope="module")
def flowers(spark):
    """Three well separated classes in the iris shape, as text."""
    rng = np.random.default_rng(0)
    rows = []
    for c, name in enumerate(IRIS.codes):
        for values in rng.normal(loc=[5 + c, 3 - c / 2, 1.5 + 2 * c, 0.3 + c], scale=0.2, size=(60, 4)):
            rows.append([f"{abs(v):.2f}" for v in values] + [name])
    rows[3][1] = "?"
    rows = [[i, *row] for i, row in enumerate(rows)]
    schema = "line_id long, " + ", ".join(f"{c} string" for c in (*IRIS.features, IRIS.target))
    return spark.createDataFrame(rows, schema).cache()


def run(impute, df, **options):
    out = impute(df, IRIS.features, IRIS.target, IRIS.codes, **options)
    assert out.columns == ["line_id", "imputed_value", "imputed_code"]
    return {r.line_id: (r.imputed_value, r.imputed_code) for r in out.collect()}


@pytest.mark.parametrize("impute", IMPUTERS)
def test_known_mode_fills_every_clean_missing_row(flowers, impute):
    damaged = erase(flowers, IRIS.target, 30)
    found = run(impute, damaged)
    missing = {r.line_id for r in damaged.where(F.col(IRIS.target).isNull()).collect()} - {3}
    assert set(found) == missing
    assert all(IRIS.codes[name] == code for name, code in found.values())
    truth = {r.line_id: r[IRIS.target] for r in flowers.collect()}
    wrong = sum(truth[i] != name for i, (name, _) in found.items())
    assert wrong <= 0.1 * len(found)


@pytest.mark.parametrize("impute", IMPUTERS)
def test_same_seed_same_values(flowers, impute):
    damaged = erase(flowers, IRIS.target, 20)
    assert run(impute, damaged) == run(impute, damaged)


@pytest.mark.parametrize("impute", IMPUTERS)
def test_compat_mode_fills_missing_rows_of_the_test_part(flowers, impute):
    damaged = erase(flowers, IRIS.target, 40)
    found = run(impute, damaged, mode="compat")
    expected = damaged.where(F.col(IRIS.target).isNull() & ~in_training_part()).where("line_id <> 3")
    assert set(found) == {r.line_id for r in expected.collect()}
    assert all((name is None) == (code == 0) for name, code in found.values())
    assert {code for _, code in found.values()} <= {0.0, 1.0, 2.0, 3.0}


def test_wrong_layers_codes_and_mode_are_refused(flowers):
    damaged = erase(flowers, IRIS.target, 20)
    with pytest.raises(ValueError, match="layers"):
        run(perceptron_impute, damaged, layers=[3, 5, 3])
    with pytest.raises(ValueError, match="layers"):
        run(perceptron_impute, damaged, layers=[4, 5, 2])
    with pytest.raises(ValueError, match="mode"):
        run(tree_impute, damaged, mode="other")
    with pytest.raises(ValueError, match="codes"):
        tree_impute(damaged, IRIS.features, IRIS.target, {"Iris-setosa": 1, "Iris-versicolor": 3})


def test_perceptron_on_standardized_features(flowers):
    found = run(perceptron_impute, erase(flowers, IRIS.target, 20), standardize=True)
    truth = {r.line_id: r[IRIS.target] for r in flowers.collect()}
    assert sum(truth[i] != name for i, (name, _) in found.items()) <= 0.1 * len(found)
