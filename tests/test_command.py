import numpy as np
import pytest

from lacuna.__main__ import main
from lacuna.plans import IRIS


@pytest.fixture()
def csv(tmp_path):
    rng = np.random.default_rng(3)
    lines = [",".join((*IRIS.features, IRIS.target))]
    for i in range(120):
        name = list(IRIS.codes)[i % 3]
        lines.append(",".join([f"{v:.2f}" for v in 5 * (i % 3) + rng.random(4)] + [name]))
    path = tmp_path / "flowers.csv"
    path.write_text("\n".join(lines) + "\n\n")
    return str(path)


def test_one_experiment_is_written(spark, csv, tmp_path):
    main([csv, "--preset", "iris", "--method", "tree", "--mode", "compat", "--percent", "40", "--out", str(tmp_path / "r")])
    n, _, percent = spark.read.parquet(str(tmp_path / "r/summary")).first()
    assert n == spark.read.parquet(str(tmp_path / "r/detail")).count() > 0 and 0 <= percent <= 100


def test_knn_summary_is_shown(spark, csv, capsys):
    main([csv, "--features", ",".join(IRIS.features), "--target", IRIS.target, "-k", "3"])
    assert "avg_percent_error" in capsys.readouterr().out


def test_columns_have_to_be_named(csv):
    with pytest.raises(SystemExit):
        main([csv])
