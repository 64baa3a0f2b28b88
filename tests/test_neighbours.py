"""k-NN against brute force, on data that is hard for blocks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import blocks as block_module
from lacuna.operators import distance_to_row, knn_impute, nearest, nearest_by_step, votes


def frame(spark, rows, labels):
    data = [
        (i, [float(v) for v in row], None if label is None else str(label))
        for i, (row, label) in enumerate(zip(rows, labels))
    ]
    return spark.createDataFrame(data, "line_id long, e array<double>, t string").repartition(5)


def brute(rows, labels, k):
    """{missing id: [(neighbour id, label, d2), ...]} in order."""
    rows = np.asarray(rows, dtype=float)
    known = [i for i, label in enumerate(labels) if label is not None]
    found = {}
    for i, label in enumerate(labels):
        if label is None:
            d2 = np.zeros(len(known))
            for f in range(rows.shape[1]):
                gap = rows[i, f] - rows[known, f]
                d2 += gap * gap
            order = np.lexsort((known, d2))[:k]
            found[i] = [(known[j], str(labels[known[j]]), d2[j]) for j in order]
    return found


def vote(neighbours):
    names = [label for _, label, _ in neighbours]
    return min(set(names), key=lambda name: (-names.count(name), name))


def check(spark, rows, labels, k, rows_per_block):
    df = frame(spark, rows, labels)
    expected = brute(rows, labels, k)
    got = {}
    for r in nearest(df, "e", "t", k, rows_per_block=rows_per_block).orderBy("line_id", "rank").collect():
        got.setdefault(r.line_id, []).append((r.neighbour_id, r.value, r.d2))
    assert got == expected
    imputed = {r.line_id: r.imputed_value for r in knn_impute(df, "e", "t", k, rows_per_block=rows_per_block).collect()}
    assert imputed == {i: vote(n) for i, n in expected.items()}


def labelled(rng, count, missing_share, classes=3):
    return [None if rng.random() < missing_share else int(rng.integers(classes)) for _ in range(count)]


@pytest.mark.parametrize("rows_per_block", [4, 16, 512])
def test_random_points(spark, rows_per_block):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(900, 2)), labelled(rng, 900, 0.2), 7, rows_per_block)


def test_ties_on_a_small_grid(spark):
    rng = np.random.default_rng(2)
    check(spark, rng.integers(0, 6, size=(800, 2)), labelled(rng, 800, 0.3), 5, 8)


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 3))
    rows[:300] = rows[0]
    order = rng.permutation(900)
    check(spark, rows[order], labelled(rng, 900, 0.3), 10, 16)


def test_all_rows_equal(spark):
    rng = np.random.default_rng(4)
    check(spark, np.ones((300, 2)), labelled(rng, 300, 0.3), 10, 8)


def test_narrow_and_wide_features_with_far_outliers(spark):
    rng = np.random.default_rng(5)
    rows = np.column_stack([rng.normal(size=700) * 1000, rng.integers(0, 5, 700), rng.standard_cauchy(700)])
    rows[::97] *= 1e6
    check(spark, rows, labelled(rng, 700, 0.25), 6, 16)


def test_missing_rows_far_from_any_known(spark):
    """A long stretch along the curve holds no known row at all."""
    rng = np.random.default_rng(6)
    far = rng.normal(size=(600, 2)) + 50
    near = rng.normal(size=(300, 2))
    labels = [None] * 600 + labelled(rng, 300, 0.1)
    check(spark, np.vstack([far, near]), labels, 5, 4)


def test_box_bounds_alone_are_exact(spark, monkeypatch):
    """Without bounds from the curve the tree of boxes has to give them."""
    make = block_module.make_blocks
    infinite = F.lit(float("inf"))

    def unbounded(*args, **kwargs):
        made = make(*args, **kwargs)
        table = made.table.withColumns({"bound": infinite, "q_bounds": F.transform("q_bounds", lambda _: infinite)})
        return replace(made, table=table)

    monkeypatch.setattr("lacuna.operators.neighbours.make_blocks", unbounded)
    rng = np.random.default_rng(7)
    check(spark, rng.normal(size=(600, 2)), labelled(rng, 600, 0.2), 5, 8)


@pytest.mark.parametrize("branches", [0, 3])
def test_rows_that_walk_by_themselves(spark, monkeypatch, branches):
    monkeypatch.setattr(block_module, "BRANCHES", branches)
    rng = np.random.default_rng(14)
    check(spark, rng.normal(size=(600, 2)), labelled(rng, 600, 0.2), 5, 16)


def test_dense_cluster_inside_spread_out_rows(spark, monkeypatch):
    monkeypatch.setattr(block_module, "BRANCHES", 20)
    rng = np.random.default_rng(15)
    rows = np.vstack([rng.random(size=(1000, 2)), 0.3 + 1e-9 * rng.random(size=(1000, 2))])
    check(spark, rows, labelled(rng, 2000, 0.2), 5, 16)


def test_shuffle_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(block_module, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = np.random.default_rng(12)
        check(spark, rng.normal(size=(600, 2)), labelled(rng, 600, 0.2), 5, 8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_rows_far_outside(spark):
    rng = np.random.default_rng(13)
    rows = rng.normal(size=(2000, 2))
    labels = labelled(rng, 2000, 0.2)
    for i in rng.choice([i for i, label in enumerate(labels) if label is None], 15, replace=False):
        rows[i] *= 1000
    check(spark, rows, labels, 5, 32)


def test_many_features(spark):
    rng = np.random.default_rng(8)
    check(spark, rng.normal(size=(300, 40)), labelled(rng, 300, 0.2), 10, 32)


def test_one_feature_and_correlated_features(spark):
    rng = np.random.default_rng(9)
    line = rng.normal(size=500)
    check(spark, line[:, None], labelled(rng, 500, 0.2), 3, 8)
    check(spark, np.column_stack([line, 2 * line, -line]), labelled(rng, 500, 0.2), 3, 8)


def test_fewer_known_rows_than_k(spark):
    check(spark, [[0, 0], [1, 1], [5, 5], [2, 2], [9, 9]], ["a", "b", "a", None, None], 10, 512)


def test_nothing_missing_and_all_missing(spark):
    rows = [[float(i), 0.0] for i in range(5)]
    assert knn_impute(frame(spark, rows, list("aabbb")), "e", "t", 3).count() == 0
    with pytest.raises(ValueError, match="missing in every"):
        knn_impute(frame(spark, rows, [None] * 5), "e", "t", 3)
    with pytest.raises(ValueError, match="k must"):
        nearest(frame(spark, rows, list("aabbb")), "e", "t", 0)


def test_pruning_skips_most_pairs(spark):
    rng = np.random.default_rng(10)
    df = frame(spark, rng.random(size=(4000, 2)), labelled(rng, 4000, 0.2))
    points = df.select("line_id", F.col("t").alias("value"), F.col("e").alias("features"))
    made = block_module.make_blocks(points, points.where("value IS NOT NULL"), 5, 2, 32)
    blocks, pairs = made.table.count(), block_module.candidate_pairs(made, 5, 2).count()
    assert pairs < blocks * 20 < blocks * blocks / 5


def test_votes_and_tie_break(spark):
    rows = [[0.0], [1.0], [-1.0], [2.0], [-2.0]]
    df = frame(spark, rows, [None, "b", "a", "a", "b"])
    counted = {(r.value, r.votes) for r in votes(nearest(df, "e", "t", 4)).collect()}
    assert counted == {("a", 2), ("b", 2)}
    assert [r.imputed_value for r in knn_impute(df, "e", "t", 4).collect()] == ["a"]
    # Equal distance: the lower id is the nearer one.
    assert [r.imputed_value for r in knn_impute(df, "e", "t", 1).collect()] == ["b"]


def test_distance_to_row(spark):
    df = spark.createDataFrame(
        [(0, "0", "0", None), (1, "3", "4", "a"), (2, "?", "4", "a"), (3, "0", "1", "b")],
        "line_id long, x string, y string, t string",
    )
    found = distance_to_row(df, ["x", "y"], "t", df.where("line_id = 0")).orderBy("neighbour_id").collect()
    assert [tuple(r) for r in found] == [(1, "a", 5.0), (3, "b", 1.0)]


def test_plan_has_no_all_pairs_join(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, rng.random(size=(2000, 2)), labelled(rng, 2000, 0.2))
    plan = knn_impute(df, "e", "t", 5, rows_per_block=16)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join Cross" not in plan
    assert "WindowGroupLimit" in plan


def clustered(rng, clusters, rows, width, spread=0.15):
    centres = rng.normal(size=(clusters, width))
    return centres[rng.integers(clusters, size=rows)] + spread * rng.normal(size=(rows, width))


@pytest.mark.parametrize("rows_per_block", [32, 512])
def test_wide_features(spark, rows_per_block):
    rng = np.random.default_rng(30)
    rows = clustered(rng, 12, 900, 24)
    rows[:200] = rows[0]
    rows[200] *= 1e5
    check(spark, rows, labelled(rng, 900, 0.25), 7, rows_per_block)


def test_wide_rows_that_walk_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(block_module, "BRANCHES", 1)
    monkeypatch.setattr(block_module, "CENTRES", 9)
    rng = np.random.default_rng(31)
    check(spark, clustered(rng, 5, 500, 20, 0.5), labelled(rng, 500, 0.2), 4, 16)


def test_clustered_wide_rows_compare_few_blocks(spark):
    """Pivots part clusters that boxes over 64 features can't."""
    rng = np.random.default_rng(32)
    points = clustered(rng, 40, 8000, 64, 0.1)
    df = frame(spark, points, labelled(rng, 8000, 0.1)).withColumnRenamed("t", "value").withColumnRenamed("e", "features")
    made = block_module.make_blocks(df, df.where("value IS NOT NULL"), 10, 64, 64)
    pairs = block_module.candidate_pairs(made, 10, 64).count()
    sides = made.table.agg(F.count_if(F.col("m") > 0), F.count_if(F.col("c") > 0)).first()
    assert pairs < 0.15 * sides[0] * sides[1]


@pytest.mark.parametrize("rows_per_block", [8, 256])
@pytest.mark.parametrize("width", [2, 18])
def test_several_steps_in_one_search(spark, rows_per_block, width):
    rng = np.random.default_rng(33)
    rows = rng.integers(0, 5, size=(500, 2)) if width == 2 else clustered(rng, 4, 500, width)
    labels = labelled(rng, 500, 0.05)
    steps = rng.integers(0, 6, 500)
    ks = [2, 2, 5, 9]
    data = [(i, [float(v) for v in row], None if label is None else str(label), int(step)) for i, (row, label, step) in enumerate(zip(rows, labels, steps))]
    df = spark.createDataFrame(data, "line_id long, e array<double>, t string, s int").repartition(4)
    got = {}
    for r in nearest_by_step(df, "e", "t", "s", ks, rows_per_block=rows_per_block).orderBy("line_id", "rank").collect():
        got.setdefault((r.step, r.line_id), []).append((r.neighbour_id, r.value, r.d2))
    want = {}
    for step, k in enumerate(ks):
        left = [None if s <= step else label for label, s in zip(labels, steps)]
        want |= {(step, i): n for i, n in brute(rows, left, k).items()}
    assert got == want


def test_steps_need_rising_ks(spark):
    df = frame(spark, np.ones((4, 2)), ["a", None, "b", "a"]).withColumn("s", F.lit(0))
    with pytest.raises(ValueError, match="ks"):
        nearest_by_step(df, "e", "t", "s", [3, 2])
    with pytest.raises(ValueError, match="missing in every"):
        nearest_by_step(df, "e", "t", "s", [2, 3])
