"""Learners as tables, in Spark and in SQL; encoders; the approximate search; stored reports."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lacuna.functions import fit_encoder
from lacuna.operators import (
    forest_impute, knn_impute_hashed, nearest, nearest_hashed, node_table, perceptron_class, plan_training, tree_class, tree_impute,
    walk_nodes, weight_table,
)
from lacuna.operators import blocks, hashed, neighbours, places_of
from lacuna.plans import HEADACHE, compare_grid, run_experiment
from lacuna.session import scratch, shared_folder, written_path
from lacuna.sources import with_row_id


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4) + (i % 3) * np.array([1.0, -1, 0.5, 0])], float(i % 3)) for i in range(600)]
    return spark.createDataFrame(rows, "line_id long, features array<double>, label double").cache()


def fitted(points, learner):
    train = points.select(array_to_vector("features").alias("features"), "label", "line_id", F.col("features").alias("x"))
    model = learner.fit(train)
    return model, {r.line_id: int(r.prediction) for r in model.transform(train).collect()}


TREES = [(DecisionTreeClassifier, {"maxDepth": 5}), (DecisionTreeClassifier, {"maxDepth": 0}), (RandomForestClassifier, {"numTrees": 7, "maxDepth": 4})]


@pytest.mark.parametrize("learner, settings", TREES)
def test_node_table_says_what_the_learner_says(spark, points, tmp_path, learner, settings):
    model, want = fitted(points, learner(seed=1, **settings))
    nodes = node_table(spark, model)
    assert {r.line_id: r["c"] for r in points.select("line_id", tree_class(nodes.collect(), F.col("features")).alias("c")).collect()} == want
    assert {r.line_id: r["class"] for r in walk_nodes(points, nodes, 5).collect()} == want
    nodes.write.parquet(str(tmp_path / "nodes"))
    points.write.parquet(str(tmp_path / "points"))
    rows = duckdb.sql(f"""
        WITH RECURSIVE nodes AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'), points AS (SELECT * FROM '{tmp_path}/points/*.parquet'),
        walk AS (
            SELECT line_id, features, tree, 1 AS node FROM points, (SELECT DISTINCT tree FROM nodes)
            UNION ALL
            SELECT line_id, features, w.tree, CASE WHEN features[feature + 1] <= threshold THEN "left" ELSE "right" END
            FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE feature IS NOT NULL
        ),
        votes AS (
            SELECT line_id, unnest(range(len(shares))) AS class, unnest(shares) AS share
            FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE feature IS NULL
        ),
        sums AS (SELECT line_id, class, round(sum(share), 9) AS share FROM votes GROUP BY ALL)
        SELECT line_id, arg_max(class, (share, -class)) FROM sums GROUP BY line_id""").fetchall()
    assert dict(rows) == want


def test_weight_table_says_what_the_perceptron_says(spark, points, tmp_path):
    layers = [4, 5, 3]
    model, want = fitted(points, MultilayerPerceptronClassifier(layers=layers, maxIter=30, seed=5))
    weights = weight_table(spark, model, layers)
    assert {r.line_id: r["c"] for r in points.select("line_id", perceptron_class(weights.collect(), F.col("features")).alias("c")).collect()} == want
    with pytest.raises(ValueError, match="weights"):
        weight_table(spark, model, [4, 4, 3])
    weights.write.parquet(str(tmp_path / "weights"))
    points.write.parquet(str(tmp_path / "points"))
    rows = duckdb.sql(f"""
        WITH weights AS (SELECT * FROM '{tmp_path}/weights/*.parquet'), points AS (SELECT * FROM '{tmp_path}/points/*.parquet'),
        inputs AS (SELECT line_id, unnest(range(4)) AS source, unnest(features) AS x FROM points UNION ALL SELECT line_id, NULL, 1 FROM points),
        hidden AS (
            SELECT line_id, target AS source, 1 / (1 + exp(-sum(weight * x))) AS x FROM inputs i JOIN weights w ON i.source IS NOT DISTINCT FROM w.source
            WHERE layer = 0 GROUP BY ALL UNION ALL SELECT line_id, NULL, 1 FROM points
        ),
        outputs AS (
            SELECT line_id, target, sum(weight * x) AS x FROM hidden i JOIN weights w ON i.source IS NOT DISTINCT FROM w.source WHERE layer = 1 GROUP BY ALL
        )
        SELECT line_id, arg_max(target, x) FROM outputs GROUP BY line_id""").fetchall()
    assert dict(rows) == want


def test_encoder_and_its_way_back(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c + 0.1 * rng.normal()), ["low", "mid", "top", "odd"][c] if i % 5 else None) for i, c in enumerate(rng.integers(0, 4, 300))]
    df = spark.createDataFrame(rows, "line_id long, x double, t string")
    encoder = fit_encoder(df, "t", lambda c: F.when(c == "low", 2).when(c == "mid", 5).when(c == "top", 3))
    assert encoder.codes == {"low": 2, "top": 3, "mid": 5} and encoder.classes == 5
    assert df.select(encoder.encode(F.lit(None).cast("string")).alias("c")).first().c is None
    for impute in (tree_impute, forest_impute):
        for mode in ("known", "compat"):
            found = impute(df, ["x"], "t", encoder, mode=mode).collect()
            assert found and all(encoder.codes.get(r.imputed_value, 0) == r.imputed_code for r in found)
            assert mode == "compat" or {r.imputed_value for r in found} <= {"low", "mid", "top"}
    plan = plan_training(df, ["x"], "t", encoder, mode="compat")
    # A null or unlisted category has code 0 and asks for a value.
    assert plan.classes == 6
    report = run_experiment(df, ["x"], "t", "tree", 20, codes=encoder)
    assert report.detail.where("original_value <> imputed_value AND error = 0 AND original_value <> 'odd'").count() == 0
    with pytest.raises(ValueError, match="whole"):
        fit_encoder(df, "t", lambda c: F.length(c) / 2)
    with pytest.raises(ValueError, match="more than"):
        fit_encoder(df, "t", lambda c: F.ascii(c), max_classes=2)


def test_hashed_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(15, 6)) * 3
    classes = rng.integers(15, size=3000)
    rows = [(i, [float(v) for v in centres[c] + 0.2 * rng.normal(size=6)], str(c) if i % 6 else None) for i, c in enumerate(classes)]
    rows += [(3000 + i, [float(v) for v in centres[0]], "0" if i % 2 else None) for i in range(300)]
    rows += [(4000, [1e4] * 6, None), (4001, [None] * 6, None)]
    df = spark.createDataFrame(rows, "line_id long, e array<double>, t string").repartition(4)
    exact = {(r.line_id, r.neighbour_id): r.d2 for r in nearest(df, "e", "t", 8).collect()}
    found = nearest_hashed(df, "e", "t", 8, bucket_rows=100).collect()
    got = {(r.line_id, r.neighbour_id): r.d2 for r in found}
    assert len(got) == len(found) == len(exact)
    assert all(got[at] == exact[at] for at in got.keys() & exact.keys())
    assert len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    truth = {i: str(c) for i, c in enumerate(classes)}
    imputed = {r.line_id: r.imputed_value for r in knn_impute_hashed(df, "e", "t", 8, bucket_rows=100).collect()}
    wrong = sum(truth[i] != v for i, v in imputed.items() if i in truth)
    assert len(imputed) == 500 + 150 + 1 and wrong <= 0.02 * len(imputed)
    report = run_experiment(df, "e", "t", "knn", 10, search="hashed")
    assert report.detail.where("original_value IS NOT NULL").agg(F.avg("error")).first()[0] < 0.05
    with pytest.raises(ValueError, match="search"):
        run_experiment(df, "e", "t", "knn", 10, search="other")


def test_one_search_for_all_percents(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal() + i % 3), float(rng.normal() - i % 3), "abc"[i % 3] if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "line_id long, x double, y double, t string")
    for erase, k in (("hash", "percent"), ("exact", 4)):
        grid = compare_grid(df, ["x", "y"], "t", methods=["knn"], percents=[50, 10, 30], k=k, erase=erase).collect()
        assert [r.percent for r in grid] == [50, 10, 30]
        for r in grid:
            alone = run_experiment(df, ["x", "y"], "t", "knn", r.percent, k=r.percent if k == "percent" else k, erase=erase).summary.first()
            assert tuple(alone) == (r.n, r.total_error, r.avg_percent_error)
    assert compare_grid(df, ["x", "y"], "t", methods=["knn"], percents=[]).count() == 0


def test_headache_shape(spark):
    rng = np.random.default_rng(7)
    names = list(HEADACHE.codes)
    rows = [(i, str(i % 20), f"{rng.normal() + i % 3:.2f}", str(30 + i % 3 * 10), f"{rng.random():.1f}" if i % 50 else "?", names[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "line_id long, id string, dos string, age string, airq string, medication string")
    grid = compare_grid(df, HEADACHE.features, HEADACHE.target, percents=[10, 50], codes=HEADACHE.codes, options={"perceptron": {"max_iter": 20}}).collect()
    assert [(r.percent, r.method) for r in grid] == [(p, m) for p in (10, 50) for m in ("knn", "tree", "forest", "perceptron")]
    assert len({r.n for r in grid}) == 2 and all(0 <= r.total_error <= r.n for r in grid)


def test_ids_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).withColumn("v", F.col("id") % 7).repartition(6).write.parquet(path)
    df = with_row_id(spark.read.parquet(path).select("id", "v"))
    assert "lacuna" not in "".join(df.inputFiles()) and df.columns == ["id", "v", "line_id"]
    first = {r.id: r.line_id for r in df.collect()}
    assert len(set(first.values())) == 500
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    again = {r.id: r.line_id for r in with_row_id(spark.read.parquet(path).select("v", "id")).where("v < 9").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == first


def test_store_replaces_one_cell_and_scratch_is_removed(spark, points, tmp_path):
    df = points.select("line_id", "features", F.col("label").cast("int").cast("string").alias("t"))
    store = str(tmp_path / "store")
    root = f"{shared_folder(spark)}/lacuna"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with scratch(spark):
        small, large = (run_experiment(df, "features", "t", "knn", p, k=3) for p in (10, 30))
        small.store(store, "knn", 10)
        kept = large.store(store, "knn", 30).summary.first()
        names = ["n", "total_error", "avg_percent_error"]
        small.store(store, "knn", 10.0)
        small.save(str(tmp_path / "saved"))
        assert small.sql("SELECT count(*) AS n FROM {detail}").first().n != large.sql("SELECT count(*) AS n FROM {detail}").first().n
    rows = spark.read.parquet(f"{store}/summary").orderBy("percent").select("method", "percent", *names).collect()
    assert [(r.method, r.percent) for r in rows] == [("knn", 10.0), ("knn", 30.0)] and tuple(rows[1])[2:] == tuple(kept)
    assert spark.read.parquet(str(tmp_path / "saved" / "detail")).count() == rows[0].n
    assert set(os.listdir(root)) == before
    outside = written_path(spark, "kept")
    with scratch(spark):
        pass
    spark.range(1).write.parquet(outside)
    assert os.path.isdir(outside)


def _brute(asked, known, k):
    d2 = np.zeros((len(asked), len(known)))
    for f in range(asked.shape[1]):
        d2 += np.subtract.outer(asked[:, f], known[:, f]) ** 2
    best = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return {(i, int(j), d2[i, j]) for i in range(len(asked)) for j in best[i]}


def test_full_buckets_are_searched_along_their_widest_feature(monkeypatch):
    made = np.random.default_rng(3)
    # A strip, as a bucket is where one feature outweighs the others; rounded, so that distances tie.
    known = np.column_stack([made.integers(0, 40, 8000), made.integers(0, 200_000, 8000), made.integers(0, 3, 8000)]).astype(float)
    asked = np.column_stack([made.integers(0, 40, 1000), made.integers(-50_000, 250_000, 1000), made.integers(0, 3, 1000)]).astype(float)
    known[:300], asked[:40] = known[0], known[0]
    compared, distances = [], hashed._distances
    monkeypatch.setattr(hashed, "_distances", lambda a, b: compared.append(len(a) * len(b)) or distances(a, b))
    for k in (1, 10, 700):
        compared.clear()
        found = {(int(i), int(j), d) for part in hashed._nearest_in_bucket(asked, known, k) for i, j, d in zip(*part)}
        assert found == _brute(asked, known, k)
        # All pairs were compared before: 8 million.
        assert k == 700 or sum(compared) < 0.25 * len(asked) * len(known)
    few = known[:5]
    assert {(int(i), int(j), d) for part in hashed._nearest_in_bucket(asked, few, 10) for i, j, d in zip(*part)} == _brute(asked, few, 10)


def test_hashed_search_is_the_same_in_tiles(spark, monkeypatch):
    made = np.random.default_rng(5)
    rows = [(i, float(made.integers(0, 400)), float(made.integers(0, 9)), None if i % 9 == 0 else "ab"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "line_id long, a double, b double, t string")

    def found():
        return sorted(tuple(r) for r in nearest_hashed(df, ["a", "b"], "t", 5, bucket_rows=200).collect())

    whole = found()
    assert len(whole) == 5 * 445
    monkeypatch.setattr(hashed, "TILE", 64)
    assert found() == whole


def test_buckets_go_on_over_batches_and_tiles_are_told_apart(monkeypatch):
    monkeypatch.setattr(hashed, "ROWS_AT_ONCE", 7)
    rows = [(b, t, 100 * b + i, None if i % 4 == 0 else "x", [float(i * i % 23)]) for b in (-3, 1, 2, 9) for t, i in ((i % (b % 3 + 1), i) for i in range(20))]
    columns = dict(zip(("bucket", "tile", "line_id", "value", "features"), map(list, zip(*rows))))
    batches = pa.table(columns).to_batches(max_chunksize=3)
    found = {tuple(r.values()) for out in hashed._compared(2, 1)(iter(batches)) for r in out.to_pylist()}
    wanted = set()
    for b, t, line, value, (x,) in rows:
        near = sorted(((x - y) ** 2, other, v) for c, u, other, v, (y,) in rows if (c, u) == (b, t) and v is not None)
        wanted |= {(line, other, v, d2) for d2, other, v in near[:2] if value is None}
    assert found == wanted


def test_a_bucket_says_all_of_a_row_in_one_row_and_lists_are_merged(monkeypatch):
    monkeypatch.setattr(hashed, "ROWS_AT_ONCE", 40)
    monkeypatch.setattr(hashed, "LISTS_AT_ONCE", 7)
    made = np.random.default_rng(9)
    # Two tables that bring nearly the same rows together; places tie.
    places = made.integers(0, 30, 240).astype(float)
    rows = sorted((2 * int(i + t * 11) // 60 * 2 + t, 0, i, None if i % 5 == 0 else "xy"[i % 2], [places[i]]) for i in range(240) for t in (0, 1))
    columns = dict(zip(("bucket", "tile", "line_id", "value", "features"), map(list, zip(*rows))))
    batches = pa.table(columns).to_batches(max_chunksize=9)
    lists = pa.Table.from_batches(hashed._listed(4, 1)(iter(batches)))
    assert lists.num_rows == 2 * 48 and set(lists["ids"].combine_chunks().value_lengths().to_pylist()) == {4}
    ordered = lists.sort_by("line_id").to_batches(max_chunksize=5)
    found = [tuple(r.values()) for out in hashed._merged(4)(iter(ordered)) for r in out.to_pylist()]
    wanted = []
    for line in range(0, 240, 5):
        mine = {b for b, _, other, _, _ in rows if other == line}
        near = sorted({((places[line] - x) ** 2, other, v) for b, _, other, v, (x,) in rows if b in mine and v is not None})
        wanted += [(line, other, v, d2, rank) for rank, (d2, other, v) in enumerate(near[:4], 1)]
    assert found == wanted


def test_searches_share_their_rows_and_the_walk_is_dealt_out(spark, monkeypatch):
    made = np.random.default_rng(2)
    rows = [(i, float(made.integers(0, 400)), float(made.integers(0, 9)), None if i % 9 == 0 else "ab"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "line_id long, a double, b double, t string")
    places, copies = places_of(df, ["a", "b"], "t", 5), []
    for search, more in ((nearest, {"rows_per_block": 16}), (nearest_hashed, {"bucket_rows": 200})):
        alone = sorted(map(tuple, search(df, ["a", "b"], "t", 5, **more).collect()))
        with monkeypatch.context() as inside:
            inside.setattr(neighbours, "_lowest_ids_per_place", lambda *a: copies.append(a))
            assert sorted(map(tuple, search(df, ["a", "b"], "t", 5, places=places, **more).collect())) == alone
            with pytest.raises(ValueError, match="places"):
                search(df, ["a", "b"], "t", 6, places=places, **more)
    assert not copies
    made_blocks = blocks.make_blocks(places.rows, places.known, 5, 2, 16)
    walk = blocks._block_walk(made_blocks.table.where("m > 0"), made_blocks, 5, 2)
    # By bytes, these few would be one task's.
    assert walk.select(F.spark_partition_id().alias("p")).distinct().count() > 4
