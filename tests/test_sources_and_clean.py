import pytest
from pyspark.sql import functions as F

from lacuna.operators import cast_features, feature_array, filter_numeric, project_attributes
from lacuna.plans import Report
from lacuna.sources import as_text, load_csv, with_row_id


def test_csv_is_all_text_and_skips_blank_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,class\n1,2.5,x\n?,3,y\n\n4,,z\n\n")
    df = load_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "string"), ("b", "string"), ("class", "string")]
    assert df.count() == 3
    kept = filter_numeric(df, ["a", "b"]).collect()
    assert [r["class"] for r in kept] == ["x"]
    assert filter_numeric(df).count() == 0


def test_generated_ids_stay_the_same_and_natural_keys_are_used(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.rand(1))
    rows = with_row_id(df)
    assert rows.select("line_id").distinct().count() == 1000
    first = {r["id"]: r["line_id"] for r in rows.collect()}
    assert first == {r["id"]: r["line_id"] for r in rows.collect()}
    assert with_row_id(spark.range(5), "id").where("line_id = id").count() == 5


def test_generated_ids_leave_the_rows_of_a_file_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).coalesce(1).write.option("parquet.block.size", 16 << 10).option("parquet.page.size", 4 << 10).parquet(path)
    settings = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = with_row_id(spark.read.parquet(path))
        # By a join on the path all rows of the file came to one task.
        assert rows.groupBy(F.spark_partition_id()).count().count() > 1
        assert rows.select("line_id").distinct().count() == 20_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_projection_casts_and_text(spark):
    df = spark.createDataFrame([(1, "2.5", "7", "x", "drop")], "line_id long, a string, b string, t string, z string")
    kept = project_attributes(df, ["a", "b", "t"])
    assert kept.columns == ["line_id", "a", "b", "t"]
    assert cast_features(kept, ["a", "b"]).dtypes[1:3] == [("a", "double"), ("b", "double")]
    assert set(dict(as_text(df).dtypes.__iter__()).values()) == {"string"}


def test_feature_array_checks(spark):
    df = spark.createDataFrame(
        [(1, "1", "2", "x"), (2, "?", "2", "x"), (3, "3", None, None), (4, "5", "6", None)],
        "line_id long, a string, b string, t string",
    )
    rows = feature_array(df, ["a", "b"], "t").orderBy("line_id").collect()
    assert [(r.line_id, r.value, r.features) for r in rows] == [(1, "x", [1.0, 2.0]), (4, None, [5.0, 6.0])]
    with pytest.raises(ValueError, match="target"):
        feature_array(df, ["a", "t"], "t")
    arrays = spark.createDataFrame(
        [(1, [1.0, 2.0], "x"), (2, None, "x"), (3, [1.0, None], "x"), (4, [float("nan"), 1.0], "x")],
        "line_id long, e array<float>, t string",
    )
    assert [r.line_id for r in feature_array(arrays, "e", "t").collect()] == [1]


def test_report_is_saved_as_files(spark, tmp_path):
    detail = spark.createDataFrame(
        [(2, "a", "b", 1), (1, "a", "a", 0)], "line_id long, original_value string, imputed_value string, error int"
    )
    Report(detail).save(str(tmp_path / "r"))
    saved = spark.read.parquet(str(tmp_path / "r" / "summary")).collect()
    assert [tuple(r) for r in saved] == [(2, 1, 50.0)]
    assert spark.read.parquet(str(tmp_path / "r" / "detail")).count() == 2
