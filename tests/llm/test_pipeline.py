"""The stages of the corpus pipeline, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm.decontaminate import contamination
from lacuna.llm.order_minhash import near_duplicate_classes
from lacuna.llm.text import table
from lacuna.session import write_and_reread


def test_stages_take_effect_and_keep_columns(spark, folder):
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = write_and_reread(stage(spark, before, folder), f"test-{name}")
        kept[name] = after
        if name != "sharding":
            assert after.columns == columns
        assert after.count()
        assert not after.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() or name == "mixing"
        before = after
    assert not kept["language_id"].where("text IS NULL").count()
    # One row of each class stays, the one with the least id.
    classes = {r.class_id for r in near_duplicate_classes(kept["language_id"]).collect()}
    assert sorted(r.doc_id for r in kept["near_dedup"].select("doc_id").collect()) == sorted(classes)
    # Exactly the clean documents stay.
    found = contamination(kept["near_dedup"], table(spark, folder, "benchmark"))
    clean = {r.doc_id for r in found.where("NOT contaminated").collect()}
    assert {r.doc_id for r in kept["decontamination"].select("doc_id").collect()} == clean
    # Mixing repeats and drops rows, and adds none.
    assert not kept["mixing"].join(kept["decontamination"], "doc_id", "left_anti").count()
    # Sharding holds every row; sizes are near equal.
    shards = kept["sharding"]
    assert shards.count() == kept["mixing"].count()
    assert shards.agg(F.min("shard"), F.max("shard")).first()[1] < corpus_pipeline.SHARDS


def test_nothing_goes_in(spark, folder):
    empty = table(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
