"""Documents that every operator has to cope with."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("needs the test tables")
    return FOLDER


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, copies, repeated rows and columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards quietly box near the old river bank " * 3
    rows = [
        (1, prose, "en"), (2, prose, "en"), (2, prose, "en"), (3, prose.replace("wizards", "lizards"), "en"),
        (4, None, "en"), (5, "", None), (6, "   ", "de"), (7, "!!! ???", "de"), (8, "word", "en"), (None, "no id here", "fr"),
        (9, "lang " * 30000, "en"), (10, "Über den Wolken muss die Freiheit wohl grenzenlos sein " * 5, "de"), (None, None, None),
    ]
    schema = "doc_id long, text string, lang string"
    more = {name: name for name in ("node", "score", "lang_pred", "shard", "slot", "size", "n_words", "domain", "rate", "key", "text_hash", "_id", "_node", "_hash", "_read", "_lettered", "_copies", "_copy", "_times", "_lang_pred")}
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).select("*", *[F.lit(v).alias(k) for k, v in more.items()])
