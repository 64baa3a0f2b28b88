"""Sharding, decontamination, license scan and mixing."""

import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_queries import duckdb_with_tables, rows_of  # noqa: E402

from lacuna.llm.decontaminate import contamination, decontaminate  # noqa: E402
from lacuna.llm.licenses import containment_join, scan_licenses, template_rows  # noqa: E402
from lacuna.llm.mixing import fit_rates, mix, mixture  # noqa: E402
from lacuna.llm.oracles import oracles  # noqa: E402
from lacuna.llm.queries import queries  # noqa: E402
from lacuna.llm.sharding import (  # noqa: E402
    build_map, fitted_map, load_map, rebalance, shard_documents, shard_records, store_map,
)
from lacuna.llm.text import table, words_of  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_sql(spark, folder, name):
    frame = queries()[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duckdb_with_tables(folder).execute(oracles()[name])
    assert ours == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_words_lower_only_ascii_letters(spark):
    row = spark.createDataFrame([("ÉA-b 7x Z",), (None,)], "t string").select(words_of(F.col("t")).alias("w")).collect()
    assert row[0].w == ["Éa", "b", "7x z"] and row[1].w == []


# --- sharding ----------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark, folder):
    docs = table(spark, folder, "documents")
    rows = shard_records(docs, 8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    loads = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        loads.setdefault(r.shard, []).append(r)
    assert set(loads) == set(range(8))
    for own in loads.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in own) for own in loads.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_rebalancing_edits_the_map(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    first = fitted_map(docs, 8, map_path=str(tmp_path / "map"))
    before = {r.virtual_slot: r for r in first.collect()}
    totals = first.select("virtual_slot", "bytes", "rows")
    after = {r.virtual_slot: r for r in store_map(rebalance(first, totals, 9), str(tmp_path / "map")).collect()}
    assert set(after) == set(before) and {r.version for r in after.values()} == {2}
    moved = [s for s in after if after[s].shard != before[s].shard]
    total = sum(r.bytes for r in before.values())
    assert sum(before[s].bytes for s in moved) < 0.35 * total
    loads = [sum(r.bytes for r in after.values() if r.shard == s) for s in range(9)]
    assert max(loads) - min(loads) <= 2 * max(r.bytes for r in before.values())
    assert load_map(spark, str(tmp_path / "map"), 1).count() == len(before)


def test_map_of_ties_and_nothing(spark):
    ties = spark.range(12).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(5).cast("long").alias("bytes"), F.lit(1).cast("long").alias("rows"))
    assert [r.n for r in build_map(ties, 4).groupBy("shard").agg(F.count("*").alias("n")).collect()] == [3, 3, 3, 3]
    assert build_map(ties.where("false"), 4).count() == 0


def test_sharding_of_odd_documents(odd_documents):
    rows = shard_records(odd_documents, 3).collect()
    assert len(rows) == odd_documents.count()
    assert {r.size for r in rows if r.text_crc32 is None} == {16}
    whole = shard_documents(odd_documents, 3)
    assert whole.count() == len(rows) and whole.columns.count("shard") == 1
    assert shard_records(odd_documents.where("false"), 3).count() == 0


# --- decontamination ---------------------------------------------------------


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_windows_shared_and_short(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([
        (1, " ".join(words[5:15])), (2, " ".join(words[5:14])), (3, "X " + " ".join(words[:20]) + " y " + " ".join(words[20:31])),
        (4, "alpha, BETA! gamma"), (5, "alpha gamma beta"), (6, None), (7, ""),
    ], "doc_id long, text string")
    bench = items(spark, " ".join(words), "Alpha beta gamma", "", None, " ".join(words))
    for limit in (10**6, 0):
        got = {r.doc_id: r for r in contamination(docs, bench, broadcast_windows=limit).collect()}
        assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == {
            1: (10, 10, 2), 2: (9, 0, 0), 3: (33, 31, 2), 4: (3, 3, 1), 5: (3, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0),
        }
        assert got[6].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == {2, 5, 6, 7}


def test_no_items_and_odd_documents(spark, odd_documents):
    none = items(spark, "x").where("false")
    assert {r.n_hit for r in contamination(odd_documents, none).collect()} == {0}
    bench = items(spark, "the quick brown fox jumps over the lazy dog while seven")
    got = contamination(odd_documents, bench).collect()
    assert len(got) == odd_documents.count() and sorted(r.doc_id for r in got if r.contaminated) == [1, 2, 2, 3]
    kept = decontaminate(odd_documents, bench)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 4
    assert contamination(odd_documents.where("false"), bench).count() == 0


# --- licenses ----------------------------------------------------------------


def test_containment_against_all_pairs(spark):
    import random

    chance = random.Random(4)
    letters = "abcdefgh"
    blocks = [(i, [chance.choice(letters) for _ in range(chance.randrange(0, 9))]) for i in range(200)]
    templates = [(i, "t", sorted({chance.choice(letters) for _ in range(chance.randrange(1, 6))})) for i in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        got = containment_join(
            spark.createDataFrame(blocks, "id int, words array<string>"),
            spark.createDataFrame(templates, "template int, label string, words array<string>"), threshold=threshold,
        ).collect()
        want = {(b, t) for b, ws in blocks for t, _, ts in templates if len(set(ws) & set(ts)) >= threshold * len(ts) - 1e-9}
        assert len(got) == len(want) and {(r.id, r.template) for r in got} == want


def test_license_labels(spark, odd_documents):
    docs = spark.createDataFrame([
        (1, "a MIT License, mit license"), (2, "x\nLicensed under CC BY-NC 4.0.\ny"), (3, None), (4, "mit\nlicense"), (5, "nothing"),
        (5, "nothing"),
    ], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 1, 3, "mit", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].base_labels) == (0, None, "") and "cc-by-nc" in got[2].labels
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0)
    assert got[4].n_base == 1 and got[5].n_base == 0
    assert got[2].labels == "cc-by-nc" and got[2].score == 1.0
    assert scan_licenses(docs).count() == 6 and scan_licenses(odd_documents).count() == odd_documents.count()
    assert scan_licenses(docs.where("false")).count() == 0


def test_wrapped_and_sibling_notices(spark):
    texts = {
        "bsd": "x y\nRedistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
        "cc-by-sa": "Licensed under CC BY-SA 4.0", "cc-by": "Licensed\nunder CC-BY 4.0.", "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
        "gpl": "Licensed under the GNU General Public License version 3",
        "gpl,lgpl": "Licensed under the GNU Lesser General Public License version 3",
        "agpl,gpl": "Licensed under the GNU Affero General Public\nLicense, version 3",
        "rights-reserved": "All\n\nrights reserved",
        "": "the rights of all are reserved in this long story",
        "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files",
        # Two notices of one family, far apart and over the ends of blocks.
        "cc-by,cc-by-sa": "w " * 124 + "licensed under cc by 4.0 " + "w " * 300 + "licensed under cc by sa 4.0 " + "w " * 9,
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert {i: r.labels for i, r in got.items()} == dict(enumerate(texts))
    assert all(got[i].score == 1.0 for i, label in enumerate(texts) if label)


def test_runs_against_all_places(spark):
    import random

    chance = random.Random(6)
    letters = "abcdefghijkl"
    named = {f"t{i}": [" ".join(chance.choice(letters) for _ in range(chance.randrange(1, 7)))] for i in range(10)}
    apart = {"t1": ([["a", "b"], ["c"]], []), "t2": ([], ["d"]), "t3": ([["e"]], ["f"])}
    templates = template_rows(spark, named, apart)
    texts = [" ".join(chance.choice(letters + "xyz") for _ in range(chance.randrange(0, 400))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.6, 0.8, 1.0):
        got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs, templates, threshold).collect()}
        for i, text in enumerate(texts):
            words, shares = text.split(), {}
            for label, (notice,) in named.items():
                own, span = set(notice.split()), len(notice.split()) * 5 // 4
                needed, never = apart.get(label, ([], []))
                for k, first in enumerate(words):
                    run = set(words[k:k + span])
                    share = len(run & own) / len(own)
                    if first in own and share >= threshold - 1e-9 and all(run & set(some) for some in needed) and not run & set(never):
                        shares[label] = max(share, shares.get(label, 0))
            assert got[i] == (",".join(sorted(shares)), max(shares.values(), default=0.0))


# --- mixing ------------------------------------------------------------------


def test_rates_meet_targets_and_are_least_squares(spark, recwarn):
    import numpy as np

    chance = np.random.default_rng(2)
    p = chance.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = chance.integers(1, 500, 300)
    rows = [(int(n), *map(float, q)) for n, q in zip(tokens, p)]
    members = spark.createDataFrame(rows, "tokens long, p_0 double, p_1 double, p_2 double").withColumn("times", F.lit(1).cast("long"))
    for targets in ([0.5, 0.3, 0.2], [0.9, 0.08, 0.02], [0.95, 0.04, 0.01]):
        got = fit_rates(members, targets, passes=25).collect()
        totals = sum(np.array([r.p_0, r.p_1, r.p_2]) * r.tokens * r.rate for r in got) / tokens.sum()
        assert min(r.rate for r in got) >= 0
        # Projected gradient descent on the rates themselves, until nothing moves.
        share = tokens / tokens.sum()
        least = 1 / np.linalg.eigvalsh((p * share[:, None]).T @ p).max()
        rates = np.ones(300)
        for _ in range(20000):
            rates = np.maximum(0, rates - least * p @ ((rates * share) @ p - targets))
        best = np.linalg.norm((rates * share) @ p - targets)
        assert abs(np.linalg.norm(totals - targets) - best) < 1e-3
    assert not [w for w in recwarn if "optimum" in str(w.message)]


def test_mixture_of_documents(spark, folder, odd_documents):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    targets = {"high": 0.8, "low": 0.15, "toxic": 0.05}
    got = mixture(docs, labels, targets).collect()
    assert len(got) == docs.count()
    everything = sum(r.tokens for r in got)
    for name, share in targets.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{name}"] for r in got) / everything - share) < 1e-3
    out = mix(odd_documents, labels)
    assert out.columns == odd_documents.columns and out.count() > 0
    assert mix(odd_documents, labels.where("false")).count() > 0
    assert mix(odd_documents.where("false"), labels).count() == 0
