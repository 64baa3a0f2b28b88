"""Hard negatives, repeated passages and the filter audit, against brute force."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lacuna.llm import filter_audit, hard_negatives, repeats
from lacuna.llm.shingles import text_bytes
from lacuna.llm.text import table

# --- hard negatives ----------------------------------------------------------


def mined(rows, step):
    """Every row against every row."""
    usable = {(i, tuple(e), l) for i, e, l in rows if l is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    points = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * x) for x in e]) for i, e, l in usable]
    found = []
    for a, label, v in points:
        if a is None or a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i, m) for i, m, w in points if len(w) == len(v)]
        for p in sorted(r for r in scored if r[4] == label and r[3] != a)[:5]:
            near = sorted(r for r in scored if r[4] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0])[:10]
            found += [(a, p[3], rank + 1, r[3], -p[0], -r[0]) for rank, r in enumerate(near)]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def labelled(spark):
    chance = np.random.default_rng(8)
    centres = chance.standard_normal((6, 5))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.4 * chance.standard_normal(5)], int(i % 4)) for i in range(400)]
    common = rows[20][1]
    rows += [(i, common, int(i % 2)) for i in range(400, 460)]
    rows += [(500, [1.0, 2.0], 1), (501, [1.5, 2.0], 1), (502, [0.5, 1.0], 2), (520, [0.0] * 5, 3), (521, [-1.0] * 5, 3)]
    rows += [(40, common, 1), (40, common, 1), (20, rows[20][1], rows[20][2]), (None, centres[0].tolist(), 2), (None, common, 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [1.0, None, 0.0, 0.0, 0.0], 1), (603, [math.nan] * 5, 1), (604, [math.inf] * 5, 1), (620, common, None)]
    return rows


@pytest.mark.parametrize("tile_rows, leaf", [(16384, 256), (30, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, labelled, tile_rows, leaf):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    frame = spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int")
    frame = frame.select("*", F.lit(1).alias("row"), F.lit("x").alias("tile"), F.lit(0.5).alias("score"))
    got = hard_negatives.hard_negatives(frame, anchor_step=20, tile_rows=tile_rows, leaf=leaf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == mined(labelled, 20)


def test_no_vectors_no_negatives(spark):
    frame = spark.createDataFrame([(100, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(frame).count() == 0
    assert hard_negatives.hard_negatives(frame.where("false")).count() == 0


def test_tree_prunes_and_loses_nothing():
    chance = np.random.default_rng(2)
    points = np.concatenate([centre + chance.integers(-5, 6, (200, 8)) for centre in chance.integers(-100, 101, (20, 8))]).astype(np.float64)
    tree = hard_negatives.PackedTree(points, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(len(points)))
    assert all(len(rows) <= 16 for rows in tree.leaves)
    anchors = points[::400]
    least, most = tree.intervals(anchors)
    for a, anchor in enumerate(anchors):
        scores = points @ anchor
        for node, rows in enumerate(tree.leaves):
            assert least[a, node] <= scores[rows].min() and scores[rows].max() <= most[a, node]
        best = hard_negatives.Best(3, hard_negatives.NO_BOUND)
        ids = np.arange(len(points))
        visited = tree.search(
            least[a], most[a], lambda low, high, best=best: high >= best.kth,
            lambda rows, best=best, scores=scores: best.offer(scores[rows], ids[rows], ids[rows]),
        )
        assert best.rows[1].tolist() == np.lexsort((ids, -scores))[:3].tolist()
        assert visited < 0.3 * len(tree.leaves)


# --- repeated passages -------------------------------------------------------


def cut(rows, least, keep_first):
    """Every window of every text in a set."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    bodies = [(i, (t or "").encode()) for i, t in rows]
    times = collections.Counter(b[i:i + least] for _, b in bodies for i in range(len(b) - least + 1))
    seen, own, found = set(), {}, []
    for doc, body in bodies:
        key = (doc, body)
        if not keep_first or key not in own:
            gone = np.zeros(len(body), bool)
            for i in range(len(body) - least + 1):
                window = body[i:i + least]
                if window in seen if keep_first else times[window] > 1:
                    gone[i:i + least] = True
                seen.add(window)
            left = bytes(b for b, g in zip(body, gone) if not g)
            own[key] = (len(body), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
        found.append((doc, *own[key]))
    return sorted(found, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def repetitive():
    chance = random.Random(3)

    def prose(n):
        return " ".join("".join(chance.choice("abcdeé") for _ in range(chance.randrange(2, 8))) for _ in range(n))

    passage, other = prose(40), prose(60)
    rows = [(i, prose(20) + passage + prose(15)) for i in range(25)]
    rows += [(30 + i, prose(10) + passage[40:] + other[: 60 + 20 * i] + prose(5)) for i in range(8)]
    rows += [(50, other), (51, other), (51, other), (52, other + other), (53, "ab" * 300), (54, "ab" * 200 + passage), (55, "x" * 4000)]
    rows += [(60, None), (61, ""), (62, "short"), (None, passage + prose(5)), (None, None), (70, "é" * 150), (71, prose(30))]
    rows += [(8, prose(3) + passage[:120]), (7, passage[20:] + prose(3))]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limits", [(512, 1 << 16, 1 << 17), (3, 60, 400)])
def test_cuts_equal_brute_force(spark, monkeypatch, repetitive, keep_first, limits):
    for name, value in zip(("KEY_RUNS", "KEY_WINDOWS", "BUCKET_WINDOWS"), limits):
        monkeypatch.setattr(repeats, name, value)
    frame = spark.createDataFrame(repetitive, "doc_id long, text string").repartition(3)
    assert rows_of(repeats.repeated_bytes(frame, 100, keep_first, 30)) == cut(repetitive, 100, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_query_table_and_long_texts(spark, folder, monkeypatch, keep_first):
    monkeypatch.setattr(repeats, "RUN", 64)
    monkeypatch.setattr(repeats, "PIECE", 700)
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(repeats.repeated_bytes(docs, keep_first=keep_first)) == cut(rows, 200, keep_first)


def test_factors_equal_all_pairs():
    chance = np.random.default_rng(4)
    for n, width, letters in ((1, 5, 2), (60, 5, 2), (200, 11, 3), (80, 16, 2)):
        rows = chance.integers(97, 97 + letters, (n, width)).astype(np.uint8)
        rows[n // 2:] = rows[chance.integers(0, n, n - n // 2)]
        factor, repeated = repeats.longest_previous_factors(rows)

        def shared(a, b):
            return int(np.argmin(np.append(a == b, False)))

        want = [max((shared(rows[i], rows[j]) for j in range(i)), default=0) for i in range(n)]
        assert factor.tolist() == want
        assert repeated.tolist() == [any((rows[i] == rows[j]).all() for j in range(n) if j != i) for i in range(n)]


def test_runs_do_not_depend_on_neighbours():
    chance = random.Random(1)
    texts = ["".join(chance.choice("abcd ") for _ in range(n)) for n in (0, 50, 199, 200, 201, 900)] + [None, "ab" * 400]

    def runs(batch):
        owner, *rest = repeats.window_runs(*text_bytes(pa.array(batch, pa.string())))
        return [[tuple(x) for x in np.stack([np.asarray(r).astype(object)[owner == i] for r in rest], axis=1).tolist()] for i in range(len(batch))]

    together = runs(texts)
    for text, own in zip(texts, together):
        assert [own] == runs([text])
        windows = max(0, len(text or "") - repeats.PASSAGE + 1)
        # Runs tile the windows.
        assert [r[1] for r in own] == [0, *[r[2] for r in own]][: len(own)] and (own[-1][2] if own else 0) == windows
    assert [r[3] for r in together[-1]] == [True]


def test_repeats_of_odd_documents(odd_documents):
    got = repeats.repeated_bytes(odd_documents)
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert rows_of(got) == cut(rows, 200, True)
    left = repeats.remove_repeats(odd_documents)
    assert left.columns == odd_documents.columns and left.count() == len(rows)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[4] is None and texts[5] == "" and texts[2] == "" and texts[1] == dict(rows)[1][:100]
    assert repeats.repeated_bytes(odd_documents.where("false")).count() == 0


# --- filter audit ------------------------------------------------------------


def audited(rows, labels):
    """Filters applied one after another in every order."""
    low = {}
    for doc, text, _ in rows:
        if doc is not None:
            low[text or ""] = min(doc, low.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and low.get(text, doc) < doc,
        }
        parts[source or ""].append(({f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    found = {}
    for part, documents in parts.items():
        totals = collections.Counter()
        for order in permutations("ABCDE"):
            left = documents
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                totals[f] += len(gone)
                found[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(f in d[0] for d in documents) - len(gone), sum(d[0] == {f} for d in documents),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (own, order, step), counts in found.items():
            if own == part:
                counts.append(totals[order[step - 1]])
    return found


def audit_rows(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_filters_in_turn(spark, monkeypatch, odd_documents):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 300)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 20)
    chance = random.Random(6)
    words = ["Alpha", "beta", "ga$mma", "é", "DELTA", "x y", "a\x1cb"]
    rows = [(i, chance.choice([" ", "\n", "\t "]).join(chance.choice(words[: chance.randrange(2, 8)]) for _ in range(chance.randrange(0, 90))), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(12)] + [(5, rows[5][1], "s2"), (None, rows[6][1], None), (200, None, ""), (201, "", "s0"), (None, None, None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 110, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("z").alias("part"), F.lit("z").alias("digest"), F.lit(1).alias("_id"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(0))
    assert audit_rows(filter_audit.audit_filters(docs.repartition(4), marks)) == audited(rows, labels)
    odd = odd_documents.withColumn("source", F.lit("one"))
    assert audit_rows(filter_audit.audit_filters(odd, marks)) == audited([(r.doc_id, r.text, "one") for r in odd.collect()], labels)
    assert filter_audit.audit_filters(docs.where("false"), marks).count() == 0


def test_matrix_is_that_of_the_words(spark, monkeypatch, folder):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(filter_audit, "BUCKET_WORDS", 5000)
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("part"), "text")
    matrix, dictionary = filter_audit.document_term_shards(docs)
    words = {r.id: bytes(r.word) for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    shards, seen = matrix.collect(), 0
    assert len(shards) > 5
    for shard in shards:
        for i, doc in enumerate(shard["ids"]):
            entries = slice(shard["indptr"][i], shard["indptr"][i + 1])
            got = {words[w]: n for w, n in zip(shard["indices"][entries], shard["counts"][entries])}
            assert got == collections.Counter(texts[doc].split())
            seen += 1
    assert seen == len(texts)


@pytest.fixture
def written(monkeypatch):
    """The tables that the audit writes, by name."""
    found, keep = {}, filter_audit.write_and_reread

    def write(df, name, *more):
        found[name] = keep(df, name, *more)
        return found[name]

    monkeypatch.setattr(filter_audit, "write_and_reread", write)
    return found


def test_shards_are_small_rows_in_small_groups(spark, monkeypatch, written, folder):
    for name, value in {"SHARD_BYTES": 20_000, "SHARD_ENTRIES": 1000, "LIST_BYTES": 2000, "GROUP_SHARDS": 3, "BATCH_BYTES": 5000}.items():
        monkeypatch.setattr(filter_audit, name, value, raising=False)
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("part"), "text")
    matrix, dictionary = filter_audit.document_term_shards(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
    footers = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written["shards"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in footers for i in range(m.num_row_groups)]
    assert len(groups) > 5 and max(groups) <= 3
    texts = {r.doc_id: collections.Counter(r.text.encode().split()) for r in docs.collect()}
    most, words = max(map(len, texts.values())) + 16, {r.id: bytes(r.word) for r in dictionary.collect()}
    assert max(r.n for r in written["shards"].select(F.octet_length(F.array_join(F.col("words").cast("array<string>"), "")).alias("n")).collect()) <= 2000 + max(map(len, words.values()))
    shards = matrix.collect()
    assert len({s.shard for s in shards}) == len(shards) and max(len(s["counts"]) for s in shards) <= 1000 + most
    found = {}
    for shard in shards:
        for i, doc in enumerate(shard["ids"]):
            entries = slice(shard["indptr"][i], shard["indptr"][i + 1])
            found[doc] = {words[w]: n for w, n in zip(shard["indices"][entries], shard["counts"][entries], strict=True)}
    assert found == texts


def test_audit_of_rows_sent_one_by_one(spark, monkeypatch):
    for name, value in {"SHARD_BYTES": 900, "SHARD_ENTRIES": 40, "LIST_BYTES": 50, "BUCKET_WORDS": 20, "GROUP_SHARDS": 2, "GROUP_NUMBERS": 2, "BATCH_BYTES": 1}.items():
        monkeypatch.setattr(filter_audit, name, value, raising=False)
    chance = random.Random(8)
    rows = [(i, " ".join(f"w{chance.randrange(1, 90) ** 2}" for _ in range(chance.randrange(0, 120))), f"s{i % 2}") for i in range(80)]
    rows += [(80 + i, chance.choice(["", None, "\n"]), "s0") for i in range(9)] + [(90, "many " * 900, "s1"), (91, rows[3][1], "s0")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(filter_audit.audit_filters(docs.repartition(3), marks)) == audited(rows, labels)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 12345)
    assert audit_rows(filter_audit.audit_filters(docs.repartition(1), marks)) == audited(rows, labels)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "12345"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_words_without_blanks_make_more_buckets(spark, monkeypatch, written):
    monkeypatch.setattr(filter_audit, "BUCKET_BYTES", 10_000, raising=False)
    words = [f"{i}é" * 100 for i in range(300)]
    docs = spark.createDataFrame([(i, "p", " ".join(words[i:i + 40])) for i in range(0, 300, 10)], "doc_id long, part string, text string").coalesce(1)
    assert {r.failed & 3 for r in filter_audit.document_failures(docs).collect()} == {1}
    assert written["numbered"].select("bucket").distinct().count() > 6


def test_no_step_holds_the_shards_of_a_partition(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("part"), "text")
    plan = filter_audit.document_term_shards(docs)[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ShuffledHashJoin" not in plan and "collect_list" not in plan


def test_facts_of_a_long_text_take_little_memory():
    text = ("Plain words of a text, é " * 200_000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 0, len(text) - 7, len(text) - 7, len(text)])
    tracemalloc.start()
    assert filter_audit.text_facts(data, offsets).tolist() == [0, 0, 0, 0]
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    tracemalloc.stop()
    assert filter_audit.text_facts(np.frombuffer(b"ABc$", np.uint8), np.array([0, 0, 3, 4])).tolist() == [0, 4, 8]
