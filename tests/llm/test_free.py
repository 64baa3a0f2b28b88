"""Substring and near-duplicate search, language ID, token counts, pages and vectors."""

import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import langid, order_minhash, pages, projection_forest, substrings, token_counts
from lacuna.llm.components import connected_components
from lacuna.llm.shingles import shingle_hashes, text_bytes, word_hashes
from lacuna.llm.text import bounded_sample, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(chance, n):
    return " ".join("".join(chance.choice("abcdefghij") for _ in range(chance.randrange(2, 8))) for _ in range(n))


# --- helpers -----------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, None), (301, 300), (300, 301)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 31 + 60 + 2
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(31)} | {(i, 100) for i in range(100, 160)} | {(300, 300), (301, 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["A b, c d e f", None, "", "one two", "a b c d e f a b c d e f", "!!", "ü b c d e"]

    def shingles(batch):
        values, numbers = shingle_hashes(*word_hashes(*text_bytes(pa.array(batch, pa.string()))))
        return [part.tolist() for part in np.split(values, np.cumsum(numbers)[:-1])]

    together = shingles(texts)
    assert together == [shingles([t])[0] for t in texts]
    assert [len(s) for s in together] == [2, 0, 0, 1, 8, 0, 1]
    assert len(set(together[4])) == 8 and together[0] == together[4][:2]


def test_bounded_sample(spark):
    rows = bounded_sample(spark.range(10000), 500, 3, "id").collect()
    assert 400 < len(rows) <= 500 and rows == bounded_sample(spark.range(10000).repartition(7), 500, 3, "id").collect()


# --- substring dedup ---------------------------------------------------------


def test_chunks_tile_each_text_and_resist_shifts():
    chance = random.Random(1)
    text = prose(chance, 900).encode()
    shifted = b"xyz " + text[:2000] + b" inserted " + text[2000:]

    def chunks(data):
        ends = substrings.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert ends[-1] == len(data) and (np.diff(ends) > 0).all() and np.diff(ends, prepend=0).max() <= substrings.MOST
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    one, two = chunks(text), chunks(shifted)
    assert len(set(one) & set(two)) > 0.9 * len(one)
    assert substrings.chunk_ends(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))[1][-1] == len(text)
    naive = [sum(int(substrings._GEAR[text[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(300)]
    assert substrings.gear_hashes(np.frombuffer(text, np.uint8))[:300].tolist() == naive


def test_repeated_passages_are_found_and_clean_texts_left(spark, odd_documents):
    chance = random.Random(2)
    passage = prose(chance, 80)
    rows = [(i, prose(chance, 60) + " " + passage + " " + prose(chance, 60) if i < 30 else prose(chance, 200)) for i in range(80)]
    got = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(30))
    texts = dict(rows)
    for r in got:
        # The whole passage, and bytes at either end that two documents share by chance.
        shared = texts[r.doc_id].encode()[r.start:r.end].decode()
        assert f" {passage} " in shared and len(shared) <= len(passage) + 2 + 2 * 16 and r.n_docs_most == 30
        assert r.duplicate == (r.first_doc_id < r.doc_id)
    assert sum(r.first_doc_id == 0 for r in got) >= 20
    ends = substrings.chunk_ends(*text_bytes(pa.array([texts[i] for i in range(80)])))
    for i in range(80):
        assert substrings.chunk_ends(*text_bytes(pa.array([texts[i]])))[0].tolist() == ends[i].tolist()
    odd = substrings.repeated_spans(odd_documents).collect()
    assert {r.doc_id for r in odd} == {1, 2, 3}
    assert substrings.repeated_spans(odd_documents.where("false")).count() == 0


def test_ends_of_spans_against_brute_force(spark):
    """Two holders of each passage, so the holder compared with is the only one."""
    chance = random.Random(21)
    rows, passages = [], []
    for i in range(40):
        passage = prose(chance, chance.choice([45, 60, 120])) + chance.choice(["", "ü" * 3])
        passages.append(passage)
        for side in ("AC", "BD"):
            # Unlike bytes stand next to the passage.
            rows.append((len(rows), prose(chance, 70) + side[0] + passage + side[1] + prose(chance, 70)))
    got = {r.doc_id: r for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(80))
    for doc_id, text in rows:
        r = got[doc_id]
        assert text.encode()[r.start:r.end] == passages[doc_id // 2].encode()
        assert (r.duplicate, r.first_doc_id) == (doc_id % 2 == 1, doc_id // 2 * 2)


def test_spans_of_copies_that_hold_earlier_passages(spark):
    chance = random.Random(12)
    passage = prose(chance, 90)
    host = prose(chance, 150) + passage + prose(chance, 150)
    rows = [(0, prose(chance, 100) + passage + prose(chance, 100)), (5, host), (6, host), (None, host), (None, prose(chance, 60) + passage), (5, passage + prose(chance, 80))]
    got = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.start, r.end, r.duplicate))
    assert [d for *_, d in found[0]] == [False]
    # The copy's first holder keeps what is its own, and its shared passage is marked.
    own = sorted(s for s in found[5] if s[1] <= len(host))
    assert any(d and len(passage) - 200 < e - s for s, e, d in own) and any(not d for *_, d in own)
    assert {d for *_, d in found[6]} == {True} and max(e for _, e, _ in found[6]) == len(host)
    assert all(d for *_, d in found[None]) and sum(e - s for s, e, _ in found[None]) > len(host)


# --- near-duplicates ---------------------------------------------------------


def sequence(text):
    words = WORD.findall((text or "").translate(SMALL))
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute_classes(texts):
    ids = sorted(texts)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sequence(texts[i]), sequence(texts[j])
            same = texts[i] == texts[j] and texts[i] is not None
            if not same and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                shared = longest_common(a, b)
                same = shared / (len(a) + len(b) - shared) >= 0.8
            if same:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("limit", [768, 6])
def test_classes_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(order_minhash, "GROUP_TEXTS", limit)
    chance = random.Random(7)
    texts = {}
    for base in range(12):
        words = prose(chance, chance.choice([12, 40, 90])).split()
        for copy in range(chance.randrange(1, 9)):
            changed = list(words)
            for _ in range(chance.randrange(0, 4)):
                at = chance.randrange(len(changed))
                changed[at:at + 1] = chance.choice([[], ["new"], [changed[at], "more"]])
            if copy == 5:
                changed = changed[len(changed) // 2:] + changed[: len(changed) // 2]
            texts[base * 20 + copy] = " ".join(changed)
    texts |= {900: None, 901: "", 902: "", 903: "!!", 904: "one", 905: "One!"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_band_alignment_equals_the_full_table():
    chance = random.Random(5)
    for _ in range(200):
        a = [chance.randrange(6) for _ in range(chance.randrange(1, 25))]
        b = [chance.randrange(6) for _ in range(chance.randrange(1, 25))]
        want = longest_common(a, b)
        got = order_minhash.common_order(np.array(a, np.uint64), np.array(b, np.uint64), len(a) + len(b))
        assert got == want
        assert order_minhash.common_order(np.array(a, np.uint64), np.array(b, np.uint64), len(a) + len(b) - 2 * want) == want


def test_large_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "GROUP_TEXTS", 8)
    chance = random.Random(9)
    base = prose(chance, 120).split()
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(60)] + [(i, prose(chance, 100)) for i in range(100, 110)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[i] == i for i in range(100, 110))


def test_deduplicated_rows(odd_documents):
    kept = order_minhash.deduplicate(odd_documents)
    assert kept.columns == odd_documents.columns
    # Row 3 shares 38 of 53 shingles with rows 1 and 2, a similarity of 0.56, and stays.
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert order_minhash.deduplicate(odd_documents.where("false")).count() == 0


def test_unlike_texts_with_one_id_or_none_stay(spark):
    chance = random.Random(21)
    texts = [prose(chance, 60) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (8, texts[4]), (9, texts[5]), (7, texts[4]), (None, texts[0]), (None, texts[4]), (3, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in order_minhash.deduplicate(docs).collect()), key=repr)
    assert kept == sorted([(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (3, texts[6])], key=repr)
    roots = {r.text: r.root for r in order_minhash.near_duplicate_classes(docs).join(docs.select("text", F.unhex(F.md5("text")).alias("node")).distinct(), "node").collect()}
    assert len(set(roots.values())) == 7


# --- language ID -------------------------------------------------------------


def test_backpropagation_equals_differences():
    chance = np.random.default_rng(1)
    net = langid.train([b"abc def", b"xyz uvw", b"aab"], ["a", "b", "a"], hidden=3, updates=1)
    net = langid.Network(net.languages, *[[p.astype(np.float64) for p in part] for part in (net.inputs, net.recurrent, net.bias)], net.out.astype(float), net.out_bias.astype(float))
    codes = chance.integers(97, 123, (4, langid.WINDOW)).astype(np.uint8)
    labels, present = np.array([0, 1, 1, 0]), np.ones((langid.WINDOW, 4))

    def loss():
        return -np.log(langid.probabilities(net, codes)[:, np.arange(4), labels].astype(np.float64)).mean()

    for p, g in zip(net.parameters(), langid._gradients(net, codes, labels, present)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = p[at], 1e-3
        p[at] = before + step
        up = loss()
        p[at] = before - step
        down = loss()
        p[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_held_out_accuracy_and_whole_texts(spark, folder):
    docs = table(spark, folder, "documents")
    net = langid.fit(docs)
    got = langid.identify(docs, net, ["doc_id", "lang"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    # A text in letters that were never learned comes close to chance.
    strange = spark.createDataFrame([(2, "Ελληνικά γράμματα " * 20)], "doc_id long, text string")
    assert langid.identify(strange, net, ["doc_id"]).first().score < min(r.score for r in got)
    assert min(r.score for r in got) >= langid.least_score(net) == pytest.approx(0.4) and langid.least_score(None) == 0
    # The end of a long text counts as much as its start.
    german = " ".join(r.text for r in docs.where("lang = 'de'").limit(4).collect())
    english = " ".join(r.text for r in docs.where("lang = 'en'").limit(4).collect())[: len(german) // 3]
    mixed = spark.createDataFrame([(1, english + german)], "doc_id long, text string")
    assert langid.identify(mixed, net, ["doc_id"]).first().lang_pred == "de"


def test_language_of_odd_documents(spark, odd_documents):
    rows = langid.language_table(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (4, 5, 6, 7))
    kept = langid.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and not {4, 5, 6, 7} & {r.doc_id for r in kept.collect()}
    none = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_table(none).collect()} == {"und"}
    assert langid.language_table(odd_documents.where("false")).count() == 0


# --- token counts ------------------------------------------------------------

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.skipif(not os.path.exists(MODEL), reason="needs the vocabulary files")
def test_counts_equal_the_tokenizer(spark, folder, odd_documents):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.read_vocabulary(MODEL)
    full = [("<unk>", 0.0), *vocabulary, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    tokenizer = Tokenizer(models.Unigram(full, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, vocabulary).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    counter = token_counts.Counter(vocabulary)
    for text in ["", " ", "  a", "a  b ", "▁x", "日本語 😀😀", "\n\t\x00", "é́", "x" * 5000, "<unk>"]:
        assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    assert token_counts.count_tokens(odd_documents, vocabulary).count() == odd_documents.count()


def test_ties_and_unknown_characters():
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("▁b", -2.0)])
    # Equal scores: the match that starts first stays, so "aa" is one piece.
    assert counter.text("aa") == 2 and counter.text("b") == 1 and counter.text("é") == 3
    assert token_counts.Counter([]).text("ab") == len("▁ab".encode())


# --- pages -------------------------------------------------------------------


def test_articles_of_the_pages(spark, folder):
    import html

    for r in pages.extract_text(table(spark, folder, "pages")).join(table(spark, folder, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?h1>|</?p>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_other_parts_are_left_out():
    long = "some words of the story, " * 8
    page = (
        "<body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><header>Site</header>"
        f"<div id=story><h1>Title</h1><p>{long}&amp; &lt;b&gt;</p><p>Short\n end.</p></div><aside>More</aside>"
        f"<form><p>{long}</p></form><div class=comments><p>{long}</p></div><footer>{long}</footer><script>var a='<p>x</p>'</script></body>"
    )
    assert pages.main_text(page) == f"Title\n\n{' '.join(long.split())} & <b>\n\nShort end."
    assert pages.main_text(None) == "" and pages.main_text("<nav>menu") == "" and pages.main_text("<p>x") == ""
    assert pages.main_text("<nav>open <article><p>kept</p></article>") == "kept"


STORY = "some words of the story that goes on, " * 12


@pytest.mark.parametrize("page, want", [
    ("<div>" + "<p>STORY</p>" * 3 + "</div><div class='comments'><article class=comment><p>reader words " + "and more " * 20 + "</p></article></div>", 3),
    ("<p>STORY</p><p>STORY</p><article class='comment'>I liked it very much, more please</article>", 2),
    ("<aside><article>Teaser</article></aside><div><p>STORY<p>STORY</div>", 2),
    ("<article>Teaser</article><ul><li><a href=x>a</a><li><a href=y>b</a><li><a href=z>c</a></ul><div><p>STORY</p><p>STORY</p></div>", 2),
    ("<p class='ad'>Buy<p>STORY<p>STORY", 2),
    ("<ul class=menu><li>one<li>two</ul><article class='post comments-open'><p>STORY</p></article>", 1),
    ("<body class='has-sidebar'><div class='no-sidebar'><p>STORY</p></div></body>", 1),
    ("<title>Not this</title><p title=it's>STORY", 1),
    ("<div><aside>More</div><p>STORY</p>", 1),
    ("<p>STORY<!-- <p>no</p> --><script>if (a < b) '</p>'</script></p>", 1),
])
def test_misleading_pages(page, want):
    story = " ".join(STORY.split())
    assert pages.main_text(page.replace("STORY", STORY)) == "\n\n".join([story] * want)


def test_captions_stay_and_broken_markup_is_fast():
    import time

    page = f"<article><p>{STORY}</p><figure><img src=x><figcaption>A view</figcaption></figure><p>{STORY}</p></article>"
    assert "\n\nA view\n\n" in pages.main_text(page)
    for broken in ("<a title=\"x ", "<a title='", "<p class=", "<b>", "<div><p>", "<!-- ", "<script>", "< ", "<li>", "</b>", "<td><b>"):
        start = time.perf_counter()
        pages.main_text(broken * (1_000_000 // len(broken)))
        assert time.perf_counter() - start < 5, broken


def test_pages_with_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<article>é</article>")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in pages.extract_text(rows).collect()) == [0, 0, 1]
    assert pages.extract_text(rows.where("false")).count() == 0


# --- vectors -----------------------------------------------------------------


def test_links_match_brute_force(spark, monkeypatch):
    chance = np.random.default_rng(3)
    centres = chance.standard_normal((40, 24))
    vectors = [(c + 0.18 * chance.standard_normal((30, 24))) for c in centres]
    vectors = np.concatenate([*vectors, np.repeat(centres[:1], 50, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [
        (5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, None]), (5004, [float("nan")] * 24), (5005, [float("inf")] * 24), (None, [1.0] * 24),
        (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (6000, [1.0, 0.0, 0.0]), (6000, [0.0, 1.0, 0.0]), (6001, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (6002, [0.0, 0.01, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = projection_forest.unit_rows(vectors)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    for tile in (1024, 40):
        monkeypatch.setattr(projection_forest, "TILE", tile)
        found = projection_forest.vector_links(frame, leaf=60).collect()
        got = {r.vec_id: r for r in found}
        assert len(found) == len(rows)
        # Unlike vectors of one id have their own links, and a vector without id links too.
        assert sorted((r.n_links, r.component_id) for r in found if r.vec_id == 6000) == [(0, 6000), (1, 6000)]
        assert got[6001].component_id == 6000 and (got[6002].n_links, got[6002].component_id) == (1, 6002)
        assert sorted((r.n_links, r.component_id) for r in found if r.vec_id is None) == [(0, None), (1, 6002)]
        found = sum(got[i].n_links for i in range(len(vectors)))
        assert all(got[i].n_links <= linked[i].sum() for i in range(len(vectors)))
        assert found >= 0.99 * linked.sum()
        assert all(got[i].n_links == 0 and got[i].kept for i in range(5000, 5006))
        assert (got[5006].n_links, got[5007].component_id, got[5007].kept) == (1, 5006, False)
        low = np.arange(len(vectors))
        while True:
            near = np.minimum(low, np.where(linked, low, 10**9).min(axis=1))
            if (near == low).all():
                break
            low = near
        assert sum(got[i].component_id == low[i] for i in range(len(vectors))) >= 0.99 * len(vectors)
    assert projection_forest.vector_links(frame.where("false")).count() == 0
