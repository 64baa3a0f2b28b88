"""Benchmark passages in documents, found by winnowing.

A window is ``window`` consecutive words of an item (or all its words, if it has
fewer). Of every run of ``window - k + 1`` neighbouring k-grams the least hash is
a fingerprint, so a span of ``window`` words shared by a document and an item
shares a fingerprint at the same place within the span: nothing is missed.
Fingerprints of documents and items are joined, and each hit is extended to the
windows around it, which are compared word by word.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .text import let, unused, words_of

WINDOW = 10
GRAM = 5
#: An item side of at most so many windows is broadcast (about 40 MB at 100 bytes
#: each); a larger one is joined by shuffle.
BROADCAST_WINDOWS = 400_000


def _grams(words: Column, size: int) -> Column:
    """Hash of ``size`` words from each place on (of fewer at the end)."""
    return F.transform(words, lambda word, i: F.xxhash64(word, *[F.get(words, i + j) for j in range(1, size)]))


def _winnowed(hashes: Column, span: int) -> Column:
    """The least of ``span`` hashes from each place on, without neighbouring repeats.

    Runs cut short by the end only add fingerprints.
    """
    least = F.transform(hashes, lambda first, i: F.least(first, *[F.get(hashes, i + j) for j in range(1, span)]))
    return let(least, lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1) != x)))


def _marks(words: Column, length: int, window: int, k: int) -> Column:
    """Fingerprints for windows of ``length`` words: winnowed for full windows, all grams for short ones."""
    if length == window:
        return let(_grams(words, k), lambda hashes: _winnowed(hashes, window - k + 1))
    return _grams(words, length)


def _windows_at(words: Column, gram: Column, length: int, window: int, k: int) -> Column:
    """(start, words) of the windows that hold the k-gram with a hash, wherever it occurs."""
    size = k if length == window else length
    places = let(_grams(words, size), lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i) == gram))
    starts = F.flatten(F.transform(places, lambda i: F.transform(F.array(*[F.lit(j) for j in range(length - size + 1)]), lambda j: i - j)))
    inside = F.filter(starts, lambda at: (at >= 0) & (at + length <= F.size(words)))
    return F.transform(F.array_distinct(inside), lambda at: F.struct(
        at.alias("start"), F.array_join(F.slice(words, at + 1, length), " ").alias("words")
    ))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(words, length, item_id), one row per window of each item."""
    worded = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    return worded.select(
        "item_id", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("w")
    ).select("item_id", "length", F.array_join("w", " ").alias("words"), "w").distinct()


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def _candidates(docs: DataFrame, marks: DataFrame, lengths: list[int], window: int, k: int, small: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, length, start, words): windows around shared fingerprints.

    Each document also gets one row whose ``length`` is null.
    """
    words = docs.select("doc_id", _text_hash(), words_of(F.col("text")).alias("w"))

    def labelled(length):
        return F.transform(
            _marks(F.col("w"), length, window, k), lambda gram: F.struct(F.lit(length).alias("length"), gram.alias("gram"))
        )

    kinds = [labelled(n) for n in lengths]
    own = F.array(F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("gram")))
    shared = marks.withColumn("shared", F.lit(True))
    if small:
        # One scan without a shuffle; a row's words are only referred to until a fingerprint matches.
        found = words.select("doc_id", "text_hash", "w", F.explode(F.concat(own, *kinds)).alias("m")).select(
            "doc_id", "text_hash", "w", "m.length", "m.gram"
        ).join(F.broadcast(shared), ["length", "gram"], "left").where(F.col("length").isNull() | F.col("shared"))
    else:
        # Only ids and fingerprints are shuffled; words are looked up for documents with a hit.
        exploded = words.select("doc_id", "text_hash", F.explode(F.concat(*kinds)).alias("m")).distinct()
        hits = exploded.select("doc_id", "text_hash", "m.length", "m.gram").join(shared, ["length", "gram"], "left_semi")
        hits = hits.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        found = words.join(hits, same).select("doc_id", "text_hash", "w", "length", "gram").unionByName(
            words.select("doc_id", "text_hash", "w", F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("gram"))
        )
    around = F.lit(None).cast("array<struct<start:int,words:string>>")
    for n in lengths:
        around = F.when(F.col("length") == n, _windows_at(F.col("w"), F.col("gram"), n, window, k)).otherwise(around)
    return found.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "length", F.explode_outer(around).alias("at")
    ).select("doc_id", "text_hash", "n_words", "length", "at.start", "at.words")


def find_passages(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """How much of each of ``docs`` (doc_id, text) lies in windows of ``items`` (item_id, text).

    Returns doc_id, text_hash, n_words, n_hit (words inside any occurrence) and
    items (distinct ids, sorted as strings), one row per row of ``docs``. Null
    texts have no words; texts and items without words match nothing.
    """
    windows = write_and_reread(item_windows(items, window), "windows")
    small = windows.count() <= broadcast_windows
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``window`` values
    if not lengths:
        return docs.select(
            "doc_id", _text_hash(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
        )
    marks = None
    for n in lengths:
        own = windows.where(F.col("length") == n).select("length", F.explode(_marks(F.col("w"), n, window, k)).alias("gram"))
        marks = own if marks is None else marks.unionByName(own)
    found = write_and_reread(_candidates(docs, marks.distinct(), lengths, window, k, small), "passages")
    texts = windows.select("words", "item_id")
    exact = found.where("start IS NOT NULL").join(F.broadcast(texts) if small else texts, "words")
    # Sets, built before the shuffle: of a document at most its own places and the ids of the items.
    hits = exact.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _covered(F.array_sort("spans")).alias("n_hit"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return found.where("length IS NULL").join(hits, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(state, span):
        more = F.greatest(F.lit(0), span["end"] - F.greatest(state["end"], span["start"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["end"], span["end"]).alias("end"))

    return F.aggregate(spans, start, add, lambda state: state["n"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; without an occurrence the digest is that of the
    empty string. Repeated rows stay repeated, null ids stay null.
    """
    return find_passages(docs, items, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence, with all their columns."""
    own_id, own_hash = unused(docs, "_id", "_hash")
    found = find_passages(docs.select("doc_id", "text"), items, **options).where("n_hit > 0").select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)
    )
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_hash))
    return docs.join(found, same, "left_anti")
