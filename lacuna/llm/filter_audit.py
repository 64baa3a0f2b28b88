"""How document filters overlap, counted from a sparse document-term matrix.

Words are dictionary-encoded over the whole corpus and documents become rows of a
matrix in compressed sparse row (CSR) form, cut into shards of bounded size. A
row's sum is the document's number of words and its number of nonzero entries the
number of distinct words, which decide the filters on length and repetition. The
other filters look at signs, capitals and equal texts. Every order of the filters
is then worked out from the counts per set of failed filters.

Each stretch of texts encodes its own words first. Its word list alone goes to the
buckets of the dictionary, packed into one row per bucket, and the ids come back the
same way. So a word that stands in every document costs one entry per stretch and not
one per occurrence, and a bucket holds the words of one share of the hash values.

No task holds more than a stretch or a bucket, however large its share of the table
is. Rows are small: a stretch is cut into shards of the matrix and pieces of its word
list. Shards and the ids of their words are sorted together, and the encoder reads
them as a stream, one stretch at a time.
"""

from collections.abc import Iterator
from itertools import groupby, pairwise, permutations, zip_longest
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import arrow_batches, write_and_reread

from .shingles import mix, text_bytes

#: Bytes of text in a stretch; a longer text begins one of its own.
SHARD_BYTES = 4 << 20
#: Entries of the matrix in a shard, and of bytes in a piece of a word list.
SHARD_ENTRIES, LIST_BYTES = 1 << 15, 1 << 19
#: What a document or word counts for besides its entries or bytes.
ROW_SIZE = 16
#: Entries of stretches' word lists that a bucket of the dictionary should hold.
BUCKET_WORDS = 1 << 19
#: Bytes of those words that it should hold; words are as long as texts have no blanks.
BUCKET_BYTES = 16 << 20
#: Shards, and rows of a bucket's numbers, that are written and read at once.
GROUP_SHARDS, GROUP_NUMBERS = 16, 1 << 10
#: Bytes that are sent to Python at once.
BATCH_BYTES = 2 << 20

#: Filters in the order of their bits in a set of failures.
FILTERS = "ABCDE"
#: Least number of words (A), least percent of distinct words (B), greatest percent of capitals (C).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
# The signs of filter D, and the bytes between words.
SIGNS = b"#$%&*|"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_BLANK = bytes(b in BLANKS for b in range(256))
_SIGN = bytes(b in SIGNS for b in range(256))
_CAPITALS_BIT, _SIGNS_BIT = 4, 8
#: Lists of a shard that go on to the encoder.
_OWN_LISTS = ("ids", "parts", "digests", "failed", "indptr", "gaps", "counts")


def _marked(data: np.ndarray, marks: bytes) -> np.ndarray:
    """The mark of each byte; indexing by bytes would take eight bytes for each."""
    return np.frombuffer(data.tobytes().translate(marks), bool)


def text_facts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters C and D that each text fails; offsets as bounds of the texts in data."""

    bounds = list(pairwise(offsets.tolist()))

    def per_text(marked):
        return np.array([np.count_nonzero(marked[low:high]) for low, high in bounds], np.int64)

    capitals = per_text((data >= 65) & (data <= 90))
    points = per_text((data & 0xC0) != 0x80)
    return _CAPITALS_BIT * (100 * capitals > MOST_CAPITALS * points) + _SIGNS_BIT * (per_text(_marked(data, _SIGN)) > 0)


def local_matrix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(indptr, indices, counts, words) of the texts in CSR form; indices point into words."""
    inside = ~_marked(data, _BLANK)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # Words end with their text, whatever the next one starts with.
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] = inside[first]
    closes[first[1:] - 1] = inside[first[1:] - 1]
    starts = np.flatnonzero(opens)
    ends = np.cumsum(np.flatnonzero(closes) + 1 - starts)
    buffers = [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    owner = np.searchsorted(offsets, starts, side="right") - 1
    width = max(len(coded.dictionary), 1)
    entries, counts = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    indptr = np.searchsorted(entries, np.arange(len(offsets)) * width)
    return indptr, entries % width, counts, coded.dictionary.cast(pa.binary())


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of runs that add up to about ``most``; an entry that is larger begins a run."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0))
    return [(low, high) for low, high in pairwise([0, *cuts.tolist(), len(sizes)]) if low < high]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, cut or put together into stretches."""
    held, size = [], 0
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column("text"))[1])
        for low, high in _runs(sizes, SHARD_BYTES):
            more = int(sizes[low:high].sum())
            if held and size + more > SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held, size = [*held, batch.slice(low, high - low)], size + more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards: ``at`` counts those of a stretch, and each takes a piece of the stretch's words along."""
    for batch in _stretches(batches):
        data, offsets = text_bytes(batch.column("text"))
        indptr, indices, counts, words = local_matrix(data, offsets)
        failed = text_facts(data, offsets).astype(np.int32)
        sizes = pc.binary_length(words).to_numpy()
        shards, pieces = _runs(np.diff(indptr) + ROW_SIZE, SHARD_ENTRIES), _runs(sizes + ROW_SIZE, LIST_BYTES)
        for at, ((first, last), (word, end)) in enumerate(zip_longest(shards, pieces, fillvalue=(0, 0))):
            own = slice(indptr[first], indptr[last])
            lists = [
                *(batch.column(c).slice(first, last - first) for c in ("doc_id", "part", "digest")), pa.array(failed[first:last]),
                pa.array(indptr[first:last + 1] - indptr[first]), pa.array(np.diff(indices[own], prepend=0).astype(np.int32)),
                pa.array(counts[own].astype(np.int32)), words.slice(word, end - word),
            ]
            numbers = [at, word, end - word, int(sizes[word:end].sum(dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*(_one_list(v) for v in lists), *(pa.array([n]) for n in numbers)],
                [*_OWN_LISTS, "words", "at", "first", "n_words", "n_bytes"],
            )


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _word_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    places = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    powers = np.cumprod(np.full(int(np.diff(offsets).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    return mix(np.add.reduceat(mix(data + np.uint64(1)) * powers[places], offsets[:-1] - offsets[0]))


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[pa.Array]]]:
    """(stretch, places, words) with the pieces that come one after another together; places are those in the whole list."""
    rows = (row for b in batches for row in zip(b.column("stretch").to_pylist(), b.column("first").to_pylist(), b.column("words"), strict=True) if len(row[2].values))
    for stretch, pieces in groupby(rows, key=lambda row: row[0]):
        pieces = [(first, words.values) for _, first, words in pieces]
        yield stretch, np.concatenate([np.arange(first, first + len(words), dtype=np.int32) for first, words in pieces]), [words for _, words in pieces]


def _packed(buckets: int):
    """Function for ``mapInArrow``: the word list of a stretch as one row per bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, places, words in _word_lists(batches):
            bucket = np.concatenate([(_word_hashes(w) % np.uint64(buckets)).astype(np.int64) for w in words])
            order = np.argsort(bucket, kind="stable")
            own, starts = np.unique(bucket[order], return_index=True)
            bounds = pa.array(np.append(starts, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own), pa.array(np.full(len(own), stretch)), pa.ListArray.from_arrays(bounds, pa.array(places[order])),
                    pa.ListArray.from_arrays(bounds, pa.concat_arrays(words).take(pa.array(order))),
                ],
                ["bucket", "stretch", "places", "words"],
            )

    return pack


def _numbered(key: tuple, group: pa.Table) -> pa.Table:
    """The different words of a bucket (a row without stretch), and their numbers in the bucket for every stretch."""
    lists = group.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    numbers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)), coded.indices.cast(pa.int32()))
    n = len(group) + 1
    return pa.table({
        "bucket": pa.repeat(key[0], n), "stretch": pa.concat_arrays([pa.nulls(1, pa.int64()), group.column("stretch").combine_chunks()]),
        "places": pa.concat_arrays([pa.nulls(1, pa.list_(pa.int32())), group.column("places").combine_chunks().cast(pa.list_(pa.int32()))]),
        "numbers": pa.concat_arrays([pa.nulls(1, pa.list_(pa.int32())), numbers.cast(pa.list_(pa.int32()))]),
        "words": pa.concat_arrays([_one_list(coded.dictionary).cast(pa.list_(pa.binary())), pa.nulls(n - 1, pa.list_(pa.binary()))]),
        "n_words": pa.concat_arrays([pa.array([len(coded.dictionary)]), pa.nulls(n - 1, pa.int64())]),
    })


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with the ids of the dictionary in place of their stretch's word numbers.

    Rows come by stretch: those with the numbers of its words, by bucket, and then
    its shards, which have no offset.
    """
    places, ids, columns, known = [], [], None, None
    for batch in batches:
        stretches, low = batch.column("stretch").to_numpy(), 0
        for at in [*np.flatnonzero(batch.column("offset").is_null().to_numpy(zero_copy_only=False)), batch.num_rows]:
            coded, low = batch.slice(low, at - low), at + 1
            if coded.num_rows:
                sizes = coded.column("places").value_lengths().to_numpy()
                # Copied, as a batch would stay for as long as a part of it.
                places.append(coded.column("places").flatten().to_numpy().copy())
                ids.append(coded.column("numbers").flatten().to_numpy() + np.repeat(coded.column("offset").to_numpy(), sizes))
            if at == batch.num_rows:
                break
            if stretches[at] != known:
                columns, known = np.zeros(sum(map(len, places)), np.int64), stretches[at]
                for here, there in zip(places, ids, strict=True):
                    columns[here] = there
                places, ids = [], []
            value = {name: batch.column(name)[at].values for name in _OWN_LISTS}
            if not len(value["ids"]):  # it only took words along
                continue
            value["gaps"] = pa.array(columns[np.cumsum(value["gaps"].to_numpy(), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard").slice(at, 1), *(_one_list(v) for v in value.values())],
                ["shard", *("indices" if name == "gaps" else name for name in _OWN_LISTS)],
            )


def _local_and_coded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shards with word numbers of their stretch, behind the dictionary's numbers of its words, and the dictionary (word, id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    local = read.mapInArrow(
        _shards,
        f"ids array<{kind}>, parts array<string>, digests array<binary>, failed array<int>, indptr array<bigint>, gaps array<int>, counts array<int>, words array<binary>, at bigint, first bigint, n_words bigint, n_bytes bigint",
    )
    # Ids count on within a task, so rows of a stretch have the same id less their place.
    local = local.withColumn("shard", F.monotonically_increasing_id()).withColumn("stretch", F.col("shard") - F.col("at"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        local = write_and_reread(local, "shards", GROUP_SHARDS)
    entries, size = (n or 0 for n in local.agg(F.sum("n_words"), F.sum("n_bytes")).first())
    packed = local.select("stretch", "first", "words").mapInArrow(
        _packed(max(-(-entries // BUCKET_WORDS), -(-size // BUCKET_BYTES), 1)), "bucket bigint, stretch bigint, places array<int>, words array<binary>"
    )
    numbered = packed.groupBy("bucket").applyInArrow(
        _numbered, "bucket bigint, stretch bigint, places array<int>, numbers array<int>, words array<binary>, n_words bigint"
    )
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        numbered = write_and_reread(numbered, "numbered", GROUP_NUMBERS)
    # A bucket's ids follow those of the buckets before it: one row of two numbers per bucket.
    words = numbered.where("stretch IS NULL")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = words.select(F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("offset"))
    offsets = write_and_reread(offsets, "offsets")
    same = F.col("bucket") == F.col("_bucket")
    dictionary = words.join(offsets, same).select("offset", F.posexplode("words").alias("at", "word")).select("word", (F.col("offset") + F.col("at")).alias("id"))
    parts = numbered.where("stretch IS NOT NULL").join(offsets, same).select("stretch", "offset", "places", "numbers")
    both = parts.unionByName(local.select("stretch", "shard", *_OWN_LISTS), allowMissingColumns=True)
    return both.repartition("stretch").sortWithinPartitions("stretch", F.col("offset").asc_nulls_last()), dictionary


def document_term_shards(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``docs`` (doc_id, part, text), and the dictionary (word, id).

    The matrix has one row per shard: ids, parts, digests (SHA-256 of the text),
    failed (bits of C and D) with an entry per document, and indptr, indices,
    counts in CSR form: the entries of document i stand from indptr[i] to
    indptr[i + 1], and indices are ids of the dictionary, which numbers the
    corpus's words from 0 without gaps. A null text is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined, dictionary = _local_and_coded(docs)
    schema = f"shard bigint, ids array<{kind}>, parts array<string>, digests array<binary>, failed array<int>, indptr array<bigint>, indices array<bigint>, counts array<int>"
    return joined.mapInArrow(_encoded, schema), dictionary


def _row_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row sums and nonzero counts of each shard's rows."""
    for batch in _encoded(batches):
        values = {name: batch.column(name)[0].values for name in batch.schema.names if name != "shard"}
        indptr, counts = values["indptr"].to_numpy(), values["counts"].to_numpy()
        sums = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[indptr])
        # Entries of a row are its different ids.
        filled = np.concatenate([[0], np.cumsum(counts > 0)])
        yield pa.RecordBatch.from_arrays(
            [values["ids"], values["parts"], values["digests"], values["failed"], pa.array(sums), pa.array(np.diff(filled[indptr]).astype(np.int64))],
            ["doc_id", "part", "digest", "failed", "n_words", "n_distinct"],
        )


def document_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) per row of ``docs`` (doc_id, part, text): the set of failed filters as bits, A the lowest."""
    matrix, _ = _local_and_coded(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = matrix.mapInArrow(
        _row_facts, f"doc_id {kind}, part string, digest binary, failed int, n_words long, n_distinct long"
    )
    short = F.col("n_words") < LEAST_WORDS
    repetitive = 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")
    rows = facts.select("doc_id", "part", "digest", (F.col("failed") + short.cast("int") + 2 * repetitive.cast("int")).alias("failed"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        rows = write_and_reread(rows, "failed")
    # The least id of a text; copies are summed before the shuffle, and the join deals them by their ids too.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest")
    same = (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first"))
    later = F.col("_digest").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, same, "left").select("doc_id", "part", (F.col("failed") + 16 * later.cast("int")).alias("failed"))


def _bit(order: Column, step: Column) -> Column:
    """Bit of the filter at a place of an order; places count from 1."""
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substr(order, step, F.lit(1))) - 1)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Effect of every filter at every place of every order, per part of ``docs`` (doc_id, source, text).

    One row per part (source; null is the empty string), filter_order and step
    with kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, all counts of documents. ``labels`` has doc_id, quality and toxic;
    a document is good or toxic if any of its labels says so. Null texts are
    empty and equal each other; a row without id has no labels and is nobody's
    copy. Repeated rows count each. An empty table has no parts and no rows.
    """
    rows = document_failures(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = rows.join(marks, F.col("doc_id") == F.col("_id"), "left")
    counts = marked.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    # At most 32 sets of failures per part.
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    places = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    each = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(places))
    earlier = F.filter(places, lambda place: place < F.col("step"))
    each = each.withColumns({
        "bit": _bit(F.col("filter_order"), F.col("step")),
        "before": F.aggregate(earlier, F.lit(0), lambda bits, place: bits + _bit(F.col("filter_order"), place)),
    })

    def total(condition, amount):
        def add(value, one):
            return value + F.when(condition(one["failed"]), amount(one)).otherwise(0)

        return F.aggregate("sets", F.lit(0).cast("long"), add)

    def fails(failed):
        return failed.bitwiseAND(F.col("bit")) != 0

    def gone(failed):
        return failed.bitwiseAND(F.col("before")) != 0

    def removed(failed):
        return fails(failed) & ~gone(failed)

    def orders_removed_by(one):
        # Of the orders, each filter that a document fails comes first in an equal share.
        return one["n"] * F.lit(factorial(len(FILTERS))) / F.bit_count(one["failed"])

    return each.select(
        "part", "filter_order", "step",
        total(lambda s: ~fails(s) & ~gone(s), lambda one: one["n"]).alias("kept"),
        total(removed, lambda one: one["n"]).alias("removed"),
        total(lambda s: fails(s) & gone(s), lambda one: one["n"]).alias("redundant"),
        total(lambda s: s == F.col("bit"), lambda one: one["n"]).alias("unique_fails"),
        total(removed, lambda one: one["good"]).alias("good_lost"),
        total(removed, lambda one: one["toxic"]).alias("toxic_lost"),
        total(fails, lambda one: orders_removed_by(one).cast("long")).alias("shapley"),
    )
