"""Passages that repeat across documents, by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text. A chunk ends where the top bits
of the hash are zero, at least ``LEAST`` and at most ``MOST`` bytes after the one
before. The hash knows only the last 32 bytes, so after an insertion the cuts fall
into step again, and a passage that two texts share is cut alike within both.
Chunks are matched by digest; neighbouring chunks that repeat form one span, and
where a span's next chunk isn't repeated whole, its bytes are compared with what
stands there in the document that holds the span's last chunk first.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .shingles import mix, text_bytes

LEAST, MOST = 16, 256
#: A cut after one in 2**CUT_BITS places, so chunks hold about 48 bytes.
CUT_BITS = 5
#: Repeated bytes in a row that make a passage.
PASSAGE = 80
#: Bytes that the hash knows.
REACH = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_CHUNK = 1 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Hash at each byte: the gear values of the last 32 bytes, each shifted by its distance."""
    rolled = _GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        before = np.zeros_like(rolled)
        before[reach:] = rolled[:-reach] << np.uint32(reach)
        rolled = rolled + before
    return rolled


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each text, the last being the end of the text; offsets as bounds of the texts in data."""
    places = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    bounds = np.searchsorted(places, offsets, side="right")
    found = []
    for i in range(len(offsets) - 1):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        # The first 31 bytes of a text also hash bytes of the text before, so no chunk is cut there.
        own = places[bounds[i]:bounds[i + 1]]
        ends, last = [], begin
        for place in own[own - begin >= REACH].tolist():
            while place - last > MOST:
                last += MOST
                ends.append(last)
            if place - last >= LEAST:
                last = place
                ends.append(last)
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if last < end:
            ends.append(end)
        found.append(np.array(ends, np.int64) - begin)
    return found


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: doc_id, text_hash, start, end, digest; about a megabyte of whole texts at once."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column("text"))[1])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _CHUNK, prepend=0))
        for low, high in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if low == high:
                continue
            data, offsets = text_bytes(batch.column("text").slice(low, high - low))
            per_text = chunk_ends(data, offsets)
            counts = [len(ends) for ends in per_text]
            if not sum(counts):
                continue
            starts = np.concatenate([np.concatenate([[0], ends[:-1]]) if len(ends) else ends for ends in per_text]).astype(np.int64)
            ends = np.concatenate(per_text)
            begin = np.repeat(offsets[:-1], counts)
            raw = data.tobytes()
            digests = [
                hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip((begin + starts).tolist(), (begin + ends).tolist(), strict=True)
            ]
            owner = pa.array(np.repeat(np.arange(low, high), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("text_hash").take(owner), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), pa.array(digests, pa.binary())],
                ["doc_id", "text_hash", "start", "end", "digest"],
            )


def text_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end (bytes), digest of every chunk of ``docs`` (doc_id, text); null and empty texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return read.mapInArrow(_chunks, f"doc_id {kind}, text_hash bigint, start int, end int, digest binary")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per place asked for: the bytes in front of it, nearest first, or those behind it; at most ``MOST``."""
    names = ["doc_id", "place", "text_hash"]
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw, asked = data.tobytes(), batch.column("asked")
        owner = np.repeat(np.arange(len(batch)), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        begin, end = offsets[:-1][owner].tolist(), offsets[1:][owner].tolist()
        found = [
            raw[max(low, low + at - MOST):low + at][::-1] if left else raw[low + at:min(high, low + at + MOST)]
            for low, high, at, left in zip(begin, end, flat.field("at").to_pylist(), flat.field("left").to_pylist(), strict=True)
        ]
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n).take(owner) for n in names], *[flat.field(n) for n in ("digest", "left", "at", "room")], pa.array(found, pa.binary())],
            [*names, "digest", "left", "at", "room", "context"],
        )


def _alike(one: Column, two: Column) -> Column:
    """Number of first bytes that two binary columns share, up to 255, by halving."""
    def longer(n: Column, step: Column) -> Column:
        fits = (n + step <= F.least(F.octet_length(one), F.octet_length(two))) & (F.substring(one, F.lit(1), n + step) == F.substring(two, F.lit(1), n + step))
        return F.when(fits, n + step).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << bit) for bit in range(7, -1, -1)]), F.lit(0), longer)


def _reaches(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """place, text_hash, left, at, reach: by how many bytes a run of chunks goes on at that end.

    A run of a document that doesn't hold the chunk at that end first is compared
    with the first holder, a first holder's with the last one. Only chunks at
    ends of runs are looked up, and one row per chunk and side is joined back.
    """
    ends = marked.where("front > 0").select("digest", F.lit(True).alias("left"))
    ends = ends.union(marked.where("behind > 0").select("digest", F.lit(False).alias("left"))).distinct()
    asked = marked.join(ends, "digest").select(
        "place", "text_hash", F.struct(
            "digest", "left", F.when(F.col("left"), F.col("start")).otherwise(F.col("end")).alias("at"),
            F.when(F.col("left"), F.col("front")).otherwise(F.col("behind")).alias("room"),
        ).alias("asked"),
    ).groupBy("place", "text_hash").agg(F.collect_list("asked").alias("asked"))
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).withColumn("place", F.xxhash64("doc_id", "text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = texts.join(asked, ["place", "text_hash"]).select("doc_id", "place", "text_hash", "text", "asked")
    contexts = write_and_reread(
        read.mapInArrow(_contexts, f"doc_id {kind}, place bigint, text_hash bigint, digest binary, left boolean, at int, room int, context binary"), "contexts"
    )
    holder = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place", "context")
    holders = contexts.groupBy("digest", "left").agg(F.min(holder).alias("first"), F.max(holder).alias("last"))
    other = F.when(F.col("place") == F.col("first.place"), F.col("last.context")).otherwise(F.col("first.context"))
    joined = contexts.where("room > 0").join(holders, ["digest", "left"])
    own = F.substring(F.col("context"), F.lit(1), F.col("room"))
    pairs = joined.select("place", "text_hash", "left", "at", own.alias("own"), other.alias("other"))
    # Equal rows of documents give equal rows here.
    return pairs.groupBy("place", "text_hash", "left", "at").agg(F.max(_alike(F.col("own"), F.col("other"))).alias("reach")).where("reach > 0")


def repeated_spans(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Spans of text that repeat across documents, ``passage`` bytes or longer.

    Returns doc_id, start, end (bytes of the UTF-8 text), n_chunks, n_docs_least
    and n_docs_most (documents with the rarest and the commonest of its chunks,
    counted by occurrences), first_doc_id (least doc_id with the span's first
    chunk), duplicate (whether each of its bytes stands in a document before
    this one, not always the same: cutting the spans where it is true leaves one
    copy). A span ends where that changes. Where the next chunk isn't repeated, the
    span goes on byte by byte, up to 255 bytes, as far as the first holder of its
    last chunk goes on alike (for the first holder itself: the last one); spans
    that meet by that are one. Later copies go on into chunks first seen here too,
    which keep what is left. A passage that holds no whole chunk isn't found. A document without
    repeats has no rows, nor has a null text; repeats within one document alone
    do not count. Rows with equal doc_id and text are one document, unlike texts
    with one id are two, neither of them before the other. Null ids come last;
    among themselves their texts are ordered by a hash.
    """
    chunks = text_chunks(docs).withColumn("place", F.xxhash64("doc_id", "text_hash"))
    # Summed before the shuffle, so a chunk that a third of all rows hold sends one row per task.
    found = chunks.groupBy("digest").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    repeated = write_and_reread(found.where("low <> high").select("digest", "n", "first", "low"), "repeated")
    # Both sides are dealt by digest; a digest with very many rows is split, as the other side has one.
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.when(F.col("first").isNotNull(), True), F.col("place") != F.col("low"))
    joined = chunks.join(repeated, "digest").select("doc_id", "text_hash", "place", "start", "end", "digest", "n", "first", later.alias("later"))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    same = (F.col("start") == F.lag("end").over(before)) & (F.col("later") == F.lag("later").over(before))
    over = "over (partition by doc_id, text_hash order by start, end)"
    # Up to the next chunk that repeats; a later copy also claims what stands in chunks first seen here.
    front = F.coalesce(F.when(F.col("later"), F.expr(f"lag(if(later, end, null)) ignore nulls {over}")).otherwise(F.lag("end").over(before)), F.lit(0))
    behind = F.when(F.col("later"), F.expr(f"lead(if(later, start, null)) ignore nulls {over}")).otherwise(F.lead("start").over(before))
    marked = joined.distinct().select(
        "*", F.when(same, 0).otherwise(1).alias("opens"), (F.col("start") - front).alias("front"),
        (F.coalesce(behind, F.lit(2**31 - 1)) - F.col("end")).alias("behind"),
    )
    marked = write_and_reread(marked, "marked")
    runs = marked.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.first("place").alias("place"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"),
        F.min("n").alias("n_docs_least"), F.max("n").alias("n_docs_most"),
        F.min_by("first", "start").alias("first_doc_id"), F.first("later").alias("duplicate"),
    )
    reaches = write_and_reread(_reaches(docs, marked), "reaches")
    lefts = reaches.where("left").select("place", "text_hash", F.col("at").alias("start"), F.col("reach").alias("more_left"))
    rights = reaches.where("not left").select("place", "text_hash", F.col("at").alias("end"), F.col("reach").alias("more_right"))
    spans = spans.join(lefts, ["place", "text_hash", "start"], "left").join(rights, ["place", "text_hash", "end"], "left")
    spans = spans.withColumn("start", F.col("start") - F.coalesce("more_left", F.lit(0))).withColumn("end", F.col("end") + F.coalesce("more_right", F.lit(0)))
    # Runs may reach into each other: later copies that meet are one span, first ones keep what no later copy claims.
    over = "over (partition by doc_id, text_hash order by run)"
    spans = spans.withColumn("past", F.expr(f"lag(if(duplicate, end, null)) ignore nulls {over}")).withColumn("next", F.expr(f"lead(if(duplicate, start, null)) ignore nulls {over}"))
    spans = spans.select(
        "*", F.when(F.col("duplicate"), F.col("start")).otherwise(F.greatest("start", "past")).alias("from"),
        F.when(F.col("duplicate"), F.col("end")).otherwise(F.least("end", "next")).alias("to"),
    ).where(F.col("from") < F.col("to"))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("run")
    apart = (F.col("from") > F.lag("to").over(before)) | (F.col("duplicate") != F.lag("duplicate").over(before))
    spans = spans.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
    spans = spans.withColumn("whole", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "text_hash", "whole").agg(
        F.min("from").alias("start"), F.max("to").alias("end"), F.sum("n_chunks").alias("n_chunks"),
        F.min("n_docs_least").alias("n_docs_least"), F.max("n_docs_most").alias("n_docs_most"),
        F.min_by("first_doc_id", "run").alias("first_doc_id"), F.first("duplicate").alias("duplicate"),
    )
    return spans.where(F.col("end") - F.col("start") >= passage).select(
        "doc_id", "start", "end", "n_chunks", "n_docs_least", "n_docs_most", "first_doc_id", "duplicate"
    )
