"""Passages that occur before, by longest-previous-factor arrays.

A window is a string of ``PASSAGE`` bytes that starts somewhere in a text. The
longest previous factor of a window is the longest beginning that it shares with
a window earlier in the corpus (by the least doc_id of the text, then by place).
In suffix order the two candidates for it are the previous and the next window
with an earlier place. Where the factor is the whole window, the window is a
later copy; a window that has a later copy and no earlier one is a first copy.

No single suffix array could hold the corpus, so windows are dealt to many. A
window's key is the least hash of the ``GRAM``-byte strings in it. Equal windows
have equal keys, and neighbouring windows mostly share theirs, so a text falls
into runs of windows with one key (winnowing). Keys that stand in one place only
are dropped on narrow rows. The texts of the other runs go to buckets of keys,
where a suffix array over all windows of the bucket is sorted. Copies of whole
texts are one text that is counted.

A key with very many or very long runs would overfill a bucket. Its windows are
matched by digest instead: equal windows are summed before the shuffle, so no
task gets all of them, and the earliest place of each is kept.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .shingles import mix, text_bytes

PASSAGE = 200
#: Bytes per hashed string; every window of a passage holds PASSAGE - GRAM + 1 of them.
GRAM = 50
#: Bytes of text handled at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Most windows in a run; longer ones are cut.
RUN = 1 << 13
#: Runs and windows that a key may have in a bucket, and windows that a bucket should hold.
KEY_RUNS, KEY_WINDOWS, BUCKET_WINDOWS = 4096, 1 << 19, 1 << 17

_BASE = 0x9E3779B97F4A7C15
_RUNS = "runs array<struct<key: bigint, start: int, stop: int, again: boolean>>"


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


_POWERS, _INVERSE = _powers(2 * PIECE, _BASE), _powers(2 * PIECE, pow(_BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each byte on."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)])])
    return mix((sums[gram:] - sums[:-gram]) * _INVERSE[: len(data) - gram + 1])


def _sliding(values: np.ndarray, size: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``size`` values in a row."""
    reach = 1
    while 2 * reach <= size:
        values, reach = of(values[:-reach], values[reach:]), 2 * reach
    rest = size - reach
    return of(values[:-rest], values[rest:]) if rest else values


def window_runs(data: np.ndarray, offsets: np.ndarray, least: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(owner, key, start, stop, again) of the runs of windows with one key, in order.

    ``offsets`` are the bounds of the texts in ``data``; starts count from the
    text's own. ``again`` says that the text holds the key's string twice or more.
    """
    sizes = np.diff(offsets)
    windows = len(data) - least + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, bool))
    hashes = gram_hashes(data, gram)
    keys = _sliding(hashes, least - gram + 1, np.minimum)
    # Windows that lie within one text.
    edges = np.zeros(windows + 1, np.int32)
    long = sizes >= least
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, offsets[1:][long] - least + 1, -1)
    inside = np.cumsum(edges[:-1]) > 0
    changes = np.ones(windows + 1, bool)
    changes[1:-1] = (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(changes[:-1])
    stops = np.append(starts[1:], windows)
    own = inside[starts]
    starts, stops = starts[own], stops[own]
    pieces = -(-(stops - starts) // RUN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole_stops = np.repeat(stops, pieces)
    starts = np.repeat(starts, pieces) + nth * RUN
    stops = np.minimum(starts + RUN, whole_stops)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # Strings that are some window's least: each is a place of that window's key.
    around = np.zeros(least - gram, np.uint64)
    highest = _sliding(np.concatenate([around, np.where(inside, keys, 0), around]), least - gram + 1, np.maximum)
    places = np.flatnonzero((hashes == highest) & (highest > 0))
    marks = hashes[places] ^ mix(np.searchsorted(offsets, places, side="right").astype(np.uint64))
    found, times = np.unique(marks, return_counts=True)
    own_marks = keys[starts] ^ mix((owner + 1).astype(np.uint64))
    at = np.searchsorted(found, own_marks).clip(0, max(len(found) - 1, 0))
    return owner, keys[starts], starts - offsets[owner], stops - offsets[owner], times[at] > 1


def _pieces(texts: pa.Array, least: int) -> Iterator[tuple[int, int, int]]:
    """(first text, end, byte within the text) of what is handled at once: some whole texts, or a piece of one."""
    sizes = np.diff(text_bytes(texts)[1])
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > PIECE:
            yield low, i, 0
            low, held = i, 0
        held += size
        if size > PIECE:
            for begin in range(0, size, PIECE):
                if not begin or size - begin >= least:
                    yield i, i + 1, begin
            low, held = i + 1, 0
    if low < len(sizes):
        yield low, len(sizes), 0


def _sketches(least: int, gram: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = np.diff(text_bytes(texts)[1])
            parts = []
            for low, high, begin in _pieces(texts, least):
                data, offsets = text_bytes(texts.slice(low, high - low))
                if len(data) > PIECE and high == low + 1:
                    data = data[begin:begin + PIECE + least - 1]
                    offsets = np.array([0, len(data)])
                owner, key, start, stop, again = window_runs(data, offsets, least, gram)
                parts.append((owner + low, key, start + begin, stop + begin, again))
            owner, key, start, stop, again = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            # A piece of a long text doesn't know the others: there a key of several runs counts as again.
            long = np.flatnonzero(sizes[owner] > PIECE)
            _, at, times = np.unique(key[long].astype(np.uint64) ^ mix(owner[long].astype(np.uint64)), return_inverse=True, return_counts=True)
            again[long] |= times[at] > 1
            entries = pa.StructArray.from_arrays(
                [pa.array(key.astype(np.uint64).view(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(again.astype(bool))],
                ["key", "start", "stop", "again"],
            )
            bounds = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), entries)],
                ["doc_id", "digest", "n_bytes", "runs"],
            )

    return sketch


def longest_previous_factors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, repeated) of each row of ``windows``, equally long byte strings in corpus order.

    ``factor`` is the length of the longest beginning shared with an earlier
    row; ``repeated`` says whether any other row is equal.
    """
    n, width = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width}").ravel(), kind="stable")
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    # Common beginnings of neighbours in suffix order, eight bytes at a time.
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = windows[order]
    words = padded.view("<u8")
    different = words[1:] != words[:-1]
    first = different.argmax(axis=1)
    unequal = different.any(axis=1)
    bits = words[1:][np.arange(n - 1), first] ^ words[:-1][np.arange(n - 1), first]
    lowest = np.log2((bits & (~bits + np.uint64(1))).astype(np.float64), where=unequal, out=np.zeros(n - 1))
    common = np.where(unequal, 8 * first + lowest.astype(np.int64) // 8, width)
    repeated = np.zeros(n, bool)
    repeated[order[1:]] |= ~unequal
    repeated[order[:-1]] |= ~unequal
    # The stack holds places that rise; below each entry stands its previous smaller place,
    # and the place that removes it is its next smaller one.
    factor = [0] * n
    places, shared = [], []
    for place, with_last in zip(order.tolist() + [-1], [0, *common.tolist(), 0]):
        while places and place < places[-1]:
            below = shared.pop()
            factor[places.pop()] = max(below, with_last)
            with_last = min(below, with_last)
        places.append(place)
        shared.append(with_last)
    return np.array(factor, np.int64), repeated


def _segments(batches: Iterator[pa.RecordBatch], least: int, heavy: bool) -> Iterator[tuple]:
    """(batch, text's place in it, key, start, bytes) of the runs that are heavy, or of the others."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        runs = batch.column("runs")
        entries = runs.flatten()
        owner = np.repeat(np.arange(len(batch)), runs.value_lengths().to_numpy())
        chosen = np.flatnonzero(entries.field("heavy").to_numpy(zero_copy_only=False) == heavy)
        key, start, stop = (entries.field(c).to_numpy()[chosen] for c in ("key", "start", "stop"))
        begin = offsets[owner[chosen]] + start
        yield batch, owner[chosen], key, start, [raw[a:b] for a, b in zip(begin.tolist(), (begin + (stop - start) + least - 1).tolist())]


def _bucketed(least: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, owner, key, start, parts in _segments(batches, least, False):
            bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), batch.column("first").take(at), batch.column("row").take(at), pa.array(start), pa.array(parts, pa.binary())],
                ["bucket", "first", "row", "start", "bytes"],
            )

    return deal


def _state_runs(state: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, state) of the stretches of one state other than 0; none crosses a bound."""
    changes = np.zeros(len(state) + 1, bool)
    changes[bounds] = True
    changes[-1] = True
    changes[1:-1] |= state[1:] != state[:-1]
    begin = np.flatnonzero(changes[:-1])
    end = np.append(begin[1:], len(state))
    own = state[begin] > 0
    return begin[own], end[own], state[begin[own]]


def _matched(least: int):
    """Function for ``applyInArrow``: (row, start, stop, later) of the repeated windows of a bucket."""

    def match(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("first", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_end")
        group = group.select(["row", "start", "bytes"]).take(order)
        rows, starts = group.column("row").to_numpy(), group.column("start").to_numpy().astype(np.int64)
        # Equal stretches are searched once, as the first of them.
        coded = group.column("bytes").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        times = np.bincount(codes)
        heads = np.unique(codes, return_index=True)[1]
        data = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint8)
        lengths = np.array([len(b) for b in coded.dictionary.to_pylist()])
        windows = lengths - least + 1
        bounds = np.cumsum(windows) - windows
        at = np.arange(windows.sum()) + np.repeat(np.cumsum(lengths) - lengths - bounds, windows)
        factor, repeated = longest_previous_factors(np.lib.stride_tricks.sliding_window_view(data, least)[at])
        state = np.where(factor >= least, 2, np.where(repeated | np.repeat(times > 1, windows), 1, 0))
        begin, end, kind = _state_runs(state, bounds)
        segment = np.searchsorted(bounds, begin, side="right") - 1
        shift = starts[heads[segment]] - bounds[segment]
        others = np.ones(len(codes), bool)
        others[heads] = False
        row = np.concatenate([rows[heads[segment]], rows[others]])
        start = np.concatenate([begin + shift, starts[others]])
        stop = np.concatenate([end + shift, (starts + windows[codes])[others]])
        later = np.concatenate([kind == 2, np.ones(others.sum(), bool)])
        return pa.table({"row": row, "start": start, "stop": stop, "later": later})

    return match


def _heavy(least: int):
    """Function for ``mapInArrow``: heavy runs with their bytes and the digest of these."""

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, owner, _, start, parts in _segments(batches, least, True):
            at = pa.array(owner)
            stop = start + np.array([len(p) for p in parts], np.int64) - least + 1
            digests = [hashlib.blake2b(part, digest_size=16).digest() for part in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("first").take(at), batch.column("row").take(at), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(parts, pa.binary())],
                ["first", "row", "start", "stop", "digest", "bytes"],
            )

    return stretch


def _digested(least: int):
    """Function for ``mapInArrow``: a row per different window of each stretch, and the parts that repeat within it."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (begin, part) in enumerate(zip(batch.column("start").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
                digests = [hashlib.blake2b(part[j:j + least], digest_size=16).digest() for j in range(len(part) - least + 1)]
                coded = pa.array(digests, pa.binary()).dictionary_encode()
                codes = coded.indices.to_numpy()
                heads = np.unique(codes, return_index=True)[1]
                again = np.ones(len(codes), np.int64)
                again[heads] = 0
                low, high, _ = _state_runs(again, np.zeros(1, np.int64))
                at = pa.array(np.full(len(heads) + len(low), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("first").take(at), batch.column("row").take(at), pa.array(np.concatenate([heads, low]) + begin), pa.array(np.concatenate([heads + 1, high]) + begin),
                        pa.array([*coded.dictionary.to_pylist(), *[None] * len(low)], pa.binary()), pa.array(np.concatenate([np.bincount(codes) > 1, np.ones(len(low), bool)])),
                    ],
                    ["first", "row", "start", "stop", "digest", "again"],
                )

    return digest


def _by_digest(affected: DataFrame, kind: str, least: int) -> DataFrame:
    """(row, start, stop, later) of the repeated windows of heavy runs.

    Equal runs are one, and of a run only the first of equal windows is looked up.
    """
    place = F.struct(F.col("first").isNull().alias("null"), "first", "row", "start")
    earliest = F.min(place).alias("least")

    def summed(rows, *more):
        # Before the shuffle: what every text holds sends one row per task.
        found = rows.groupBy("digest").agg(F.count("*").alias("n"), earliest, *more)
        return found.withColumnsRenamed({"digest": "_digest"}).withColumns({"_row": F.col("least.row"), "_start": F.col("least.start")}).drop("least")

    same, later = F.col("digest") == F.col("_digest"), (F.col("row") != F.col("_row")) | (F.col("start") != F.col("_start"))
    rows = affected.where(F.exists("runs", lambda r: r["heavy"])).select("row", "first", "text", "runs")
    runs = write_and_reread(rows.mapInArrow(_heavy(least), f"first {kind}, row bigint, start bigint, stop bigint, digest binary, bytes binary"), "heavy")
    different = write_and_reread(summed(runs), "heavy-runs")
    whole = runs.join(different.where("n > 1"), same).select("row", "start", "stop", later.alias("later"))
    heads = runs.join(different, same & (F.col("row") == F.col("_row")) & (F.col("start") == F.col("_start"))).select("first", "row", "start", "bytes")
    windows = write_and_reread(heads.mapInArrow(_digested(least), f"first {kind}, row bigint, start bigint, stop bigint, digest binary, again boolean"), "heavy-windows")
    within = windows.where("digest IS NULL").select("row", "start", "stop", F.lit(True).alias("later"))
    looked_up = windows.where("digest IS NOT NULL")
    shared = write_and_reread(summed(looked_up, F.max("again").alias("twice")).where("n > 1 OR twice"), "shared-windows")
    met = looked_up.join(shared, same).select("row", "start", "stop", later.alias("later"))
    return whole.unionByName(met).unionByName(within)


def _cut(least: int, keep_first: bool):
    """Function for ``mapInArrow``: what is left of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out = []
            for i in range(len(batch)):
                text = data[offsets[i]:offsets[i + 1]]
                found = batch.column("found")[i].values
                start, stop = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
                if keep_first:
                    later = found.field("later").to_numpy(zero_copy_only=False)
                    start, stop = start[later], stop[later]
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, stop + least - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                low, high, _ = _state_runs(gone.astype(np.int64), np.zeros(1, np.int64))
                left = hashlib.sha256(text[~gone].tobytes()).hexdigest()
                out.append((int(gone.sum()), len(low), left, [{"start": a, "stop": b} for a, b in zip(low.tolist(), high.tolist())]))
            removed, spans, left, where = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["row", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return cut


def _sketched(docs: DataFrame, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Runs of every row of ``docs`` (doc_id, text), and (digest, n, first, row, times, n_bytes) of every different text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = docs.mapInArrow(_sketches(least, gram), f"doc_id {kind}, digest binary, n_bytes bigint, {_RUNS}")
    sketch = write_and_reread(sketch.withColumn("row", F.monotonically_increasing_id()), "sketches")
    # Copies are summed before the shuffle; the text's place in the corpus is that of its least id.
    rows = sketch.groupBy("digest", "doc_id").agg(F.count("*").alias("times"), F.min("row").alias("row"), F.max("n_bytes").alias("n_bytes"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "times"))
    copies = rows.groupBy("digest").agg(F.sum("times").alias("n"), first.alias("least"), F.max("n_bytes").alias("n_bytes"))
    return sketch, write_and_reread(copies.select("digest", "n", F.col("least.doc_id").alias("first"), "least.row", "least.times", "n_bytes"), "copies")


def _affected(docs: DataFrame, sketch: DataFrame, copies: DataFrame) -> tuple[DataFrame, int]:
    """(row, first, text, runs) of the texts that hold a key twice or share one, with those runs; and their number of windows."""
    text = F.xxhash64("digest")
    placed = sketch.select("row", text.alias("t"), F.explode("runs").alias("run")).select("row", "t", "run.*")
    keys = placed.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("again").alias("again"))
    keys = write_and_reread(keys.where("low <> high OR again").select("key"), "keys")
    # Both semi joins are on narrow rows; a key of very many rows is split, as the other side has one.
    found = placed.join(keys, "key", "left_semi").join(copies.select("row"), "row", "left_semi")
    found = write_and_reread(found.select("row", "key", "start", "stop"), "found")
    loads = found.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("windows"))
    heavy = write_and_reread(loads.where((F.col("n") > KEY_RUNS) | (F.col("windows") > KEY_WINDOWS)).select(F.col("key").alias("_key")), "heavy-keys")
    marked = found.join(heavy, F.col("key") == F.col("_key"), "left").withColumn("heavy", F.col("_key").isNotNull())
    listed = marked.groupBy("row").agg(F.collect_list(F.struct("key", "start", "stop", "heavy")).alias("runs"))
    wanted = listed.withColumnRenamed("row", "_row").join(copies, F.col("row") == F.col("_row")).select(
        "row", F.col("digest").alias("_digest"), "first", "times", "runs"
    )
    # One shuffle of texts; the narrow side grows with them, so it is dealt and hashed.
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("first"))
    fetched = docs.join(wanted.hint("shuffle_hash"), same).select("row", "first", "text", "runs")
    if not copies.where("times > 1").isEmpty():
        fetched = fetched.dropDuplicates(["row"])
    windows = found.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    return write_and_reread(fetched, "affected"), windows


def repeated_bytes(docs: DataFrame, least: int = PASSAGE, keep_first: bool = True, gram: int = GRAM) -> DataFrame:
    """What of each text of ``docs`` (doc_id, text) repeats: a row per row.

    A byte goes if a ``least``-byte string that covers it also starts at an
    earlier place of the corpus, or, with ``keep_first`` false, at any other
    place. Texts are judged as they come, byte by byte of their UTF-8 form;
    strings don't cross texts. Returns doc_id, digest (SHA-256 of the text),
    n_bytes, n_removed, n_spans, spans (start, stop) and kept_sha256 (lowercase
    hex, of the bytes that stay).

    Places are ordered by doc_id, null ids last. A null text is empty. Texts
    shorter than ``least`` lose nothing. Of rows with equal id and text each is
    a first copy or none is. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    sketch, copies = _sketched(docs, least, gram)
    affected, windows = _affected(docs, sketch, copies)
    buckets = -(-windows // BUCKET_WINDOWS) or 1
    dealt = affected.mapInArrow(_bucketed(least, buckets), f"bucket bigint, first {kind}, row bigint, start int, bytes binary")
    matched = dealt.groupBy("bucket").applyInArrow(_matched(least), "row bigint, start bigint, stop bigint, later boolean")
    repeats = matched.unionByName(_by_digest(affected, kind, least))
    found = repeats.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "stop", "later")).alias("found"))
    cut = affected.join(found.hint("shuffle_hash"), F.col("row") == F.col("_row")).select("row", "text", "found").mapInArrow(
        _cut(least, keep_first), "row bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>"
    )
    cut = write_and_reread(cut, "cut")
    decided = copies.join(cut.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    decided = decided.where((F.col("n") > 1) | F.col("n_removed").isNotNull()).select(F.col("digest").alias("_digest"), "n", "first", "n_removed", "n_spans", "kept_sha256", "spans")
    rows = sketch.select("doc_id", "digest", "n_bytes").join(decided, F.col("digest") == F.col("_digest"), "left")
    # A copy of a whole text goes whole.
    copied = F.coalesce(F.col("n") > 1, F.lit(False)) & (F.col("n_bytes") >= least)
    if keep_first:
        copied = copied & ~F.col("doc_id").eqNullSafe(F.col("first"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))
    nothing = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return rows.select(
        "doc_id", "digest", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, least: int = PASSAGE, keep_first: bool = True) -> DataFrame:
    """``docs`` with all columns, and with the repeated bytes cut out of text.

    Characters that a cut goes through are replaced by U+FFFD. Rows stay, also
    those whose text is empty then.
    """
    found = repeated_bytes(docs, least, keep_first).where("n_removed > 0").select("doc_id", "digest", "n_bytes", "spans").dropDuplicates(["doc_id", "digest"])
    # Whole rows travel in a struct, so no column of theirs can clash.
    read = docs.select(F.struct("*").alias("doc"), F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256)).alias("text_digest"))
    same = (F.col("text_digest") == F.col("digest")) & F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.stop"))
    stops = F.concat(F.col("spans.start"), F.array("n_bytes"))
    raw = F.col("doc.text").cast("string").cast("binary")
    kept = F.aggregate(
        F.arrays_zip(starts.alias("start"), stops.alias("stop")), F.lit(b""),
        lambda left, part: F.concat(left, F.substring(raw, (part["start"] + 1).cast("int"), (part["stop"] - part["start"]).cast("int"))),
    )
    text = F.when(F.col("spans").isNull(), F.col("doc.text").cast("string")).otherwise(F.make_valid_utf8(kept.cast("string")))
    joined = read.join(found.hint("shuffle_hash"), same, "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
