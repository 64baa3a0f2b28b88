"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its sequence of occurrence-labelled five-word shingles. Per band, the
``PICKED`` least shingles under the band's hash are kept in text order and hashed
into one key, so texts with equal shingles in another order get other keys.
Texts that share a key are candidates.

The similarity of two texts is L / (n + m - L), where L is the length of the
longest common subsequence of their shingles: the Jaccard similarity of shingles
that stand in the same order. Candidates are compared in groups of bounded size.
Within a group, shared shingles are counted first (they bound L from above), and
pairs that can reach the threshold are aligned within the band of diagonals that
the threshold leaves, unless their texts are linked already.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import write_and_reread

from .components import connected_components
from .shingles import mix, shingle_hashes, text_bytes, word_hashes
from .text import unused

THRESHOLD = 0.8
#: Texts at the threshold share a key with probability 0.41 a band, so 3 in a million are missed.
BANDS = 24
PICKED = 4
#: Texts and bytes of text that are compared in one task at once; larger groups are cut into tiles.
GROUP_TEXTS = 768
GROUP_BYTES = 16_000_000
_CHUNK = 1 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_keys(shingles: np.ndarray, numbers: np.ndarray, bands: int = BANDS, picked: int = PICKED) -> np.ndarray:
    """(texts, bands) keys; texts without shingles get zeros."""
    keys = np.zeros((len(numbers), bands), np.uint64)
    some = np.flatnonzero(numbers)
    sizes = numbers[some]
    starts = np.cumsum(sizes) - sizes
    for band in range(bands):
        values = mix(shingles ^ mix(np.array([band + 1], np.uint64)))
        chosen = []
        for _ in range(picked):
            least = np.minimum.reduceat(values, starts)
            at = np.flatnonzero(values == np.repeat(least, sizes))
            # Labelled shingles are distinct; of exhausted short texts the first entry stands for none.
            owner = np.searchsorted(starts, at, side="right") - 1
            first = np.ones(len(at), bool)
            first[1:] = owner[1:] != owner[:-1]
            at = at[first]
            chosen.append(np.where(values[at] == _MOST, len(shingles), at))
            values[at] = _MOST
        places = np.sort(np.stack(chosen, axis=1), axis=1)
        padded = np.concatenate([shingles, np.zeros(1, np.uint64)])
        key = np.full(len(some), band, np.uint64)
        for j in range(picked):
            key = mix(key * np.uint64(31) + padded[places[:, j]])
        keys[some, band] = key
    return keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, nodes = batch.column("text"), batch.column("doc_id"), batch.column("node")
        sizes = np.diff(text_bytes(texts)[1])
        # About a megabyte of text at once, whole texts.
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _CHUNK, prepend=0))
        for begin, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if begin == end:
                continue
            shingles, numbers = shingle_hashes(*word_hashes(*text_bytes(texts.slice(begin, end - begin))))
            keys = band_keys(shingles, numbers).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(numbers > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(begin, end - begin), nodes.slice(begin, end - begin), pa.array(sizes[begin:end]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[numbers > 0].ravel())),
                ],
                ["doc_id", "node", "bytes", "keys"],
            )


def common_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` diagonals of the main one."""
    ahead = 0
    while ahead < min(len(a), len(b)) and a[ahead] == b[ahead]:
        ahead += 1
    a, b = a[ahead:], b[ahead:]
    behind = 0
    while behind < min(len(a), len(b)) and a[len(a) - 1 - behind] == b[len(b) - 1 - behind]:
        behind += 1
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    if not len(a) or not len(b):
        return ahead + behind
    # Row i holds columns i - band to i + band; a column outside b never matches.
    width = 2 * band + 1
    wide = np.concatenate([np.zeros(band, b.dtype), b, np.zeros(max(0, len(a) + band - len(b)), b.dtype)])
    there = np.zeros(len(wide), bool)
    there[band:band + len(b)] = True
    row = np.zeros(width + 1, np.int32)
    for i in range(len(a)):
        match = (wide[i:i + width] == a[i]) & there[i:i + width]
        row[:width] = np.maximum.accumulate(np.maximum(row[:width] + match, row[1:]))
    return ahead + behind + int(row.max())


def aligned(a: np.ndarray, b: np.ndarray, shared: int, threshold: float = THRESHOLD) -> bool:
    """Whether two shingle sequences with ``shared`` common shingles are similar in order."""
    need = threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9
    if shared < need:
        return False
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b, a, sorter=order).clip(0, len(b) - 1)
    places = order[at][b[order[at]] == a]
    if len(places) < 2 or (np.diff(places) > 0).all():
        return True  # All shared shingles stand in the same order: the alignment is complete.
    # Fewer than n + m - 2 * need steps leave the main diagonal.
    return common_order(a, b, int(len(a) + len(b) - 2 * need) + 1) >= need


def _shared_counts(sequences: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Matrix of the numbers of shared shingles, from blocks of a text-by-shingle table."""
    owner = np.repeat(np.arange(len(sequences), dtype=np.int64), [len(s) for s in sequences])
    values, code, times = np.unique(np.concatenate(sequences), return_inverse=True, return_counts=True)
    several = times[code] > 1
    rank = np.cumsum(times > 1) - 1
    owner, code = owner[several], rank[code[several]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    counts = np.zeros((len(sequences), len(sequences)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        part = slice(np.searchsorted(code, low), np.searchsorted(code, low + columns))
        table = np.zeros((len(sequences), columns), np.float32)
        table[owner[part], code[part] - low] = 1
        counts += table @ table.T
    return counts


def similar_links(sequences: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links between similar sequences that join the same sequences as all links would."""
    sizes = np.array([len(s) for s in sequences])
    shared = _shared_counts(sequences)
    possible = np.triu(shared >= threshold * (sizes[:, None] + sizes) / (1 + threshold) - 1e-6, 1)
    left, right = np.nonzero(possible & (sizes[:, None] > 0) & (sizes > 0))
    best = np.argsort(-shared[left, right] / (sizes[left] + sizes[right]), kind="stable")
    root = np.arange(len(sequences))
    links = []
    for i, j in zip(left[best], right[best], strict=True):
        if root[i] != root[j] and aligned(sequences[i], sequences[j], int(shared[i, j]), threshold):
            links.append((int(i), int(j)))
            root[root == root[j]] = root[i]
    return links


def _compared(group: pa.Table) -> pa.Table:
    nodes = group.column("node").to_pylist()
    kept = list({node: i for i, node in enumerate(nodes)}.values())
    group = group.take(pa.array(kept, pa.int64()))
    nodes = group.column("node").to_pylist()
    shingles, numbers = shingle_hashes(*word_hashes(*text_bytes(group.column("text").combine_chunks())))
    sequences = np.split(shingles, np.cumsum(numbers)[:-1])
    links = similar_links(sequences)
    return pa.table({
        "a": pa.array([nodes[i] for i, _ in links], pa.binary()), "b": pa.array([nodes[j] for _, j in links], pa.binary())
    })


def _units(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(unit, i, j, node, doc_id): groups to compare, each of bounded size.

    ``members`` has (key, node), one row per text and shared key, ``texts``
    (node, doc_id, bytes), one row per text.
    Texts joined by shared keys, directly or not, form one group if it is small,
    so that each is read once. Texts of a larger group are compared by key, in
    tiles: every two texts with a common key meet in some pair of tiles.
    """
    centre = members.groupBy("key").agg(F.min("node").alias("b"))
    linked = connected_components(members.join(write_and_reread(centre, "centres"), "key").select(F.col("node").alias("a"), "b"))
    grouped = write_and_reread(texts.select("node", "doc_id", "bytes").join(linked, "node"), "grouped")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("texts"), F.sum("bytes").alias("all"))
    small = (F.col("texts") <= GROUP_TEXTS) & (F.col("all") <= GROUP_BYTES)
    sizes = write_and_reread(sizes.withColumn("small", small), "sizes")
    marked = write_and_reread(grouped.join(sizes.select("root", "small"), "root"), "marked")
    whole = marked.where("small").select(
        F.col("root").alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "doc_id"
    )
    large = members.join(marked.where("NOT small").select("node", "doc_id", "bytes"), "node")
    per_key = large.groupBy("key").agg(F.count("*").alias("texts"), F.sum("bytes").alias("all"))
    half = F.greatest(F.ceil(F.col("texts") * 2 / GROUP_TEXTS), F.ceil(F.col("all") * 2 / GROUP_BYTES))
    tiles = write_and_reread(per_key.select("key", F.when((F.col("texts") <= GROUP_TEXTS) & (F.col("all") <= GROUP_BYTES), 1).otherwise(half).cast("int").alias("tiles")), "tiles")
    placed = large.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    paired = placed.select("key", "node", "doc_id", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        F.encode(F.col("key").cast("string"), "UTF-8").alias("unit"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "doc_id"
    )
    return whole.unionByName(paired)


def _hashed(narrow: DataFrame) -> DataFrame:
    """The narrow side of a join with texts: it grows with them, so it is dealt and hashed, not broadcast; texts aren't sorted."""
    return narrow.hint("shuffle_hash")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, node (md5 of the text), root and class_id of every row of ``docs`` (doc_id, text).

    The class of a text holds all texts reachable by links. Its root is one of
    them and tells classes apart; its id is the least doc_id of their rows, which
    two classes may share if unlike texts have one id, or none. Equal texts share a class. Texts without words link
    with equal texts only; a row with a null text is a class of its own, whose
    id is its doc_id. Repeated rows stay repeated; null ids count as no id.
    """
    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    sketches = write_and_reread(
        read.where("node IS NOT NULL").mapInArrow(_sketches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, bytes long, keys array<bigint>"), "sketches"
    )
    # One row per different text: copies have equal keys and are summed before the shuffle.
    texts = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys"))
    texts = write_and_reread(texts, "texts")
    keyed = texts.select(F.explode("keys").alias("key"), "node")
    shared = write_and_reread(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members = write_and_reread(keyed.join(shared, "key", "left_semi"), "members")
    units = write_and_reread(_units(members, texts), "units")
    # A row per text stands for its copies; the id spreads copies of one text over tasks.
    wanted = units.withColumnsRenamed({"node": "_node", "doc_id": "_id"})
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    fetched = read.join(_hashed(wanted), same).select("unit", "i", "j", "node", "text")
    links = fetched.groupBy("unit", "i", "j").applyInArrow(_compared, "a binary, b binary")
    linked = connected_components(links)
    classed = texts.select("node", "doc_id").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = write_and_reread(classed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    classes = write_and_reread(classed.join(least, "root").select(F.col("node").alias("_node"), "root", "class_id"), "classes")
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("node"))
    return rows.join(classes, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, that of its least doc_id, with all columns; rows with a null text stay.

    A null id comes after all others. Of several texts with the least id the one
    with the least digest stays, of rows equal in doc_id and text any one.
    """
    text = F.col("text").cast("string")
    found = near_duplicate_classes(docs.select("doc_id", "text")).where("node IS NOT NULL")
    # Copies are summed before the shuffle; a class then has a row per different id and text.
    counted = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node", "times"))
    own_id, node, times = unused(docs, "_id", "_node", "_times")
    kept = counted.groupBy("root").agg(first.alias("first")).select(
        F.col("first.doc_id").alias(own_id), F.col("first.node").alias(node), F.col("first.times").alias(times)
    )
    kept = write_and_reread(kept, "kept")
    same = (F.unhex(F.md5(text)) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(own_id))
    several = F.col(times) > 1
    rows = docs.join(_hashed(kept.where(~several)), same, "left_semi")
    if not kept.where(several).isEmpty():
        rows = rows.unionByName(docs.join(_hashed(kept.where(several)), same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return rows.unionByName(docs.where(text.isNull()))
