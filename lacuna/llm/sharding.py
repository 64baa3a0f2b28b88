"""Shards by fixed virtual slots and a stored, versioned slot map.

Each record hashes into one of thousands of virtual slots. Bytes are summed per
slot, and a map says which shard holds which slot. The map is a small table with
a version; rebalancing edits it and moves as few slots as it can.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lacuna.session import written_path

SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16

MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("virtual_slot", T.IntegerType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("first_slot", T.LongType()),
])


def record_slot(slots: int, *keys: Column) -> Column:
    """Virtual slot of a record: depends on its key columns and the fixed number of slots only."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most one row per slot, summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(free: Column, loads: Column) -> Column:
    """Deals slots, largest first, each to the shard with the least bytes so far.

    ``free`` is an array of (bytes, virtual_slot, rows), ``loads`` has the bytes
    of each shard. One row with as many entries as there are slots, so its size
    is bounded by the fixed number of slots.
    """
    start = F.struct(
        loads.alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint>>").alias("dealt"),
    )

    def step(state, slot):
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        put = F.struct(
            slot["virtual_slot"].alias("virtual_slot"), (to - 1).alias("shard"),
            slot["bytes"].alias("bytes"), slot["rows"].alias("rows"),
        )
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == to - 1, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["dealt"], F.array(put)).alias("dealt"),
        )

    return F.aggregate(free, start, step, lambda state: state["dealt"])


def _numbered(placed: DataFrame, version: int) -> DataFrame:
    """Adds the version and, per slot, the rows of earlier slots in its shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("first_slot"),
    )


def build_map(totals: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """First map: slots dealt to ``shards`` shards, largest first."""
    largest_first = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "virtual_slot", "rows"))))
    dealt = totals.groupBy().agg(largest_first.alias("free")).select(
        F.explode(_dealt(F.col("free"), F.array_repeat(F.lit(0).cast("long"), shards))).alias("put")
    )
    return _numbered(dealt.select("put.*"), version)


def rebalance(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Next version of a map for new totals or another number of shards.

    Each shard keeps its slots, smallest first, while they fit an even share;
    the others, slots new to the map and slots of shards that are gone are dealt
    again, largest first. Slots that have no rows any more leave the map.
    """
    share = totals.groupBy().agg((F.sum("bytes") / shards).alias("share"))
    known = totals.join(current.select("virtual_slot", "shard"), "virtual_slot", "left").withColumn(
        "shard", F.when(F.col("shard") < shards, F.col("shard"))
    )
    so_far = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("shard").isNotNull() & (F.sum("bytes").over(so_far) <= F.col("share"))
    marked = known.join(F.broadcast(share)).select("virtual_slot", "shard", "bytes", "rows", fits.alias("kept"))
    slot = F.struct("bytes", "virtual_slot", "rows")
    per_shard = F.array(*[
        F.coalesce(F.sum(F.when(F.col("kept") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long")
        for s in range(shards)
    ])
    dealt = marked.groupBy().agg(
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("kept"), slot)))).alias("free"), per_shard.alias("loads")
    ).select(F.explode(_dealt(F.col("free"), F.col("loads"))).alias("put")).select("put.*")
    version = current.agg(F.max("version")).first()[0] or 0
    return _numbered(marked.where("kept").select("virtual_slot", "shard", "bytes", "rows").unionByName(dealt), version + 1)


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Appends a version to the stored map and reads that version back."""
    spark = slot_map.sparkSession
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(spark, path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of a stored map, or the latest."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version))


def assign(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot`` to records with a ``virtual_slot``.

    ``slot`` counts a shard's rows from 0 without gaps. Rows are numbered within
    their virtual slot, so no task sorts more than one slot, and the rows of a
    shard's earlier slots are added from the map. The map has at most one row
    per virtual slot and is broadcast.
    """
    places = F.broadcast(slot_map.select("virtual_slot", "shard", "first_slot"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return records.withColumn("_within", within).join(places, "virtual_slot").withColumn(
        "slot", (F.col("first_slot") + F.col("_within") - 1).cast("long")
    ).drop("_within", "first_slot")


def _records(docs: DataFrame, slots: int, *columns: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        *columns, (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        record_slot(slots, F.col("doc_id"), F.xxhash64(text)).alias("virtual_slot"),
    )


def shard_records(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shards of near equal bytes for a table with ``doc_id`` and ``text``.

    Returns doc_id, text_crc32, size, virtual_slot, shard, slot. The size is the
    UTF-8 bytes of the text (none for null) plus ``OVERHEAD``; the checksum of a
    null text is null. Repeated rows are records of their own; an empty table
    gives an empty result. Copies of one text spread over slots, as the id is
    hashed too. Without ``map_path`` the map is stored in the shared folder.
    """
    records = _records(docs, slots, F.col("doc_id"), F.crc32(F.col("text").cast("string")).alias("text_crc32"))
    return assign(records, fitted_map(docs, shards, slots, map_path), ["doc_id", "text_crc32", "size"])


def fitted_map(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Builds and stores the first version of the map for ``docs``."""
    totals = slot_totals(_records(docs, slots))
    return store_map(build_map(totals, shards), map_path or written_path(docs.sparkSession, "slot-map"))


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard`` added (or replaced); no row is shuffled."""
    slot_map = fitted_map(docs, shards, slots, map_path).select("virtual_slot", "shard")
    kept = [c for c in docs.columns if c not in ("virtual_slot", "shard")]
    slot = record_slot(slots, F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))
    placed = docs.select(*[F.col(f"`{c}`") for c in kept], slot.alias("virtual_slot"))
    return placed.join(F.broadcast(slot_map), "virtual_slot").select(*[F.col(f"`{c}`") for c in kept], "virtual_slot", "shard")
