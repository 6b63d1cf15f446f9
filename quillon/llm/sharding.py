"""Operator 6: sharding through fixed virtual slots.

Records are hashed by id and text into `SLOTS` slots, so that missing or repeated
ids spread too; a slot that repeated rows make too heavy is dealt out over all slots
by a number of the row.  Bytes are summed per slot, and a slot-to-shard map, stored with
a version, places the slots.  Rebalancing edits the map: only the slots that move
change, so only their records move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.frames import cut, hidden, new_path, table, text_bytes

SLOTS = 4096
SHARDS = 24


def text_crc32(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text has none."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def slot_of(doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    """The virtual slot of a record: its id and its text decide."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), text_crc32(text)), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and records of every slot, empty ones too; ``records`` has ``virtual_slot, size``."""
    summed = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(summed, "virtual_slot", "left").na.fill(0, ["bytes", "records"])


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: the heaviest slot left goes to the lightest shard.

    The fold runs over the slots, whose number is fixed, and not over records.
    """
    slots = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", F.col("virtual_slot").alias("slot"), "records")), asc=False).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("picked"))

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(F.transform(acc["loads"], lambda x, i: F.when(i == at, x + slot["bytes"]).otherwise(x)).alias("loads"), F.array_append(acc["picked"], at).alias("picked"))

    placed = slots.select("slots", F.aggregate("slots", start, place, lambda acc: acc["picked"]).alias("shards"))
    rows = placed.select(F.explode(F.arrays_zip("slots", "shards")).alias("one"))
    return rows.select(F.lit(1).alias("version"), F.col("one.slots.slot").alias("virtual_slot"), F.col("one.shards").alias("shard"), F.col("one.slots.bytes").alias("bytes"), F.col("one.slots.records").alias("records"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map with one shard more (`shards` before): slots move into the new shard only.

    Every old shard gives up slots, lightest first, while it stays at or above the new mean.
    """
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / (shards + 1)
    own = Window.partitionBy("shard")
    falling = own.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaves = (F.sum("bytes").over(own) - F.sum("bytes").over(falling) >= F.col("mean")) & (F.col("bytes") > 0)
    return slot_map.withColumn("mean", mean).select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(leaves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "records")


def store(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to a table."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the newest unless one is named."""
    maps = spark.read.parquet(path)
    chosen = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == chosen).select("version", "virtual_slot", "shard", "bytes", "records")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's number in its shard (gapless from 0).

    Numbers come in two levels: records of a virtual slot, and slots of a shard.
    The map has as many rows as there are virtual slots, so it is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("slot_begin"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", *(["row_number_"] if "row_number_" in records.columns else []))
    numbered = records.withColumn("in_slot", F.row_number().over(within) - 1).join(F.broadcast(begins), "virtual_slot")
    return numbered.withColumn("slot", F.col("slot_begin") + F.col("in_slot")).drop("slot_begin", "in_slot")


NEW = ["size", "text_crc32", "virtual_slot", "map_version", "shard", "slot", "next_shard"]


#: A slot with more than so many records, and more than so many times the mean of bytes or records, holds copies of a row; its rows are dealt out.
COPIES, TIMES = 16, 4


def _records(docs: DataFrame, slots: int) -> DataFrame:
    """The records of a written table with their size, checksum, virtual slot and number; no two tables have to agree in the numbers."""
    return docs.withColumns({"size": text_bytes() + 8, "text_crc32": text_crc32(), "virtual_slot": slot_of(slots=slots), "row_number_": F.monotonically_increasing_id()})


def dealt_out(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Records of slots that repeated rows make too heavy go to slots by their number too; `records` is a written table."""
    loads = slot_loads(records, slots)
    means = loads.agg((F.sum("bytes") / slots).alias("bytes_mean"), (F.sum("records") / slots).alias("records_mean"))
    heavy = (F.col("records") > COPIES) & ((F.col("bytes") > TIMES * F.col("bytes_mean")) | (F.col("records") > TIMES * F.col("records_mean")))
    # at most as many rows as there are slots, against one
    full = loads.join(F.broadcast(means)).filter(heavy).select("virtual_slot", F.lit(True).alias("full_"))
    anywhere = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text_crc32", "row_number_"), F.lit(slots)).cast("int")
    return records.join(F.broadcast(full), "virtual_slot", "left").withColumn("virtual_slot", F.when(F.col("full_"), anywhere).otherwise(F.col("virtual_slot"))).drop("full_")


def first_maps(records: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Store version 1 of the map, made from ``virtual_slot, size``, and version 2, grown by one shard; gives version 1 back."""
    spark = records.sparkSession
    store(first_map(slot_loads(records.select("virtual_slot", "size"), slots), shards), path)
    first = stored(spark, path, 1)
    store(grow(first, shards), path)
    return first


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None, version: int = 1) -> DataFrame:
    """Place documents in `shards` shards of nearly equal bytes.

    ``docs`` needs ``doc_id`` and ``text``; all its columns stay, whatever their
    names, but for those named like the new ones, which are replaced: ``size``
    (UTF-8 bytes plus 8), ``text_crc32``, ``virtual_slot``, ``map_version``,
    ``shard``, ``slot``, and ``next_shard``, the shard under the map's next
    version (null if there is none).  The map is read from `path` in the given
    version; without a path, versions 1 and 2 (one shard more) are made from the
    data and stored in the shared folder.

    Null texts count as empty.  Rows without an id, or with one id, are dealt by
    their texts too.  Rows that agree in both share a slot, tie, and are numbered
    one after another; where there are so many that the slot stands out, they are
    dealt over all slots and which of them is where is not defined.  The records are
    written to the shared folder first.  An empty table gives an empty result.
    """
    plain, back = hidden(docs.drop(*NEW), ["doc_id", "text"])
    records = dealt_out(cut(_records(plain, slots)), slots)
    return _placed(records, shards, slots, path, version).select(*back, *NEW)


def _placed(records: DataFrame, shards: int, slots: int, path: str | None, version: int) -> DataFrame:
    """Records with `NEW`, by the map of a path or by one made of them."""
    spark = records.sparkSession
    if path is None:
        path = new_path(spark)
        first_maps(records, path, shards, slots)
    now, later = stored(spark, path, version), stored(spark, path, version + 1)
    numbered = assign(records, now).withColumn("map_version", F.lit(version))
    moved = later.select("virtual_slot", F.col("shard").alias("next_shard"))
    # one row a virtual slot
    return numbered.join(F.broadcast(moved), "virtual_slot", "left")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents into 24 shards of nearly equal bytes, by the stored map; ``next_shard`` is the one of 25."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # sizes and checksums are all that is needed of the texts
    records = dealt_out(cut(_records(docs, SLOTS).drop("text")))
    placed = _placed(records, SHARDS, SLOTS, None, 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")
