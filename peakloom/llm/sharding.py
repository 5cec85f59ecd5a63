"""Fixed virtual slots: records hash into thousands of slots; a small versioned map sends slots to shards.

Only the map is edited when shards are added or loads drift, so a rebalance
moves whole slots and no record is hashed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path
from .common import written

#: Virtual slots; a property of the data set that never changes. The map has exactly so many rows.
SLOTS = 4096


def slot_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """One narrow row per record: id, size (UTF-8 bytes of the text plus 1), CRC-32 and virtual slot.

    Null text: size 1, null checksum. Null and repeated ids are records like any
    other; the checksum is hashed along so that they spread unless wholly equal.
    """
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_loads(records: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each of the n_slots slots, empty ones included."""
    slots = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    loads = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return slots.join(F.broadcast(loads), "vslot", "left").na.fill(0, ["bytes", "rows"])


def build_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Slot-to-shard map: heaviest slot first, each to the shard with the fewest bytes so far.

    The fold runs over one array of n_slots entries, a size fixed by parameter.
    Ties go to the lower shard; equal loads to the higher slot number first.
    """
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("picks"),
    )

    def place(acc, slot):
        at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == at, v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.concat(acc["picks"], F.array(at)).alias("picks"),
        )

    ordered = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", "vslot", "rows")), asc=False).alias("slots"))
    placed = ordered.select("slots", F.aggregate("slots", start, place)["picks"].alias("picks"))
    return placed.select(F.inline(F.arrays_zip("slots", "picks"))).select(
        F.lit(version).alias("version"), "slots.vslot", "slots.bytes", "slots.rows", F.col("picks").alias("shard")
    )


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for shards + 1 shards: each old shard hands slots over until its share is left.

    Slots move only into the new shard; within a shard the lowest slots stay.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards + 1)
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "vslot", "bytes", "rows",
        F.when(kept <= share, F.col("shard")).otherwise(F.lit(shards)).cast("int").alias("shard"),
    )


def rebalance_map(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version for the same shards under new loads: shards above their share hand slots over, heaviest first, to the shard with the fewest bytes.

    Within a shard the lowest slots stay up to the share. Slots of shards at or
    below it don't move; without drift none does, but for what the share cuts.
    """
    loaded = slot_map.select("version", "vslot", "shard").join(F.broadcast(loads), "vslot")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    over = F.sum("bytes").over(Window.partitionBy("shard")) > share
    marked = loaded.withColumn("moves", over & (kept > share))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("picks"))

    def place(acc, slot):
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        at = F.when(slot["moves"], least).otherwise(slot["shard"])
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == at, v + slot["bytes"]).otherwise(v)).alias("loads"), F.concat(acc["picks"], F.array(at)).alias("picks")
        )

    key = F.struct("moves", (-F.col("bytes")).alias("lighter"), "vslot", "shard", "bytes", "rows", "version")
    ordered = marked.agg(F.array_sort(F.collect_list(key)).alias("slots"))
    placed = ordered.select("slots", F.aggregate("slots", start, place)["picks"].alias("picks"))
    return placed.select(F.inline(F.arrays_zip("slots", "picks"))).select(
        (F.col("slots.version") + 1).alias("version"), "slots.vslot", "slots.bytes", "slots.rows", F.col("picks").alias("shard")
    )


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add one version to the maps kept in folder; older versions stay readable. A version that is there already is an error."""
    version = slot_map.select("version").first()[0]
    slot_map.drop("version").write.mode("error").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map kept in folder, the newest by default."""
    maps = spark.read.parquet(folder)
    wanted = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == wanted)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and slot, the place in the shard, to slot_records(), by any version of a map."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    located = slot_map.withColumn("before", before).select("vslot", "shard", "before")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("within", within).join(F.broadcast(located), "vslot").withColumn("slot", F.col("before") + F.col("within") - 1).drop("before", "within")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Place every record: doc_id, size, text_crc32, vslot, shard, slot (its place in the shard, gapless from 0), next_map_shard.

    Bytes are near equal over shards as far as slots allow: no shard is above
    the mean by more than the heaviest slot. Versions 1 (the shards) and 2 (one
    shard more) of the map are stored in folder. An empty input gives an empty
    result. Wholly equal rows are kept, each with a place of its own. Places
    come from a count within the record's slot and the map's row counts, so no
    task sorts more than the records of single slots.
    """
    spark = docs.sparkSession
    records = written(slot_records(docs, id_col, text_col, n_slots), "shard-records")
    folder = folder or new_path(spark, "shard-maps")
    store_map(build_map(slot_loads(records, n_slots), shards), folder)
    first = load_map(spark, folder, 1)
    store_map(grow_map(first, shards), folder)
    grown = load_map(spark, folder).select("vslot", F.col("shard").alias("next_map_shard"))
    return place(records, first).join(F.broadcast(grown), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", "slot", "next_map_shard")
