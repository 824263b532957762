"""Operator 7, sharding by fixed virtual slots. DataFrame functions only.

Every record hashes into one of N_SLOTS virtual slots, which never change. Bytes are summed per slot, and a versioned
slot-to-shard map places whole slots; rebalancing edits that map and gives it the next version, so records move only
with their slot. Maps are stored in a folder, a version each, and are never overwritten: records are placed by a stored
version, and rebalancing reads one and adds the next. The map holds n_slots rows whatever the input's size, hence it may be broadcast.

Defined results: a null text has size 1 and the checksum of no bytes; a null key hashes by its text; equal keys share
a slot; an empty table gives an empty result; further columns are ignored; a map of a version that is stored already is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, table

N_SLOTS = 4096
N_SHARDS = 16


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """28 bits of the key's MD5 modulo n_slots: the same in every engine that has MD5."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of all n_slots slots, empty ones too."""
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sums), "vslot", "left").na.fill(0, ["bytes", "rows"])


def first_map(sums: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of the map, (version, vslot, shard, bytes, rows): slots by falling bytes, each to the shard with the least so far.

    The fold runs over one array of n_slots entries, a fixed size."""
    zero = f"cast(array_repeat(0, {n_shards}) as array<bigint>)"
    fold = f"""
        aggregate(
            slots,
            named_struct('loads', {zero}, 'shards', cast(array() as array<int>)),
            (acc, x) -> named_struct(
                'loads', transform(acc.loads, (v, i) -> if(i = array_position(acc.loads, array_min(acc.loads)) - 1, v - x.neg, v)),
                'shards', array_append(acc.shards, cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int))),
            acc -> arrays_zip(slots, acc.shards))"""
    one = sums.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "rows"))).alias("slots"))
    placed = one.select(F.explode(F.expr(fold)).alias("x"))
    return placed.select(F.lit(1).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.shards").alias("shard"), (-F.col("x.slots.neg")).alias("bytes"), F.col("x.slots.rows").alias("rows"))


def rebalanced(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version of the map for n_shards >= those in use: each shard over the new mean gives up slots, in slot
    order, until it is as near to the mean as that gets; they fill the new shards in turn. Other slots stay where they are."""
    shard = Window.partitionBy("shard")
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(n_shards)
    marked = slot_map.withColumn("mean", mean).withColumn("load", F.sum("bytes").over(shard)).withColumn("given", F.sum("bytes").over(shard.orderBy("vslot")))
    old = F.max("shard").over(Window.partitionBy("version")) + 1
    marked = marked.withColumn("old", old).withColumn("moves", (F.col("load") - F.col("given") + F.col("bytes") / 2 >= F.col("mean")) & (F.col("bytes") > 0) & (F.col("old") < n_shards))
    turn = F.row_number().over(Window.partitionBy("version", "moves").orderBy(F.desc("bytes"), "vslot")) - 1
    to = F.col("old") + turn % F.greatest(F.lit(n_shards) - F.col("old"), F.lit(1))
    return marked.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.col("moves"), to).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


MAP = "version int, vslot int, shard int, bytes long, rows long"


def save_map(slot_map: DataFrame, folder: str) -> int:
    """Adds a map to the maps in folder, and returns its version."""
    slot_map = slot_map.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in MAP.split(", "))).coalesce(1)
    version = slot_map.select("version").first()["version"]
    slot_map.drop("version").write.parquet(f"{folder}/version={version}")  # an error if it is there
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The map of that version, or else of the latest one in folder."""
    maps = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select(*(c.split()[0] for c in MAP.split(", ")))


def sized(docs: DataFrame, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        virtual_slot(F.coalesce(F.col(key).cast("string"), F.md5(body.cast("binary"))), n_slots).alias("vslot"),
    )


def shard(docs: DataFrame, slot_map: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, version): shard by the map, slot the place in the shard. Places count on from the
    rows in the shard's earlier virtual slots, so no task sees a whole shard."""
    rows = sized(docs, n_slots)
    start = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    starts = slot_map.select("version", "vslot", "shard", start.alias("start"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("key", "size", "text_crc32")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(starts), "vslot")
        .select(F.col("key").alias("doc_id"), "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "vslot", "version")
    )


def planned(docs: DataFrame, folder: str, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """Stores version 1 of the map of docs in folder, and reads it."""
    version = save_map(first_map(slot_bytes(sized(docs, n_slots), n_slots), n_shards), folder)
    return load_map(docs.sparkSession, folder, version)


def grown(spark: SparkSession, folder: str, n_shards: int) -> DataFrame:
    """Stores the next version of the latest map in folder, for n_shards, and reads it."""
    return load_map(spark, folder, save_map(rebalanced(load_map(spark, folder), n_shards), folder))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: the map places slots by their bytes, so shards have near equal sizes. Records are placed by the stored map."""
    docs = table(spark, sf_dir, "documents")
    out = shard(docs, planned(docs, new_folder(spark, "slot-maps")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
