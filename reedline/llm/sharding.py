"""Sharding by fixed virtual slots: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedline.llm.common import fresh_path, stored

SLOTS = 4096
SHARDS = 16
#: Equal records that one task numbers at once.
COPIES = 100_000


def slot_of(key: str, checksum: str, copy: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from its key, its text's checksum and which of its equal records it is; it never changes, whatever the number of shards.

    The text counts too, so that rows without key, or a key with very many rows, don't fill one slot; so does the copy (0 on), so that equal rows don't either.
    """
    alone, again = F.xxhash64(key, checksum), F.xxhash64(key, checksum, copy)
    return F.pmod(F.when(F.col(copy) == 0, alone).otherwise(again), F.lit(slots)).cast("int")


def records_of(spark: SparkSession, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, text_crc32, copy) of every row. Equal records are counted where they lie, and only their number is shuffled; then each gets a copy number of its own.

    A record with very many copies is numbered in blocks of COPIES, so no task makes more at once.
    """
    sized = docs.select(
        F.col(key).alias("_key"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32")
    )
    counted = stored(spark, sized.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("n")), "records")
    zero = F.lit(0).cast("long")
    few = counted.where(F.col("n") <= COPIES).select("_key", "size", "text_crc32", F.explode(F.sequence(zero, F.col("n") - 1)).alias("copy"))
    blocks = counted.where(F.col("n") > COPIES).select("*", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES))).alias("block"))
    first, last = F.col("block") * COPIES, F.least((F.col("block") + 1) * COPIES, "n") - 1
    many = blocks.repartition("_key", "text_crc32", "block").select("_key", "size", "text_crc32", F.explode(F.sequence(first, last)).alias("copy"))
    return few.unionByName(many)


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for all slots, empty ones too. records: vslot, size."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    sums = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    return every.join(sums, "vslot", "left").select(
        "vslot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows")
    )


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the slot map: equal runs of slots."""
    return spark.range(slots).select(
        F.lit(1).alias("version"),
        F.col("id").cast("int").alias("vslot"),
        F.floor(F.col("id") * shards / slots).cast("int").alias("shard"),
    )


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored slot map (vslot, shard, version), the latest if none is named."""
    every = spark.read.schema("vslot int, shard int, version int").parquet(path).select("version", "vslot", "shard")
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored slot map. Each version is a folder of its own and is never changed after."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a slot map, edited so that the shards' bytes are near equal.

    A shard keeps its largest slots as long as they fit under the mean; the others move, largest first, each to the shard
    with the fewest bytes so far (ties: the smaller shard). All this runs over one row a slot, a fixed number. A shard
    number of `shards` or more (a shard being removed) keeps nothing; a new shard starts empty.
    """
    now = slot_map.join(sizes, "vslot")
    mean = F.sum("bytes").over(W.partitionBy()) / shards
    order = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0)
    now = now.withColumn("mean", mean).withColumn("filled", F.sum("bytes").over(order))
    stays = (F.col("filled") <= F.col("mean")) & (F.col("shard") < shards)
    now = now.withColumn("stays", stays)
    loads = F.array(
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0).cast("long")) for s in range(shards)]
    )
    moving = F.sort_array(
        F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), F.col("vslot").alias("vslot"))))
    )
    start = F.struct(
        F.col("loads").alias("loads"),
        F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("moves"),
    )

    def place(so_far: Column, slot: Column) -> Column:
        to = F.array_position(so_far["loads"], F.array_min(so_far["loads"])).cast("int") - 1
        filled = F.transform(so_far["loads"], lambda load, i: F.when(i == to, load - slot["less"]).otherwise(load))
        return F.struct(
            filled.alias("loads"),
            F.array_append(so_far["moves"], F.struct(slot["vslot"].alias("vslot"), to.alias("shard"))).alias("moves"),
        )

    summed = now.agg(loads.alias("loads"), moving.alias("moving"))
    moves = summed.select(F.inline(F.aggregate("moving", start, place)["moves"]))
    moved = now.drop("shard").join(moves, "vslot").select("version", "vslot", "shard")
    kept = now.where("stays").select("version", "vslot", "shard")
    return kept.unionByName(moved).withColumn("version", F.col("version") + 1)


def shard_documents(
    spark: SparkSession, docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None
) -> tuple[DataFrame, str]:
    """Put every record into one of `shards` shards; returns (rows, path of the stored slot map).

    Records hash into `slots` virtual slots; the bytes of each slot are summed; the slot-to-shard map is stored as a table
    with all its versions. A new map starts with version 1, the even layout. A map that is already stored at `map_path` goes on from its
    latest version. That one is rebalanced by the bytes of these records, for `shards` shards, and stored as the next version, which is
    in force. Without `map_path` the map lies in the shared folder while the session lasts. Rows: key, size
    (UTF-8 bytes of the text plus 1), text_crc32, law 'bytes', shard, slot (the record's place in its shard, gapless from 0),
    grown_shard (null under this law), vslot, map_version.

    A null text has size 1 and the checksum of no bytes, 0. Repeated rows each get a place of their
    own. An empty table gives no rows. Other columns are not carried. Slots follow key, text and the number of the copy, so no
    key, copy, source or text makes one large; a slot moves whole, so sizes are as near equal as its largest members allow.
    """
    records = records_of(spark, docs, key, text).withColumn("vslot", slot_of("_key", "text_crc32", "copy", slots))
    path = fresh_path(spark, "shard-slots")
    sizes_at, map_at = f"{path}/sizes", map_path or f"{path}/map"
    slot_bytes(records, slots).coalesce(1).write.parquet(sizes_at)
    sizes = spark.read.parquet(sizes_at)
    if not _exists(spark, map_at):
        store_map(first_map(spark, slots, shards), map_at)
    store_map(rebalanced(load_map(spark, map_at), sizes, shards), map_at)
    in_force = load_map(spark, map_at)
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    placed = in_force.join(sizes, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("offset"), "version"
    )
    in_slot = W.partitionBy("vslot").orderBy(F.col("_key").asc_nulls_first(), "text_crc32", "size", "copy")
    numbered = records.withColumn("nth", F.row_number().over(in_slot))
    rows = numbered.join(F.broadcast(placed), "vslot").select(  # one row a slot
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.col("version").cast("int").alias("map_version"),
    )
    return rows, map_at


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
