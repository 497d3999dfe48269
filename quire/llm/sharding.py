"""Sharding by fixed virtual slots.

A record's key is hashed into one of SLOTS slots, for good. A versioned table maps slots to shards;
moving data means editing that table, never hashing anew. ``rebalance`` keeps as many slots of a
shard as its fair share of the bytes holds, in the order of their numbers, and deals the others out
to shards with room: every shard ends below the fair share plus one slot.

A null key hashes as the empty string; a null text has 0 bytes; rows with one key share a slot and
each counts. An empty table leaves the even map unchanged. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch_path, slim, written

SLOTS = 4096
SHARDS = 64


def slot(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``slot``, ``n_bytes`` of every row."""
    return slim(docs, key, text).select("doc_id", slot(F.col("doc_id"), slots).alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))


def even_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.expr(f"CAST(id * {shards} DIV {slots} AS INT)").alias("shard"))


def slot_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("slot").agg(F.sum("n_bytes").alias("n_bytes"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of ``slot_map`` (``slot``, ``shard``). Both inputs have at most one row a slot, so the single-partition windows and broadcasts here are as large as the map, whatever the data."""
    m = slot_map.join(F.broadcast(sizes), "slot", "left").select("slot", "shard", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    fair = m.agg(F.ceil(F.sum("n_bytes") / F.lit(shards)).cast("bigint").alias("fair"))
    m = m.crossJoin(F.broadcast(fair)).withColumn("upto", F.sum("n_bytes").over(Window.partitionBy("shard").orderBy("slot")))
    stays = m.filter("upto <= fair")
    kept = stays.groupBy("shard").agg(F.sum("n_bytes").alias("kept"))
    spark = slot_map.sparkSession
    room = spark.range(shards).select(F.col("id").cast("int").alias("to_shard")).join(F.broadcast(kept), F.col("to_shard") == F.col("shard"), "left").crossJoin(F.broadcast(fair))
    room = room.select("to_shard", (F.col("fair") - F.coalesce("kept", F.lit(0))).alias("room"))
    room = room.withColumn("room_to", F.sum("room").over(Window.orderBy("to_shard"))).filter("room > 0").select("to_shard", (F.col("room_to") - F.col("room")).alias("room_from"), "room_to")
    moves = m.filter("upto > fair").withColumn("start", F.sum("n_bytes").over(Window.orderBy("slot")) - F.col("n_bytes"))
    moved = moves.join(F.broadcast(room), (F.col("start") >= F.col("room_from")) & (F.col("start") < F.col("room_to")), "left")
    return stays.select("slot", "shard").unionByName(moved.select("slot", F.coalesce("to_shard", "shard").alias("shard")))


class SlotMapStore:
    """Versions of the map in one folder, ``version=0`` the first; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, slot_map: DataFrame, version: int) -> DataFrame:
        slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.get(version)

    def get(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def latest(self) -> int:
        return self.spark.read.parquet(self.path).agg(F.max("version")).first()[0]


def shard_documents(docs: DataFrame, path: str | None = None, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Every record's slot, its shard under the even first version of the map and under the rebalanced second one."""
    spark = docs.sparkSession
    store = SlotMapStore(spark, path or scratch_path(spark, "slot-map"))
    placed = written(records(docs, slots), "slots")
    first = store.put(even_map(spark, slots, shards), 0)
    second = store.put(rebalance(first, slot_bytes(placed), shards), 1)
    both = first.withColumnRenamed("shard", "shard_v0").join(F.broadcast(second.withColumnRenamed("shard", "shard_v1")), "slot")
    return placed.join(F.broadcast(both), "slot").select("doc_id", "slot", "n_bytes", "shard_v0", "shard_v1")


SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SLOTS} AS INTEGER) AS slot,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes
  FROM documents),
m AS (
  SELECT s.slot, CAST(s.slot * {SHARDS} // {SLOTS} AS INTEGER) AS shard, coalesce(b.n_bytes, 0) AS n_bytes
  FROM (SELECT CAST(unnest(range({SLOTS})) AS INTEGER) AS slot) s
  LEFT JOIN (SELECT slot, sum(n_bytes) AS n_bytes FROM r GROUP BY slot) b USING (slot)),
f AS (SELECT CAST(ceil(sum(n_bytes) / {SHARDS}.0) AS BIGINT) AS fair FROM m),
u AS (SELECT m.*, fair, sum(n_bytes) OVER (PARTITION BY shard ORDER BY slot) AS upto FROM m, f),
k AS (SELECT shard, sum(n_bytes) AS kept FROM u WHERE upto <= fair GROUP BY shard),
room AS (
  SELECT s.shard AS to_shard, fair - coalesce(kept, 0) AS room, sum(fair - coalesce(kept, 0)) OVER (ORDER BY s.shard) AS room_to
  FROM (SELECT CAST(unnest(range({SHARDS})) AS INTEGER) AS shard) s LEFT JOIN k USING (shard), f),
mv AS (SELECT slot, shard, sum(n_bytes) OVER (ORDER BY slot) - n_bytes AS start FROM u WHERE upto > fair),
v1 AS (
  SELECT slot, shard FROM u WHERE upto <= fair
  UNION ALL
  SELECT slot, coalesce(to_shard, shard) FROM mv LEFT JOIN room ON room > 0 AND start >= room_to - room AND start < room_to)
SELECT r.doc_id, r.slot, r.n_bytes, m.shard AS shard_v0, v1.shard AS shard_v1
FROM r JOIN m USING (slot) JOIN v1 USING (slot)
"""
