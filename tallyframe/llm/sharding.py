"""Consistent-hash ring with virtual nodes and bounded loads."""

import math

import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, numbered, stored
from tallyframe.llm.registry import query

SHARDS = 16
POINTS = 64


def ring_points(shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions have 52 bits, so doubles hold them exactly."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{p}") >> 12, s) for s in range(shards) for p in range(points))


def quotas(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows a shard takes. Without slack the quotas add up to `rows` and differ by one at most."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk_ring(owners: list[int], loads: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Parts (arc, first rank, end rank, shard, first slot): what a full shard can't take goes on clockwise.

    All arcs try their own node first, then all the next one, and so on. A part either ends its arc or fills a shard, so
    there are at most as many parts as arcs and shards together.
    """
    room, taken, done, parts = list(room), [0] * len(room), [0] * len(loads), []
    waiting = [a for a, n in enumerate(loads) if n]
    for step in range(len(owners)):
        for arc in waiting:
            shard = owners[(arc + step) % len(owners)]
            n = min(loads[arc] - done[arc], room[shard] - taken[shard])
            if n > 0:
                parts.append((arc, done[arc], done[arc] + n, shard, taken[shard]))
                done[arc] += n
                taken[shard] += n
        waiting = [a for a in waiting if done[a] < loads[a]]
    return parts


def assign_shards(df: DataFrame, key: str, spread: list[str], shards: int = SHARDS, points: int = POINTS,
                  slack: float = 0.0) -> DataFrame:
    """Add `shard` and `slot` (gapless from 0 in each shard) to the rows of `df`.

    The hash of `key` (null is a value like any other) names an arc of the ring. Only the rows per arc, `shards * points`
    numbers, reach the driver, which walks the ring; a row's rank in its arc then gives its place. Ranks follow a hash of
    `spread`, so arcs that one key fills are still numbered in parts. Repeated rows get places of their own; an empty
    table stays empty. `df` is read several times and should be stored; columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    ring = ring_points(shards, points)
    splits = [-math.inf, *[float(p) for p, _ in ring], math.inf]
    owners = [s for _, s in ring]
    position = F.shiftrightunsigned(F.xxhash64(F.col(key)), 12).cast("double")
    placed = Bucketizer(splits=splits, inputCol="_position", outputCol="_point") \
        .transform(df.drop("shard", "slot").withColumn("_position", position)) \
        .withColumn("_arc", F.pmod(F.col("_point").cast("int"), F.lit(len(ring)))).drop("_position", "_point")
    loads = [0] * len(ring)
    for row in placed.groupBy("_arc").count().collect():
        loads[row["_arc"]] = row["count"]
    rows = sum(loads)
    parts = spark.createDataFrame(walk_ring(owners, loads, quotas(rows, shards, slack)),
                                  "_arc int, first long, end long, shard int, slot long")
    parts = parts.groupBy("_arc").agg(F.collect_list(F.struct("first", "end", "shard", "slot")).alias("_parts"))
    ranked = numbered(placed, ["_arc"], spread, "_rank", rows).join(F.broadcast(parts), "_arc")
    mine = F.filter("_parts", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") < p["end"]))[0]
    return ranked.withColumn("_part", mine).withColumn("shard", F.col("_part.shard")) \
        .withColumn("slot", F.col("_part.slot") + F.col("_rank") - F.col("_part.first")) \
        .drop("_arc", "_parts", "_rank", "_part")


@query()
def op8_sharding(spark, folder):
    """Law `rows`: every shard takes its quota and no more, so counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = stored(documents(spark, folder).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return assign_shards(docs, "doc_id", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
