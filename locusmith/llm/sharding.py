"""Sharding by a hierarchical weighted hash tree.

A document descends from the root through region and rack to a shard. At each node every child draws
-ln(u) / weight, where u is the hash of the document's id, the level and the child, and the least draw wins, so a
child gets its part by weight. A child's draws don't depend on its siblings: when weights below one region change,
the regions' draws change for that region alone, and rows move only into or out of it. A further shard opens a
region of its own once the last one is full, so growing from a full tree moves rows into the new shard alone.

Slots number a shard's documents from 0 without a gap: rows are counted by shard and hash range, the running sum of
the counts is the first slot of each range, and running counts within the range do the rest, so no task sees a
whole shard, and repeated rows are numbered by their counts.

Defined results: a null text has 1 byte and checksum 0; a null id hashes as the empty key; equal ids share a shard
and get slots of their own; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, hash_bits

#: Region, rack, shard and weight of every leaf.
Leaf = tuple[int, int, int, float]


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [(s // (per_rack * racks), s // per_rack, s, 1.0) for s in range(shards)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    bits = hash_bits(F.concat(key, F.lit(f":{level}:{child}")), 13)
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / weight).alias("draw"), F.lit(child).alias("child"))


def _least(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[_draw(key, level, c, w) for c, w in sorted(weights.items())]))["child"]


def shard_of(doc_id: Column, leaves: list[Leaf]) -> Column:
    """The shard to which a document descends."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))

    def total(level: int, parent: int | None = None) -> dict[int, float]:
        out: dict[int, float] = {}
        for leaf in leaves:
            if leaf[3] > 0 and (parent is None or leaf[level - 1] == parent):
                out[leaf[level]] = out.get(leaf[level], 0.0) + leaf[3]
        return out

    def inside(level: int, name: str, parents: Column, chosen: list[int]) -> Column:
        """The child picked below whichever parent was picked."""
        out = F.lit(None)
        for p in chosen:
            out = F.when(parents == p, _least(key, name, total(level, p))).otherwise(out)
        return out

    region = _least(key, "region", total(0))
    rack = inside(1, "rack", region, sorted(total(0)))
    return inside(2, "shard", rack, sorted(total(1))).cast("int")


def with_slots(docs: DataFrame, shard: str, slot: str, order: list[str], ranges: int = 4096, salts: int = 1024) -> DataFrame:
    """Adds ``slot``, gapless from 0 within ``shard``, in the order of hash ranges of the ``order`` columns.

    Rows that are equal in every column are counted by task first, so any number of them is a few rows to number; each
    gets its slots back from its count. Which of such rows has which slot makes no difference.
    """
    part, first, salt, n, before = fresh(docs, "_range", "_first", "_salt", "_n", "_before")
    counted = docs.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*docs.columns, salt).agg(F.count(F.lit(1)).alias(n))
    parted = counted.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(ranges)))
    counts = parted.groupBy(shard, part).agg(F.sum(n).alias(first))
    running = F.sum(first).over(Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(shard, part, F.coalesce(running, F.lit(0)).alias(first))
    rest = [c for c in docs.columns if c not in order]
    within = F.sum(n).over(Window.partitionBy(shard, part).orderBy(*order, *rest, salt).rowsBetween(Window.unboundedPreceding, -1))
    placed = parted.withColumn(before, F.coalesce(within, F.lit(0))).join(starts, [shard, part])
    start = F.col(first) + F.col(before)
    slots = F.sequence(start.cast("long"), (start + F.col(n) - 1).cast("long"))
    return placed.select(*docs.columns, F.explode(slots).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: size, checksum, shard and slot, and its shard once there is one more."""
    rows = checkpoint(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(F.col("doc_id"), tree(shards)).alias("shard"),
            shard_of(F.col("doc_id"), tree(shards + 1)).alias("grown_shard"),
        )
    )
    return with_slots(rows, "shard", "slot", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
