"""Sharding by fixed virtual slots.

A record's hash picks one of ``SLOTS`` virtual slots, for good. A stored, versioned map says which shard holds a slot:
version 1 deals slots out evenly; a rebalancing reads only the bytes of each slot and edits the map, moving as few slots
as it takes for near-equal shards; adding a shard is another edit, and each edit is another version of the table. The
map has a fixed number of entries, so it may pass through the driver and be broadcast; rows never do.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT, durable, shared_dir

SLOTS = 16_384


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; each edit gives a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s * shards // slots for s in range(slots)))

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(self.version, self.shards, s, k) for s, k in enumerate(self.shard_of)]

    def moved(self, older: SlotMap) -> int:
        return sum(a != b for a, b in zip(self.shard_of, older.shard_of))

    def rebalanced(self, sizes: Iterable[tuple[int, int]], shards: int | None = None) -> SlotMap:
        """The map edited for near-equal bytes over ``shards`` (as many as now, if not given; more adds empty ones).

        Shards over the mean give up slots, the largest that still fit the surplus first; what they gave up goes, largest
        first, to the shard with the fewest bytes. Then slots of the fullest and the emptiest shard are exchanged while
        that narrows the gap. Slots without bytes stay.
        """
        shards = shards or self.shards
        size = dict(sizes)
        held: list[list[int]] = [[] for _ in range(shards)]
        of = [k if k < shards else -1 for k in self.shard_of]
        pool = []
        for s, k in enumerate(of):
            if k < 0:
                pool.append(s)
            elif size.get(s, 0):
                held[k].append(s)
        load = [sum(size[s] for s in own) for own in held]
        mean = (sum(load) + sum(size.get(s, 0) for s in pool)) / shards
        for k in range(shards):
            for s in sorted(held[k], key=lambda s: (-size[s], s)):
                if load[k] - size[s] >= mean:
                    load[k] -= size[s]
                    pool.append(s)
                    of[s] = -1
        for k in range(shards):  # one more, so that none stays above the mean
            own = sorted((s for s in held[k] if of[s] == k), key=lambda s: (size[s], s))
            for s in own:
                if load[k] <= mean:
                    break
                load[k] -= size[s]
                pool.append(s)
                of[s] = -1
        heap = [(load[k], k) for k in range(shards)]
        heapq.heapify(heap)
        for s in sorted(pool, key=lambda s: (-size.get(s, 0), s)):
            b, k = heapq.heappop(heap)
            of[s] = k
            heapq.heappush(heap, (b + size.get(s, 0), k))
        load = [0] * shards
        members: list[list[int]] = [[] for _ in range(shards)]
        for s, k in enumerate(of):
            load[k] += size.get(s, 0)
            if size.get(s, 0):
                members[k].append(s)
        for _ in range(200):
            low, high = min(range(shards), key=lambda k: (load[k], k)), max(range(shards), key=lambda k: (load[k], -k))
            gap = load[high] - load[low]
            best = _exchange(gap, sorted((size[s], s) for s in members[high]), sorted([(0, -1), *((size[s], s) for s in members[low])]))
            if best is None:
                break
            shift, give, take = best
            for s, src, dst in ((give, high, low), (take, low, high)):
                if s >= 0:
                    members[src].remove(s)
                    members[dst].append(s)
                    of[s] = dst
            load[high] -= shift
            load[low] += shift
        return SlotMap(self.version + 1, shards, tuple(of))


def _exchange(gap: int, high: list[tuple[int, int]], low: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """The slot to give and the slot to take (or -1) whose difference is nearest to half the gap; both lists are sorted."""
    best, at = None, 0
    for b, s in high:
        while at + 1 < len(low) and b - low[at + 1][0] >= gap / 2:
            at += 1
        for i in (at, at + 1):
            if i < len(low) and 0 < (shift := b - low[i][0]) < gap and (best is None or abs(gap / 2 - shift) < abs(gap / 2 - best[0])):
                best = (shift, s, low[i][1])
    return best


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null: 1), text_crc32, h (the record's hash, from id and text) and at (its place)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), F.monotonically_increasing_id().alias("at"),
    )


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Assign every row by the stored map at ``map_path`` after a rebalancing edit; returns rows and the map in force.

    Rows: doc_id, size, text_crc32, shard, slot (place within the shard, gapless from 0, by virtual slot), vslot and
    map_version. Without a path, or with one that holds no map yet, version 1 is stored first. Null texts have size 1,
    null ids hash as such. Rows equal in id and text share a virtual slot and their places follow in any order; where
    such rows make up more than one in HOT of the table, each counts as a record of its own (they are interchangeable),
    so that they cannot fill a slot. An empty table gives no rows.
    """
    spark = docs.sparkSession
    home = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if not stored(spark, home):
        save_map(spark, SlotMap.first(shards), home)
    rows = durable(sized(docs, id_col, text_col), "sized")
    total = rows.count()
    heavy = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") * HOT > total) & (F.col("n") > 64)).select("h", F.lit(True).alias("heavy"))  # HOT rows at most
    own = F.when(F.col("heavy"), F.xxhash64("h", "at")).otherwise(F.col("h"))
    placed = rows.join(F.broadcast(heavy), "h", "left").withColumns({"vslot": F.pmod(own, F.lit(SLOTS)).cast("int"), "salt": F.pmod(F.xxhash64(F.lit(1), own), F.lit(16)).cast("int")}).drop("h", "at", "heavy")
    counted = placed.groupBy("vslot", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # SLOTS * 16 at most
    per_slot: dict[int, int] = {}
    for r in counted:
        per_slot[r["vslot"]] = per_slot.get(r["vslot"], 0) + r["bytes"]
    save_map(spark, load_map(spark, home).rebalanced(per_slot.items(), shards), home)
    slot_map = load_map(spark, home)
    start, at = [], [0] * shards
    for r in sorted(counted, key=lambda r: (r["vslot"], r["salt"])):
        k = slot_map.shard_of[r["vslot"]]
        start.append((r["vslot"], r["salt"], k, at[k]))
        at[k] += r["n"]
    places = spark.createDataFrame(start, "vslot int, salt int, shard int, start long")
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("vslot", "salt").orderBy("doc_id", "text_crc32", "size")))
    out = numbered.join(F.broadcast(places), ["vslot", "salt"])  # SLOTS * 16 rows at most
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), "vslot", F.lit(slot_map.version).alias("map_version")), slot_map


def stored(spark: SparkSession, path: str) -> bool:
    """Is there a table at the path?"""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the stored map."""
    spark.createDataFrame(slot_map.rows(), "version int, shards int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest if none is named."""
    rows = spark.read.schema("version int, shards int, vslot int, shard int").parquet(path)
    version = version or rows.agg(F.max("version")).first()[0]
    own = sorted((r["vslot"], r["shard"], r["shards"]) for r in rows.filter(F.col("version") == version).collect())
    return SlotMap(version, own[0][2], tuple(k for _, k, _ in own))
