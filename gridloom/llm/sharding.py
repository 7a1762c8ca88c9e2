"""Sharding by fixed virtual slots: records are hashed into slots, and a versioned map gives each slot's shard.

The hash of a record never changes; what changes is the map, of one row for each slot. Rebalancing reads the bytes of each
slot and writes a new version of the map, in which as few slots as need be have another shard; older versions stay
readable. Work on the map is done on the driver: it has ``SLOTS`` rows, however large the table is.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ensure_checkpoint_dir, table_exists, whole

SLOTS = 4096
SHARDS = 24
#: Records that one in so many rows repeats, of which there are as many at most, are dealt to all slots.
HOT = 1000


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot, as of a version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def even(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """The first version: slots dealt in turn."""
        return cls(1, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, sizes: list[int], shards: int | None = None) -> SlotMap:
        """The next version, for the slots' ``sizes``: shards above the mean give slots up, those go to the least full.

        ``shards`` may be more or fewer than before; slots of shards that are gone all move. Slots without bytes are dealt
        by their number, so that later rows find even shards. No shard stays above the mean by more than its smallest
        moves could mend: at the end the fullest and the emptiest shard move or swap slots as long as that brings them closer.
        """
        count = shards or self.shards
        if len(sizes) != len(self.shard_of) or count < 1:
            raise ValueError("sizes need one entry for each slot, and there must be a shard")
        own: list[set[int]] = [set() for _ in range(count)]
        pool = []
        for slot, shard in enumerate(self.shard_of):
            own[shard].add(slot) if shard < count else pool.append(slot)
        load = [sum(sizes[s] for s in slots) for slots in own]
        mean = sum(sizes) / count
        for shard, slots in enumerate(own):
            for slot in sorted(slots, key=lambda s: (-sizes[s], s)):
                if sizes[slot] and load[shard] - sizes[slot] >= mean:
                    slots.remove(slot)
                    load[shard] -= sizes[slot]
                    pool.append(slot)
        heap = [(n, len(own[k]), k) for k, n in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(pool, key=lambda s: (-sizes[s], s)):
            _, _, k = heapq.heappop(heap)
            own[k].add(slot)
            load[k] += sizes[slot]
            heapq.heappush(heap, (load[k], len(own[k]), k))
        _even_out(own, load, sizes)
        placed = [0] * len(sizes)
        for k, slots in enumerate(own):
            for slot in slots:
                placed[slot] = k
        return SlotMap(self.version + 1, count, tuple(placed))

    def frame(self, spark: SparkSession, **more: list[int]) -> DataFrame:
        """(virtual_slot, shard) and a column for each of ``more``, a row for each slot: the bound of its broadcasts."""
        rows = list(zip(range(len(self.shard_of)), self.shard_of, *more.values(), strict=True))
        return spark.createDataFrame(rows, ", ".join(["virtual_slot int", "shard int", *[f"{c} long" for c in more]]))

    def save(self, spark: SparkSession, path: str) -> SlotMap:
        """Write this version below ``path``; it is an error if it is there, so of two writers in turn the second one fails."""
        self.frame(spark).withColumn("shards", F.lit(self.shards)).coalesce(1).write.parquet(f"{path}/version={self.version}")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The map of a version, the latest one if none is given."""
        every = spark.read.schema("virtual_slot int, shard int, shards int, version int").parquet(path)
        version = version or every.agg(F.max("version")).first()[0]
        rows = every.where(F.col("version") == version).orderBy("virtual_slot").collect()
        if not rows:
            raise LookupError(f"no version {version} of the slot map")
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def _even_out(own: list[set[int]], load: list[int], sizes: list[int]) -> None:
    """Move or swap slots between the fullest and the emptiest shard as long as it brings them closer."""
    stuck: set[int] = set()
    while len(stuck) < len(own) - 1:
        most = max((k for k in range(len(own)) if k not in stuck), key=lambda k: (load[k], -k))
        least = min(range(len(own)), key=lambda k: (load[k], k))
        apart = load[most] - load[least]
        give = sorted(own[most], key=lambda s: (sizes[s], s))
        back = [None, *sorted(own[least], key=lambda s: (sizes[s], s))]
        small = np.array([0, *[sizes[s] for s in back[1:]]], np.int64)
        best = (apart, None, None)
        for slot in give:
            # What comes back should leave a difference of half of what lies between them.
            at = int(np.searchsorted(small, sizes[slot] - apart / 2))
            for j in {min(at, len(small) - 1), max(at - 1, 0)}:
                best = min(best, (abs(apart - 2 * (sizes[slot] - int(small[j]))), slot, back[j]), key=lambda b: b[0])
        if best[1] is None:
            stuck.add(most)
            continue
        _, slot, other = best
        own[most].remove(slot)
        own[least].add(slot)
        if other is not None:
            own[least].remove(other)
            own[most].add(other)
        for k in (most, least):
            load[k] = sum(sizes[s] for s in own[k])
        stuck.clear()


def size(text: Column) -> Column:
    """What a document takes: its UTF-8 bytes, none for a null text, and 8 for its id."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 8


def record(ident: str = "doc_id", text: str = "text") -> Column:
    """64-bit hash of a record: of its id and its text."""
    return F.xxhash64(F.col(ident), F.col(text))


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows``, which have ``record``, with ``virtual_slot``: by the hash alone.

    Rows with the same id and text have the same hash. Where such a record is over a thousandth of all rows, its rows are
    interchangeable and are dealt to all slots by their place, as one slot would outgrow a shard.
    """
    total = rows.count()
    # HOT rows at most.
    hot = F.broadcast(rows.groupBy("record").agg(F.count("*").alias("n")).where(F.col("n") * HOT > F.lit(max(total, HOT * HOT))).select("record", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0))
    return rows.join(hot, "record", "left").withColumn("virtual_slot", F.pmod(F.xxhash64("record", salt), F.lit(slots)).cast("int")).drop("_hot")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot, of rows with virtual_slot and size: ``slots`` rows come to the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = int(r["size"]), r["n"]
    return size, count


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Rows (doc_id, size, text_crc32, virtual_slot, shard, slot) of ``docs`` and the map, of which each version is saved at ``path``.

    The latest map at ``path``, or an even one, is edited for the bytes that the slots have now. ``slot`` numbers the rows
    of a shard from 0 without gaps: by virtual slot, and inside it by doc_id. Null texts have a size of 8 and the CRC of the
    empty text; null ids come first. Every row is counted, repeated ones too.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", size(F.col("text")).alias("size"), F.crc32(whole().cast("binary")).alias("text_crc32"), record().alias("record"))
    rows = cut(with_slots(cut(narrow), slots))
    sizes, counts = slot_sizes(rows, slots)
    before = SlotMap.load(spark, path) if table_exists(spark, path) else SlotMap.even(shards, slots).save(spark, path)
    now = before.rebalanced(sizes, shards).save(spark, path)
    offset, used = [0] * slots, [0] * shards
    for k, s in enumerate(now.shard_of):
        offset[k], used[s] = used[s], used[s] + counts[k]
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.join(F.broadcast(now.frame(spark, offset=offset)), "virtual_slot")
    slot = F.col("offset") + F.row_number().over(inside) - 1
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot.cast("long").alias("slot")), now


def report(docs: DataFrame) -> DataFrame:
    """Every document's shard of 24, by bytes: ``shard`` with a new map, whose even first version is edited for the table's bytes.

    Columns: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law), virtual_slot,
    map_version. An empty table gives an empty one; columns with clashing names are left alone.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows, now = shard(docs, f"{spark.sparkContext.getCheckpointDir()}/slot-map-{uuid.uuid4().hex}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"))


def write_shards(docs: DataFrame, path: str, now: SlotMap, slots: int = SLOTS) -> None:
    """Write whole rows of ``docs`` below ``path``, a folder for each shard, by the map ``now``.

    Rows go to as many tasks as there are slots in use, a slot's rows together, so no task has more than its slots.
    """
    spark = docs.sparkSession
    placed = with_slots(docs.withColumn("record", record()), slots).drop("record").join(F.broadcast(now.frame(spark)), "virtual_slot")
    placed.repartition("virtual_slot").drop("virtual_slot").write.partitionBy("shard").parquet(path)
