"""What several operators share: the checkpoint folder, lineage cuts, texts and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset and all is on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, *keys: str, then=lambda dealt: dealt) -> DataFrame:
    """``df`` dealt by keys, with what ``then`` makes of it there, written to the shared checkpoint folder; later joins and groups by these keys do not deal it again.

    Only a plan that is not adapted while it runs tells how its rows are dealt.
    """
    spark = df.sparkSession
    name, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(name, "false")
    try:
        return cut(then(df.repartition(shuffle_partitions(spark), *keys)))
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, on any file system that Spark opens."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def whole(text: str = "text"):
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label the nodes of ``edges`` (a, b) with the smallest node of their connected component: (node, root).

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, over to
    the smallest node that it knows, until nothing changes; the number of rounds grows with the logarithm of the longest
    path. A node with very many neighbours costs one row for each, never a pair of neighbours, and its minimum comes from
    an aggregate with partial sums, so that no task has to hold a neighbourhood. Each round is checkpointed.
    Nulls and loops are ignored; no edges give no rows.
    """
    cur = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        cur = cut(small.distinct())
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            stars = cur.groupBy("u").agg(F.min("v").alias("root"))
            return stars.select(F.col("u").alias("node"), "root").unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def running(df: DataFrame, keys: list[str], order: list, part, amount, out: str, kind=F.sum) -> DataFrame:
    """``out``: sum (or maximum) of ``amount`` over the rows before a row in its group of ``keys``, null before the first.

    ``part`` numbers the ranges into which the order of a group is cut, so that no task has to hold a group: it must not
    fall along ``order``. The ranges' totals are gathered first, then each range on its own. Rows that are equal in
    ``order`` come in any order. ``keys`` must not be null.
    """
    df = df.withColumn("_part", part).withColumn("_amount", amount)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_part").agg(kind("_amount").alias("_total"))
    totals = totals.select(*keys, "_part", kind("_total").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = (F.col("_before"), kind("_amount").over(inside))
    total = F.greatest(*both) if kind is F.max else F.coalesce(both[0] + both[1], *both)
    return df.join(totals, [*keys, "_part"]).withColumn(out, total).drop("_part", "_amount", "_before")


def once(shared, make):
    """What ``make`` builds from a broadcast, built once in a worker, which keeps the broadcast between its tasks."""
    if not hasattr(shared, "made"):
        shared.made = make(shared.value)
    return shared.made


def staged(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet into the shared checkpoint folder; the path, which stays until it is removed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again."""
    return df.sparkSession.read.schema(df.schema).parquet(staged(df, name))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, which is counted, and else as it is."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(df: DataFrame, side: DataFrame, key: str, weight: str, hot: int = 1000) -> DataFrame:
    """``df`` joined with ``side``, which has one row for each value of ``key`` and in ``weight`` how many rows of ``df`` have it.

    Values that one in ``hot`` of all rows have, of which there are as many at most, are broadcast, so that no task gets
    all rows of a frequent value; the others are joined by shuffling.
    """
    side = cut(side)
    total = side.agg(F.sum(weight)).first()[0] or 0
    frequent = F.broadcast(side.where(F.col(weight) * hot >= total).drop(weight))
    rest = df.join(frequent.select(key), key, "left_anti").join(side.where(F.col(weight) * hot < total).drop(weight), key)
    both = df.join(frequent, key)
    return both.unionByName(rest)


def tidy() -> None:
    """Give memory that a worker no longer needs back to the system, at the end of a task: idle workers keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Index:
    """Numbers of 64-bit keys by open addressing in numpy arrays: many look-ups at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several in one slot the last stays
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            slot, left = (slot[~won] + 1) & ((1 << self.bits) - 1), left[~won]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not there."""
        slot = self._slot(keys)
        got = self.at[slot]
        out = np.where((got >= 0) & (self.keys[slot] == keys), got, -1)
        left = np.flatnonzero((got >= 0) & (out < 0))
        while len(left):
            slot = (slot if len(slot) == len(left) else slot[left]) + 1 & ((1 << self.bits) - 1)
            got = self.at[slot]
            hit = (got >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = got[hit]
            more = (got >= 0) & ~hit
            slot, left = slot[more], left[more]
        return out


def rolled(points: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` code points, by window start; equal windows have equal hashes."""
    n = max(0, len(points) - length + 1)
    h = np.full(n, np.uint64(length))
    for j in range(length):
        h = h * np.uint64(0x100000001B3) + points[j : j + n]
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
