"""A job history that is written: a Parquet table by days, of which a change rewrites only the days that it touches.

Rows lie in a folder for the day of their ``timestamp`` (milliseconds, UTC). A change works out the new rows of the days
that it touches, writes those aside, and puts them in place by dynamic partition overwrite; days that lose all rows are
dropped as folders. One writer at a time; a reader that lists a day while it is replaced may have to read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, written

DAY_MS = 86_400_000


def day_of(timestamp: Column) -> Column:
    """The number of a time's day since 1970; rows without a time are in day -1."""
    return F.coalesce(F.floor(timestamp / DAY_MS).cast("int"), F.lit(-1))


class HistoryTable:
    """Runs at ``path`` with the columns of ``schema``, of which ``id`` tells rows apart and ``timestamp`` their time."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._system.mkdirs(at)

    def rows(self) -> DataFrame:
        """All rows as they are now; the day is the column ``day``, by which reads are pruned."""
        return self.spark.read.schema(f"{self.schema}, day int").parquet(self.path)

    def insert(self, more: DataFrame) -> list[int]:
        """Add rows; one whose id is in the table replaces that row, so a batch that is run again changes nothing.

        Columns go by name, those that ``more`` lacks are null; of rows of ``more`` with one id the newest counts. The days touched.
        """
        empty = self.spark.createDataFrame([], self.schema)
        named = empty.unionByName(more.select(*[c for c in empty.columns if c in more.columns]), allowMissingColumns=True)
        latest = Window.partitionBy("id").orderBy(F.desc("timestamp"), F.xxhash64(*empty.columns))
        new = cut(named.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n").withColumn("day", day_of(F.col("timestamp"))))
        # A row keeps its day unless its time changes: then its old day is touched too.
        moved = self.rows().join(new.select("id"), "id", "left_semi").select("day")
        return self._replace(new.select("day").unionAll(moved), lambda old: old.join(new.select("id"), "id", "left_anti").unionByName(new))

    def insert_batch(self, batch: DataFrame, batch_id: int) -> None:
        """``insert`` for ``foreachBatch``."""
        self.insert(batch)

    def update(self, which: Column, **changes) -> list[int]:
        """Set columns where ``which`` holds; times are not changed. The days touched."""
        if "timestamp" in changes or "id" in changes:
            raise ValueError("id and timestamp stay; insert the row again with another time")
        set_to = {c: F.when(which, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}
        return self._replace(self.rows().where(which).select("day"), lambda old: old.withColumns(set_to))

    def delete(self, which: Column) -> list[int]:
        """Drop the rows where ``which`` holds. The days touched."""
        return self._replace(self.rows().where(which).select("day"), lambda old: old.where(~F.coalesce(which, F.lit(False))))

    def expire(self, cutoff_ms: int) -> list[int]:
        """Drop what is older than a time: whole days by their folder, without being read, and the rows of the day of the cutoff."""
        day = cutoff_ms // DAY_MS
        old = [d for d in self.days() if 0 <= d < day]
        self._drop(old)
        return sorted({*old, *self.delete((F.col("day") == day) & (F.col("timestamp") < cutoff_ms))})

    def keep_newest(self, keep: int) -> list[int]:
        """Drop all but the ``keep`` newest rows, by time and id. Only the counts of days and the rows of one day are looked at."""
        left, last, old = keep, None, []
        counts = self.rows().groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day")).collect()  # a row for each day
        for r in counts:
            if left <= 0:
                old.append(r["day"])
            elif r["n"] > left:
                last = (r["day"], left)
            left -= r["n"]
        self._drop(old)
        if last is None:
            return sorted(old)
        own = self.rows().where(F.col("day") == last[0])
        kept = cut(own.orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("id")).limit(last[1]).select("id"))
        return sorted({*old, *self._replace(own.select("day").limit(1), lambda rows: rows.join(kept, "id", "left_semi"))})

    def clear(self) -> list[int]:
        """Drop all rows."""
        days = self.days()
        self._drop(days)
        return days

    def days(self) -> list[int]:
        """The days that have a folder."""
        found = self._system.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))
        return sorted(int(name[4:]) for name in (s.getPath().getName() for s in found) if name.startswith("day="))

    def _replace(self, days: DataFrame, change) -> list[int]:
        touched = sorted(r["day"] for r in days.distinct().collect())  # a row for each day
        if touched:
            new = written(change(self.rows().where(F.col("day").isin(touched))), "history")
            # A day's rows are in a few files, as many as its share of the tasks.
            new.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
            left = {r["day"] for r in new.select("day").distinct().collect()}
            self._drop([d for d in touched if d not in left])
        return touched

    def _drop(self, days: list[int]) -> None:
        for d in days:
            self._system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={d}"), True)
