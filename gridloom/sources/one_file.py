"""One file in order, written by many tasks: each writes the bytes of its range of rows, then these are put together.

Spark's text writer gives a part for each range of rows, committed as usual, so that a task that is run again leaves one.
A prefix sum of the parts' lengths tells where each belongs. On a file system that tasks can write to by place, tasks copy
their parts into one file at once, the same bytes at the same place however often; where the file system joins files by
itself (HDFS), it does; elsewhere the driver passes the bytes on in blocks. The file gets its name when it is whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import guarded
from . import files

#: Bytes that are copied at once.
BLOCK = 8 << 20


def write_file(records: DataFrame, path: str, between: str = "\n", head: str = "", tail: str = "") -> int:
    """Write the single string column of ``records``, in the order of its partitions, as one file; its length in bytes.

    ``between`` stands between records, ``head`` and ``tail`` around them all; without records there are only these two.
    Null records are empty ones. A file that was there before is replaced when the new one is whole.
    """
    spark = records.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{target.getParent().toString()}/_parts-{uuid.uuid4().hex}"
    text = records.select(F.coalesce(F.col(records.columns[0]), F.lit("")).alias("value"))
    text.write.option("lineSep", between).text(f"{staging}/rows")
    parts = sorted((s.getPath().toString(), s.getLen()) for s in system.listStatus(hadoop.Path(f"{staging}/rows")) if s.getPath().getName().startswith("part-") and s.getLen())
    if parts:  # what stands after the last record does not stand between two
        parts[-1] = (parts[-1][0], parts[-1][1] - len(between.encode()))
    files.put_file(spark, f"{staging}/head", head.encode())
    files.put_file(spark, f"{staging}/tail", tail.encode())
    parts = [(f"{staging}/head", len(head.encode())), *parts, (f"{staging}/tail", len(tail.encode()))]
    whole = hadoop.Path(f"{staging}/whole")
    length = sum(n for _, n in parts)
    address = files.reachable(spark, f"{staging}/whole")
    if address and address.startswith("file:"):
        _copy_by_place(spark, parts, unquote(urlparse(address).path), length)
    else:
        _joined(spark, system, parts, whole)
    if system.exists(target):
        system.delete(target, True)
    system.rename(whole, target)
    system.delete(hadoop.Path(staging), True)
    return length


def _copy_by_place(spark: SparkSession, parts: list[tuple[str, int]], whole: str, length: int) -> None:
    """Tasks copy their parts to where they belong in a file on a file system that all of them share."""
    with open(whole, "wb") as out:
        out.truncate(length)
    starts = [0, *accumulate(n for _, n in parts)]
    rows = [(unquote(urlparse(p).path), n, at) for (p, n), at in zip(parts, starts, strict=False) if n]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(part, "rb") as data, open(whole, "r+b") as out:
                    out.seek(at)
                    while n and (block := data.read(min(n, BLOCK))):
                        out.write(block)
                        n -= len(block)
                    out.flush()
                    os.fsync(out.fileno())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    if rows:
        dealt = spark.createDataFrame(rows, "part string, n long, at long").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
        dealt.mapInArrow(copy, "n long").agg(F.sum("n")).collect()


def _joined(spark: SparkSession, system, parts: list[tuple[str, int]], whole) -> None:
    """The file system's own joining of whole files where it has it, else the driver's copying of blocks."""
    hadoop, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    cut = [(hadoop.Path(p), n) for p, n in parts if n]
    if cut and all(system.hasPathCapability(whole, f"fs.capability.paths.{c}") for c in ("concat", "truncate")):
        for p, n in cut:
            if n < system.getFileStatus(p).getLen():
                system.truncate(p, n)
        system.create(whole, True).close()
        paths = spark.sparkContext._gateway.new_array(hadoop.Path, len(cut))
        for i, (p, _) in enumerate(cut):
            paths[i] = p
        system.concat(whole, paths)
        return
    out = system.create(whole, True)
    try:
        for p, n in cut:
            data = system.open(p)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(data, out, 0, n)
            finally:
                data.close()
    finally:
        out.close()


def _ordered(df: DataFrame, rid: str) -> tuple[DataFrame, list[str]]:
    return (df.orderBy(rid) if rid in df.columns else df), [c for c in df.columns if c != rid]


def _cell(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _csv(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _quoted(c: Column) -> Column:
    """A text as JSON writes it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _first(df: DataFrame, column: Column) -> str:
    return df.sparkSession.range(1).select(column).first()[0]


def write_csv(df: DataFrame, path: str, rid: str = "__rid") -> int:
    """One CSV file: the header and the rows by ordinal, each cell guarded against being read as a formula, quoted where it must be."""
    rows, names = _ordered(df, rid)
    line = lambda columns: F.concat_ws(",", *[_csv(guarded(c)) for c in columns])
    head = _first(df, line([F.lit(n) for n in names])) if names else ""
    some = rows.select(line([_cell(n) for n in names]).alias("value"))
    return write_file(some, path, head=head + "\n" if names and not rows.isEmpty() else head)


def write_json(df: DataFrame, path: str, rid: str = "__rid") -> int:
    """One JSON file: an array of an object of texts for each row, in order, indented by two."""
    rows, names = _ordered(df, rid)
    if rows.isEmpty():
        return write_file(rows.select(F.lit("").alias("value")), path, head="[]")
    keys = [_first(df, _quoted(F.lit(n))) for n in names]
    pairs = [F.concat(F.lit(f"    {k}: "), _quoted(_cell(n))) for k, n in zip(keys, names, strict=True)]
    return write_file(rows.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *pairs), F.lit("\n  }")).alias("value")), path, between=",\n", head="[\n", tail="\n]")


def write_text(df: DataFrame, path: str, rid: str = "__rid", sep: str = "\t") -> int:
    """One text file: the header and the rows in order, cells joined by tabs and as they are."""
    rows, names = _ordered(df, rid)
    head = sep.join(names)
    return write_file(rows.select(F.concat_ws(sep, *[_cell(n) for n in names]).alias("value")), path, head=head + "\n" if not rows.isEmpty() else head)


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> int:
    """One text file of the texts of a column, in order, one after the other."""
    return write_file((df.orderBy(order) if order else df).select(_cell(column).alias("value")), path)


#: Writers by kind.
WRITERS = {"CSV": write_csv, "JSON": write_json, "TXT": write_text}
