"""Tables in files of any of the known formats: CSV in splits, of the others one file is parsed by one task, all files of a folder at once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, splits


def _text(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)


def json_rows(text: str) -> list[list[str]]:
    """A list of objects (or one) as rows: the header has the keys in the order in which they are first seen."""
    found = json.loads(text) if text.strip() else []
    objects = [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    header = list(dict.fromkeys(k for x in objects for k in x))
    return [header, *([_text(x.get(k)) for k in header] for x in objects)] if header else []


def rows_of(name: str, data: bytes) -> list[list[str]]:
    """The rows of a file by its name's extension, the header first; delimiters and encodings are found out."""
    kind = files.format_of(name)
    if kind == "XLSX":
        return files.xlsx_rows(data)
    text = files.decode_text(data)
    if kind == "JSON":
        return json_rows(text)
    if kind == "TXT":
        return [["Text"], *([x] for x in text.splitlines() if x)]
    return files.parse_csv(text)


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, n, cells): the rows of all files under a path, numbered within their file; row 0 is the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = rows_of(name, data.as_py())
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.list_(pa.string()))], names=["path", "n", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, n int, cells array<string>")


def as_table(rows: DataFrame, rid: str = "__rid") -> DataFrame:
    """Rows of files as one table of strings with ordinals, by path and row.

    Columns go by their place and have the names of the first file by path; short rows are padded, longer ones widen the table.
    """
    first = rows.where("n = 0").orderBy("path").limit(1).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"{rid} long")
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    names = files.unique_names(list(first["cells"]) + [""] * (width - len(first["cells"])))
    body = rows.where("n > 0").orderBy("path", "n").withColumn(rid, F.monotonically_increasing_id())
    return body.select(rid, *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_table(spark: SparkSession, path: str, rid: str = "__rid") -> DataFrame:
    """The files under a path as one table of strings with ordinals: CSV files in splits, matched by name; those of other formats by place.

    A folder with CSV and other files has the CSV files' rows and columns first, the others' by name after them.
    """
    found = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # the list that Spark's driver keeps
    csv = [p for p in found if files.format_of(p) == "CSV"]
    if len(csv) == len(found):
        return splits.read_table(spark, path, rid)
    if not csv:
        return as_table(read_rows(spark, path), rid)
    rest = as_table(read_rows(spark, [p for p in found if p not in set(csv)]), rid).withColumn(rid, F.col(rid) + F.lit(1 << 62))
    return splits.read_table(spark, csv, rid).unionByName(rest, allowMissingColumns=True).na.fill("")


def to_csv(spark: SparkSession, path: str, out: str) -> None:
    """Workbooks (or any tables) under a path as one table in CSV."""
    files.write_csv(read_table(spark, path), out)


def to_xlsx(spark: SparkSession, path: str, out: str, sheet: str = "Sheet1") -> int:
    """Tables under a path as workbooks in parts, each with the header; the number of parts."""
    table = read_table(spark, path)
    names = [c for c in table.columns if c != "__rid"]
    rows = table.orderBy("__rid").select(F.array(*[F.col(f"`{c}`") for c in names]).alias("cells"))
    return files.write_parts(rows, out, "xlsx", lambda held: files.xlsx_bytes({sheet: [names, *held]}))


def within(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """(path, length, modificationTime) of the files that are not larger."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").where(F.col("length") <= most_bytes)


def stale(spark: SparkSession, path: str, before) -> DataFrame:
    """(path, length, modificationTime) of the files that were last written before a time."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").where(F.col("modificationTime") < F.lit(before))


def purge(spark: SparkSession, path: str, before) -> int:
    """Delete the files under a path that were last written before a time; their number. Names go to the driver one at a time."""
    hadoop, count = spark._jvm.org.apache.hadoop.fs, 0
    for r in stale(spark, path, before).select("path").toLocalIterator():
        at = hadoop.Path(r["path"])
        count += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    return count
