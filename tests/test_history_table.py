"""A history that is written rewrites only the days that a change touches; failed files are tried again in later batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gridloom.operators.history_table import DAY_MS, HistoryTable
from gridloom.sources import tables
from gridloom.streaming import batches

SCHEMA = "id bigint, feature string, status string, timestamp bigint"


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def days_changed(before, after):
    return sorted({int(f.split("day=")[1].split("/")[0]) for f, _ in set(before.items()) ^ set(after.items())})


@pytest.fixture
def table(spark, tmp_path):
    made = HistoryTable(spark, str(tmp_path / "h"), SCHEMA)
    # Ten rows on each of five days, and one without a time.
    rows = [(d * 10 + i, "A" if i % 2 else "B", "SUCCESS", d * DAY_MS + i * 1000) for d in range(5) for i in range(10)] + [(99, "B", "FAILED", None)]
    made.insert(spark.createDataFrame(rows, SCHEMA))
    return made


def ids(table):
    return sorted(r.id for r in table.rows().select("id").collect())


def test_each_change_touches_its_days_only(spark, table):
    path, everything = table.path, [*range(50), 99]
    assert ids(table) == everything and table.days() == [-1, 0, 1, 2, 3, 4]

    def changed(work):
        before = files(path)
        told = work()
        assert days_changed(before, files(path)) == told
        return told

    again = table.rows().where("id in (11, 12)").drop("day")
    assert changed(lambda: table.insert(again)) == [1] and ids(table) == everything
    assert changed(lambda: table.insert(spark.createDataFrame([(100, 2 * DAY_MS)], "id bigint, timestamp bigint"))) == [2] and ids(table) == [*everything, 100]
    # A row whose time has changed leaves its old day.
    assert changed(lambda: table.insert(spark.createDataFrame([(100, "A", "x", DAY_MS * 4)], SCHEMA))) == [2, 4] and table.rows().where("id = 100").first().day == 4
    assert changed(lambda: table.update(F.col("id") == 31, status="FAILED")) == [3] and table.rows().where("id = 31").first().status == "FAILED"
    assert changed(lambda: table.update(F.col("id") == 12345, status="FAILED")) == []
    assert changed(lambda: table.delete(F.col("id").isin(0, 49))) == [0, 4]
    assert changed(lambda: table.expire(DAY_MS + 5000)) == [0, 1] and ids(table) == [*range(15, 49), 99, 100]
    assert changed(lambda: table.keep_newest(21)) == [-1, 1, 2] and ids(table) == [*range(29, 49), 100]
    assert changed(lambda: table.insert(spark.createDataFrame([], SCHEMA))) == []
    with pytest.raises(ValueError, match="stay"):
        table.update(F.lit(True), timestamp=1)
    assert changed(table.clear) == [2, 3, 4] and ids(table) == []


def test_reads_of_one_day_are_pruned(table):
    plan = table.rows().where("day = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_file_that_fails_twice_is_tried_again_in_later_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "marks").mkdir()
    for name, text in (("good.txt", "Some fine words here."), ("later.txt", "Words that need three tries."), ("bad.txt", "never"), ("wrong.txt", "wrong")):
        (tmp_path / "in" / name).write_text(text)
    marks = str(tmp_path / "marks")

    def work(data):
        text = data.decode()
        tries = len([f for f in os.listdir(marks) if f.startswith(text[:5])])
        open(f"{marks}/{text[:5]}-{tries}-{time.time_ns()}", "w").close()
        if text == "wrong":
            raise ValueError("no use")
        if text == "never" or text.startswith("Words") and tries < 2:
            raise OSError("not now")
        return text

    table = HistoryTable(spark, str(tmp_path / "history"), "id bigint, feature string, inputLabel string, qualityScore int, status string, retryCount int, timestamp bigint")
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in")).select("path", "content")
    query = batches.run_retried(found, work, table, str(tmp_path / "checkpoint"), every="200 milliseconds", first_ms=100)
    try:
        until = time.time() + 90
        while time.time() < until and table.rows().count() < 4:
            time.sleep(0.5)
        batches_run = query.lastProgress["batchId"]
    finally:
        query.stop()
    got = {os.path.basename(r.inputLabel): (r.status, r.retryCount) for r in table.rows().collect()}
    assert got == {"good.txt": ("SUCCESS", 0), "later.txt": ("SUCCESS", 2), "bad.txt": ("FAILED", 2), "wrong.txt": ("FAILED", 0)}
    tries = [f[:5] for f in os.listdir(marks)]
    assert (tries.count("Some "), tries.count("Words"), tries.count("never"), tries.count("wrong")) == (1, 3, 3, 1) and batches_run >= 2


def test_purge(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("x")
    os.utime(tmp_path / "1.txt", (1000, 1000))
    assert tables.purge(spark, str(tmp_path), "2020-01-01") == 1 and sorted(os.listdir(tmp_path)) == ["0.txt", "2.txt"]
