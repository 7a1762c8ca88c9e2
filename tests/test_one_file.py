"""One ordered file written by many tasks is byte for byte what one writer would write."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from gridloom.plans import workflow
from gridloom.sources import files, one_file

ROWS = [(i, f'é "{i}", {"x" * (i % 7)}\nnext' if i % 3 else f"plain {i}", None if i % 5 == 0 else f"/{i}\t\x01") for i in range(997)]
CELLS = [[n, t or ""] for _, n, t in ROWS]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "__rid long, name string, `t.x` string").repartition(7, F.xxhash64("__rid"))


@pytest.mark.parametrize("near", [True, False])
def test_kinds(spark, table, tmp_path, monkeypatch, near):
    if not near:  # a file system that tasks do not reach
        monkeypatch.setattr(files, "reachable", lambda *a: None)
    for kind in ("csv", "json", "txt"):
        path = tmp_path / f"out.{kind}"
        path.write_text("what was there before")
        files.write_table(table, str(path), kind.upper())
        data = path.read_bytes()
        if kind == "txt":
            assert data == "\n".join("\t".join(r) for r in [["name", "t.x"], *CELLS]).encode()
        elif kind == "csv":
            assert data == "\n".join(files.csv_line(r) for r in [["name", "t.x"], *CELLS]).encode()
            assert list(csv.reader(data.decode().splitlines(keepends=True)))[1] == CELLS[0]
        else:
            assert json.loads(data) == [{"name": n, "t.x": t} for n, t in CELLS]
            assert data.decode().startswith('[\n  {\n    "name": "plain 0",\n    "t.x": ""\n  },\n  {\n') and data.endswith(b'"\n  }\n]')
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out.csv", "out.json", "out.txt"]


def test_no_rows_and_guards(spark, table, tmp_path):
    for kind, want in (("csv", b"name,t.x"), ("json", b"[]"), ("txt", b"name\tt.x")):
        files.write_table(table.limit(0), str(tmp_path / f"o.{kind}"), kind.upper())
        assert (tmp_path / f"o.{kind}").read_bytes() == want
    one_file.write_csv(spark.createDataFrame([("=1+1", "-5")], "`=a` string, b string"), str(tmp_path / "g.csv"))
    assert (tmp_path / "g.csv").read_text() == "'=a,b\n'=1+1,-5"
    assert one_file.write_file(spark.createDataFrame([], "v string"), str(tmp_path / "e.txt"), head="<", tail=">") == 2 and (tmp_path / "e.txt").read_text() == "<>"


def test_many_tasks_and_parts_that_are_written_again(spark, tmp_path):
    many = spark.range(50_000).select(F.concat(F.lit("line "), "id").alias("v")).repartitionByRange(16, F.length("v"), "v")
    ordered = many.orderBy(F.expr("cast(substring(v, 6) as long)"))
    one_file.write_file(ordered, str(tmp_path / "a.txt"))
    want = "\n".join(f"line {i}" for i in range(50_000))
    assert (tmp_path / "a.txt").read_text() == want
    # The same part copied again changes nothing.
    (tmp_path / "p").write_text("abc")
    (tmp_path / "w").write_text("")
    for _ in range(2):
        one_file._copy_by_place(spark, [(f"file:{tmp_path}/p", 3), (f"file:{tmp_path}/p", 2), (f"file:{tmp_path}/p", 0)], str(tmp_path / "w"), 5)
        assert (tmp_path / "w").read_text() == "abcab"


def test_workflow_exports(spark, tmp_path):
    steps = lambda kind, path: [workflow.Step("PASTE_TEXT", "one\ntwo, three"), workflow.Step(kind, options={"path": str(tmp_path / path)})]
    workflow.run(spark, steps("EXPORT_TXT", "a.txt"))
    workflow.run(spark, steps("EXPORT_CSV", "a.csv"))
    assert (tmp_path / "a.txt").read_text() == "one\ntwo, three" and (tmp_path / "a.csv").read_text() == 'Text\none\n"two, three"'
