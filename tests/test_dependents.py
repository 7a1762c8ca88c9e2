"""Dependents over a table of references equal a plain search."""

import random

import pytest

from gridloom.operators import dependents, formula


def name(r, c):
    return f"{chr(65 + c)}{r + 1}"


def test_buckets_make_up_intervals():
    for low in range(0, 40):
        for high in range(low - 1, 45):
            got = [x for level, n in dependents.buckets(low, high) for x in range(n << level, (n + 1) << level)]
            assert got == list(range(low, high + 1)) and len(dependents.buckets(low, high)) <= 12


@pytest.mark.parametrize("block", [1, 8, 32_768])
def test_equals_a_plain_search(spark, block):
    rng = random.Random(block)
    cells = {}
    for r in range(40):
        for c in range(4):
            a, b = sorted(rng.randrange(40) for _ in range(2))
            cells[r, c] = rng.choice(["5", "", "=1+2", "=", f"={name(rng.randrange(40), rng.randrange(4))}*2", f"=SUM({name(a, 0)}:{name(min(b, a + 5), 1)})+{name(a, 2)}", f"={name(r, c)}"])
    edits = {(rng.randrange(40), rng.randrange(5)) for _ in range(2)}
    frame = spark.createDataFrame([(s, r, c, t, 1, True) for s in ("a", None) for (r, c), t in cells.items()] + [("a", None, 1, "=A1", 1, True)], "sheet string, row int, col int, input string, block int, open boolean")
    changed = spark.createDataFrame([("a", r, c) for r, c in edits] * 2 + [("zz", 0, 0), ("a", None, 0)], "sheet string, row int, col int")
    got = dependents.dependents(frame, changed, block).collect()
    want = formula.dependents(cells, edits)
    assert sorted((r.sheet, r.row, r.col) for r in got) == sorted(("a", r, c) for r, c in want) and want
    assert dependents.dependents(frame, changed.limit(0), block).count() == 0


def test_a_long_chain_takes_as_many_rounds_as_blocks(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(dependents, "cut", lambda df, cut=dependents.cut: rounds.append(1) or cut(df))
    n = 200_000
    cells = spark.range(1, n).selectExpr("'s' as sheet", "cast(id as int) as row", "explode(array(0, 1)) as col", "id").selectExpr("sheet", "row", "col", "if(col = 0, concat('=A', id, '+1'), '=SUM(A1:A10)') as input")
    got = dependents.dependents(cells, spark.createDataFrame([("s", n // 2, 0)], "sheet string, row int, col int"))
    assert got.count() == n - 1 - n // 2 and len(rounds) <= 6
