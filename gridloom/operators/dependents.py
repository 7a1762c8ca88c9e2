"""Which formulas have to be worked out again after edits: a transitive closure over a table of references.

A reference is an interval of rows and columns that a formula names. References are dealt to blocks of rows, and so is the
frontier, the cells that have changed: a round meets each block's frontier with its references, goes on inside the block
as far as it can, and hands on only those cells that lie in other blocks. So a chain of formulas down a column takes as
many rounds as it has blocks and not as it has cells, a block is one task's work, and a sheet is as many tasks as blocks.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula import references
from .lineage import cut, spread, written

#: Rows of a block.
BLOCK = 32_768
CELL = ["sheet", "row", "col"]


def named(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, top, left, bottom, right): each interval that a formula of (sheet, row, col, input) names, once."""

    def run(batches):
        for batch in batches:
            rows = [(s, r, c, *interval) for s, r, c, text in zip(*(batch[k] for k in (*CELL, "input")), strict=True) for interval in dict.fromkeys(references(text))]
            yield pd.DataFrame(rows, columns=[*CELL, "top", "left", "bottom", "right"])

    formulas = cells.where(F.col("input").startswith("=") & (F.length("input") > 1) & F.col("row").isNotNull() & F.col("col").isNotNull())
    typed = formulas.select(F.coalesce(F.col("sheet").cast("string"), F.lit("")).alias("sheet"), F.col("row").cast("long"), F.col("col").cast("long"), "input")
    return spread(typed).mapInPandas(run, "sheet string, row long, col long, top long, left long, bottom long, right long")


def buckets(low: int, high: int) -> list[tuple[int, int]]:
    """(level, number) of the fewest intervals of a power of two, each starting at a multiple of its length, that make up low to high."""
    out = []
    while low <= high:
        level = (low & -low).bit_length() - 1 if low else (high + 1).bit_length() - 1
        while low + (1 << level) - 1 > high:
            level -= 1
        out.append((level, low >> level))
        low += 1 << level
    return out


def reached(block_rows: int):
    """The cells that the frontier of a block reaches by the references of that block, and whether they lie in others."""

    def search(key, frontier: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        sheet, block = str(key[0]), int(key[1])
        # A cell is in one bucket of each level: looking up a column's levels finds all intervals that hold it.
        index, levels = defaultdict(list), defaultdict(set)
        for r, c, top, left, bottom, right in refs[["row", "col", "top", "left", "bottom", "right"]].itertuples(index=False, name=None):
            for level, number in buckets(max(top, block * block_rows), min(bottom, (block + 1) * block_rows - 1)):
                for column in range(left, right + 1):
                    index[column, level, number].append((r, c))
                    levels[column].add(level)
        todo = list(zip(frontier["row"].tolist(), frontier["col"].tolist(), strict=True))
        seen, out = set(todo), []
        while todo:
            r, c = todo.pop()
            for level in levels.get(c, ()):
                for cell in index.get((c, level, r >> level), ()):
                    if cell not in seen:
                        seen.add(cell)
                        inside = cell[0] // block_rows == block
                        out.append((sheet, *cell, not inside))
                        if inside:
                            todo.append(cell)
        return pd.DataFrame(out, columns=[*CELL, "open"])

    return search


def dependents(cells: DataFrame, edits: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(sheet, row, col) of the formulas of ``cells`` that name a cell of ``edits`` (sheet, row, col), or one that does, and so on.

    Edited cells themselves are left out. Null sheets are one sheet, cells without row or column are left out; cells that
    name themselves or one another are found once; rows that repeat a cell or an edit count once. No edits give no rows.
    Each round writes what it found; rounds go on until no cell lies in another block.
    """
    if block_rows & (block_rows - 1):
        raise ValueError("rows of a block must be a power of two")
    block = lambda c: F.floor(F.col(c) / block_rows).cast("long")
    refs = named(cells).withColumn("block", F.explode(F.sequence(block("top"), block("bottom"))))
    refs = written(refs.repartition("sheet", "block"), "references")
    first = edits.select(F.coalesce(F.col("sheet").cast("string"), F.lit("")).alias("sheet"), F.col("row").cast("long"), F.col("col").cast("long")).where("row is not null and col is not null").distinct()
    done = cut(first)
    frontier, found = done, []
    while True:
        at = frontier.withColumn("block", block("row"))
        asked = refs.join(at.select("sheet", "block").distinct(), ["sheet", "block"], "left_semi")
        met = at.groupBy("sheet", "block").cogroup(asked.groupBy("sheet", "block")).applyInPandas(reached(block_rows), "sheet string, row long, col long, open boolean")
        # A cell that its own block has gone on from need not be handed on by another.
        new = cut(met.groupBy(*CELL).agg(F.min("open").alias("open")).join(done, CELL, "left_anti"))
        found.append(new.select(*CELL))
        frontier = new.where("open").select(*CELL)
        if frontier.isEmpty():
            break
        done = done.unionAll(new.select(*CELL))
        if len(found) % 20 == 0:  # else the plan grows with the rounds
            done, found = cut(done), [cut(_all(found))]
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
