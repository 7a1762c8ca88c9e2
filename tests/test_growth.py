"""What broke on larger tables: joins by their plans, texts at the edges of words, work done more than once by counting it."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom import catalog
from gridloom.functions import cells
from gridloom.operators import dedupe, dependents, formula, invoices, receipt_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_rows_are_never_sent_whole_to_everyone(spark, tmp_path):
    spark.range(500).write.parquet(f"{tmp_path}/ids")
    names = spark.read.parquet(f"{tmp_path}/ids").selectExpr("id as rid", "md5(string(id)) as key")
    assert "Broadcast" not in plan(dedupe._pairs(names, 0.92))
    long = names.selectExpr("rid", "repeat(key, 10) as key")
    assert "Broadcast" not in plan(dedupe._pairs(long, 0.92))


def test_long_numbers_end_at_ascii_words(spark):
    texts = ["4111 1111 1111 1111 Éa", "4111 1111 1111 1111é", "é4111 1111 1111 1111", "x4111111111111111", "4111-1111-1111-1111-x", "4111 1111 1111 1111"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cells.masked(F.col("t")).alias("m")).orderBy("i")
    assert [r.m for r in made.collect()] == ["••••1111 Éa", "••••1111é", "é••••1111", "x4111111111111111", "••••1111x", "••••1111"]


def sums_in_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


def _invoices(spark):
    item = f"cast(array(struct('a', '2', '(3.50)', ''), struct('b', '', '$4', ' 8 '), struct('c', '1', 'x', 'NaN')) as array<{invoices.ITEM}>) as items"
    return spark.range(3).selectExpr("id", item, "if(id = 0, ' ', '1,000.5') as subtotal", "if(id = 1, '', ' 2.25') as tax", "if(id = 1, '1002', '') as total")


def test_gaps_read_the_items_once(spark):
    made = invoices.fill_gaps(_invoices(spark)).select("id", "subtotal", "tax", "total", "items.amount", "items.quantity").orderBy("id")
    assert sums_in_plan(made) == 1
    assert [tuple(r) for r in made.collect()] == [(0, "", " 2.25", "", ["-7.00", " 8 ", "NaN"], ["2", "2.00", "1"]), (1, "1,000.5", "1.50", "1002", ["-7.00", " 8 ", "NaN"], ["2", "2.00", "1"]), (2, "1,000.5", " 2.25", "1002.75", ["-7.00", " 8 ", "NaN"], ["2", "2.00", "1"])]


def test_checks_read_the_items_once(spark):
    made = invoices.checked(_invoices(spark)).select("id", "items_review", "totals_review").orderBy("id")
    assert sums_in_plan(made) == 1
    assert [r.totals_review for r in made.collect()] == [False, False, False]


def test_formulas_that_come_again_are_read_once(monkeypatch):
    read, asked = formula.parse, []
    monkeypatch.setattr(formula, "parse", lambda text: asked.append(text) or read(text))
    for n in range(50):
        cells_ = {(0, 0): str(n), (1, 0): "²", (0, 1): "=ROUND(SUM(A1,A1)+0*0,0)", (0, 2): "=IF(", (0, 3): "=A2*1"}
        got = [formula.shown(formula.Sheet(cells_).value((0, c))) for c in (1, 2, 3)]
        assert got == [str(2 * n), "#NAME?", "#VALUE!"]
    assert asked.count("ROUND(SUM(A1,A1)+0*0,0)") == 1


def test_formulas_are_worked_out_once_for_the_same_inputs(monkeypatch):
    root, asked = formula.FUNCTIONS["SQRT"], []
    monkeypatch.setitem(formula.FUNCTIONS, "SQRT", lambda args: asked.append(args) or root(args))
    formula._result.cache_clear()
    for n in range(60):
        inputs = {(0, 0): str(n % 3), (1, 0): "1.0" if n % 2 else "TRUE", (0, 1): "=SQRT(A1)&A2", (0, 2): "=B1+1", (0, 3): "=D1", (0, 4): "=SQRT(A1:A1)"}
        if n % 2:
            del inputs[0, 0]
        sheet = formula.Sheet(inputs)
        x = formula.shown(0.0 if n % 2 else math.sqrt(n % 3))
        assert [formula.shown(sheet.value((0, c))) for c in (1, 3)] == [x + ("1" if n % 2 else "TRUE"), "#CIRCULAR!"]
    assert len(asked) == 4
    assert formula.shown(formula.Sheet({(0, 0): "=2+2", (0, 1): "=SQRT(A1)"}).value((0, 1))) == "2"
    formula._result.cache_clear()


def test_rows_of_sheets_are_neither_joined_nor_put_into_fewer_tasks(spark):
    some = [("a", 5, 3, "x"), ("a", 2, 1, "y"), ("a", 2, 2, " "), ("a", 9, 9, " "), ("a", 0, 0, ""), ("a", 3, 0, " "), ("a", 3, 2, " "), ("b", 7, 7, "z"), ("c", 1, 1, " "), ("", 0, 0, "u"), ("", 0, 1, None)]
    cells_ = spark.createDataFrame(some, "sheet string, row int, col int, input string").withColumn("display", F.concat("input", F.lit("!")))
    made = formula.sheet_rows(cells_)
    assert "Join" not in plan(made) and made.rdd.getNumPartitions() == 4
    got = {(r.sheet, r.row): r.cells for r in made.collect()}
    assert got == {("a", 2): ["y!", " !", ""], ("a", 3): ["", " !", ""], ("a", 4): [""] * 3, ("a", 5): ["", "", "x!"], ("b", 7): ["z!"], ("", 0): ["u!"]}


def test_addresses_of_a_small_table_are_dealt_to_all_tasks(spark):
    made = catalog.QUERIES["public_urls"](spark, "/root/testdata/sf0.001")
    assert "Exchange" in plan(made)


def test_scans_are_read_by_columns(spark):
    ints = [(k, pa.int32()) for k in ("left", "top", "right", "bottom")]
    kind = pa.list_(pa.struct([("text", pa.string()), ("top", pa.int32()), ("bottom", pa.int32()), ("words", pa.list_(pa.struct([("text", pa.string()), *ints])))]))
    word = lambda t, x: {"text": t, "left": x, "top": 0, "right": x + 40, "bottom": 20}
    line = lambda text, words: {"text": text, "top": 0, "bottom": 20, "words": words}
    scans = pa.array([[line("no", [word("no", 0)])], None, [line("Tea 4.00", [word("Tea", 0), word("4.00", 200)]), line(None, None)], [], [line("x", [word(None, 0), word("x", 45)])]], kind)
    read = [[(x.text, x.height, [(c.text, c.left, c.right) for c in x.cells]) for x in lines] for lines in receipt_tables.scanned(scans.slice(1))]
    assert read == [[], [("Tea 4.00", 20, [("Tea", 0, 40), ("4.00", 200, 240)]), ("", 20, [])], [], [("x", 20, [(" x", 0, 85)])]]
    assert "Pandas" not in plan(receipt_tables.extract(spark.range(1).selectExpr("id as doc_id", "'' as text", f"cast(null as {receipt_tables.LINES}) as lines")))


def test_texts_that_begin_like_no_number_are_not_cast_as_they_stand(spark):
    texts = ["", " ", "$4", " 8 ", "\t-1e3", "(2)", "NaN", "-Infinity", ".5", "+.5", "x1", "1x", "\u00a07", "1,000.5", "Rs. 3", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cells.parse_number("t").alias("x"), F.expr("try_cast(t as double)").alias("plain")).orderBy("i").collect()
    assert [str(r.x) for r in made] == ["None", "None", "4.0", "8.0", "-1000.0", "-2.0", "nan", "-inf", "0.5", "0.5", "None", "None", "7.0", "1000.5", "3.0", "None"]
    assert all(str(r.x) == str(r.plain) for r in made if r.plain is not None)


def test_formulas_of_a_small_table_are_read_by_all_tasks(spark, tmp_path):
    spark.range(1, 40).selectExpr("'s' as sheet", "id as row", "0 as col", "concat('=B', id) as input").coalesce(1).write.parquet(f"{tmp_path}/cells")
    made = dependents.named(spark.read.parquet(f"{tmp_path}/cells"))
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted((r.row, r.top, r.left) for r in made.collect()) == [(i, i - 1, 1) for i in range(1, 40)]
