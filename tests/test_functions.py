"""Published results of the cell functions, formulas and formats."""

import itertools
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.operators import cleaning, dedupe, emails, formula, invoices, records
from gridloom.plans import workflow
from gridloom.sources import files
from gridloom.streaming import batches


def values(spark, texts, made):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    return [r.v for r in frame.select("i", made(F.col("c")).alias("v")).orderBy("i").collect()]


def check(spark, table, made):
    assert values(spark, list(table), made) == list(table.values())


def test_dates(spark):
    both = {"2024-2-3": "2024-02-03", "13/02/24": "2024-02-13", "02/13/2024": "2024-02-13", "31.12.99": "1999-12-31", "5 Jan 2024": "2024-01-05", "Jan 5, 2024": "2024-01-05", "Sept 3 2021": "2021-09-03", "2024/1/5": "2024-01-05", "29/02/2024": "2024-02-29", "2024-02-30": None, "29/02/2023": None, "15-15-2024": None, "Foo 5, 2024": None, "": None, "0999-01-01": None}
    check(spark, both | {"05-06-2024": "2024-06-05", "1/2/30": "2030-02-01", "1/2/31": "1931-02-01"}, cells.normal_date)
    check(spark, both | {"05-06-2024": "2024-05-06", "1/2/30": "2030-01-02"}, lambda c: cells.normal_date(c, True))


def test_phones_money_numbers_booleans(spark):
    check(spark, {"(555) 123-4567": "5551234567", "+1 555 123 4567": "5551234567", "+91 98765 43210": "9876543210", "091-98765-43210": "9876543210", "12345": None, "2 555 123 4567": None}, cells.normal_phone)
    check(spark, {"$1,234.50": "1234.5", "(₹500)": "-500", "Rs. 99": "99", "1,200 USD": "1200", "€ 7.00": "7", "1-2": None, "--": None, "12 apples": "12"}, cells.normal_currency)
    check(spark, {"3 pcs": None, "(1,250.00)": -1250.0, "$5": 5.0, " ": None}, cells.parse_number)
    check(spark, {"Y": "Yes", " true ": "Yes", "1": "Yes", "n": "No", "F": "No", "0": "No", "maybe": None}, cells.normal_boolean)
    assert [r.v for r in spark.createDataFrame([(1.005, 2), (-2.5, 0)], "x double, d int").select(F.when(F.col("d") == 2, cells.format_number(F.col("x"))).otherwise(cells.format_number(F.col("x"), 0)).alias("v")).collect()] == ["1.00", "-2"]
    assert [r.v for r in spark.createDataFrame([(100.0, 101.0), (100.0, 102.0), (0.0, 0.02)], "a double, b double").select(cells.nearly(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True]


def test_safety_masks_quality(spark):
    check(spark, {"=1+1": "'=1+1", "@x": "'@x", "--5": "'--5", "-5": "-5", "+1 555 123 4567": "+1 555 123 4567", "-12-34": "-12-34", "-": "-"}, cells.guarded)
    check(spark, {"john.doe@x.com paid 4111 1111 1111 1111 ok": "j***@x.com paid ••••1111ok"}, cells.masked)
    check(spark, {"cmd|' /c calc'!A0": True, 'WEBSERVICE("http://x")': True, "SUM(A1:A3)": False}, cells.dangerous_formula)
    check(spark, {"hello": 77, "Hello world this is fine.": 100, "###": 44, "": 0}, cells.text_quality)
    check(spark, {"o'neil  x-Y": "O'neil  X-y"}, cells.title)
    check(spark, {"a​\x07b~ü1": "abü1"}, cells.strip_unwanted)
    check(spark, {"C7": 2, "AA10": 26}, cells.cell_column)
    assert [r.v for r in spark.createDataFrame([("kitten", "sitting"), ("", "")], "a string, b string").select(cells.similarity(F.col("a"), F.col("b")).alias("v")).collect()] == [pytest.approx(4 / 7), 1.0]


def test_emails(spark):
    text = "Mail A@b.com, a@B.com; x@-y.com p..q@z.org .ok@d.io <c.d@e.co.uk>. a@b"
    row = emails.extract(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert row[0].emails == ["a@b.com", "c.d@e.co.uk", "ok@d.io"] and row[0].rejected == ["x@-y.com", "p..q@z.org"] and row[0].duplicates_removed == 1
    assert row[1].emails == []


def test_detection(spark):
    columns = {"n": ["5551234567"] * 10, "d": ["2024-01-05"] * 10, "e": ["a@b.com"] * 8 + ["x"] * 2, "t": ["a@b.com"] * 7 + ["x"] * 3, "b": ["yes", "no"] * 5, "o": ["1", "0"] * 5, "s": ["1997-01-15 00:00:00"] * 10, "z": [""] * 10, "late": [""] * 9 + ["$5"]}
    frame = spark.createDataFrame([(i, *[v[i] for v in columns.values()]) for i in range(10)], "__rid long, " + ", ".join(f"{c} string" for c in columns))
    assert cleaning.detect(frame) == {"n": "NUMBER", "d": "DATE", "e": "EMAIL", "t": "TEXT", "b": "BOOLEAN", "o": "NUMBER", "s": "TEXT", "z": "TEXT", "late": "CURRENCY"}


def test_cleaning_order(spark):
    make = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__rid long, a string, email string")
    out = lambda rows, **o: [(r.a, r.email) for r in cleaning.clean(make(rows), cleaning.Options(**o), {"a": "TEXT", "email": "EMAIL"})[0].orderBy("__rid").collect()]
    assert out([("", " ")], missing="FILL", fill="x") == [("x", "x")]
    assert out([("", " ")], missing="FILL") == []
    assert out([("k", "bad")], action="BLANK", missing="FILL", fill="n/a") == [("k", "n/a")]
    assert out([("a", ""), ("A", ""), ("a", "")], normalised=True) == [("a", "")]
    money = cleaning.clean(spark.createDataFrame([(0, "none")], "__rid long, p string"), cleaning.Options(action="BLANK"), {"p": "CURRENCY"})
    assert money[0].first().p == "none" and money[1].first().reason == "invalid currency"
    assert cleaning.clean(make([("k", "bad"), ("k", "a@b.com")]), cleaning.Options(action="REMOVE_ROW"), {"a": "TEXT", "email": "EMAIL"})[0].count() == 1


def test_similar_rows_are_greedy(spark):
    names = ["acme industries ltd", "acme industries ltd.", "acme industries ltd..", "acme industry ltd", "other", "othre", "Acme  Industries Ltd", "", "x" * 13, "x" * 14] + [f"supplier#00000{i}" for i in range(30)]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    ratio = lambda a, b: 1.0 if a == b else 1.0 - lev(a, b) / max(len(a), len(b))
    frame = spark.createDataFrame(list(enumerate(names)), "__rid long, name string")
    for threshold in (0.92, 0.8, 0.6):
        kept = []
        for i, n in enumerate(names):
            if not any(ratio(names[k].strip().lower(), n.strip().lower()) >= threshold for k in kept):
                kept.append(i)
        assert sorted(r[0] for r in dedupe.drop_similar(frame, ["name"], "__rid", threshold).collect()) == kept


def test_masks_of_all_documents(spark):
    import re

    from gridloom import catalog

    def brute(t):
        t = re.sub(r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"\1***@\2", t[:300])
        return re.sub(r"\b(?:[0-9][ -]?){12,19}\b", lambda m: "••••" + re.sub("[^0-9]", "", m[0])[-4:], t)

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.masked for r in catalog.QUERIES["privacy_mask"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: None if t is None else brute(t) for i, t in texts.items()}
    odd = ["1234 5678 9012 3456 and so on", "card 1234-5678-9012, 12345678901", "1" * 19, "1" * 20, "1" * 25 + " x", "1234567890123456x", "call 4111111111111111."]
    made = spark.createDataFrame(list(enumerate(odd)), "i long, text string").select("i", cells.masked("text").alias("m"))
    assert {r.i: r.m for r in made.collect()} == {i: brute(t) for i, t in enumerate(odd)}


def test_masks_go_to_the_end_of_texts(spark):
    from gridloom import catalog

    def brute(t):
        t = re.sub(r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"\1***@\2", t)
        return re.sub(r"\b(?:[0-9][ -]?){12,19}\b", lambda m: "••••" + re.sub("[^0-9]", "", m[0])[-4:], t)

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.masked for r in catalog.QUERIES["privacy_mask"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: None if t is None else brute(t) for i, t in texts.items()}
    assert any(brute(t)[300:] != t[300:] and brute(t[:300]) == t[:300] for t in texts.values() if t)
    # Names that touch the address before them, names without an address, and one that the old cut would have parted.
    odd = ["a b " * 100 + "john.doe@x.com, 4111 1111 1111 1111.", "a@b.com_c@d.org", "a@b.c0@d.org-x@y", "ab@cd@ef.gh@ij.kl", "a@b.com.@c.de", "@a.bc x@y.z1 q@r.st", "z" * 295 + "@long.org"]
    assert values(spark, odd, cells.masked) == [brute(t) for t in odd]
    long = "x" * 300_000
    assert values(spark, [f"{long} {long}@y.org {'a@' * 50_000} {'1-' * 6} z"], cells.masked) == [f"{long} x***@y.org {'a@' * 50_000} {'1-' * 6} z"]


def test_previews_are_cut_before_they_are_masked(spark):
    texts = ["a b " * 74 + "john.doe@x.com", "a b " * 75 + "john.doe@x.com", "john.doe@x.com " + "y" * 300]
    assert values(spark, texts, cells.masked_preview) == ["a b " * 74 + "john", "a b " * 75, "j***@x.com " + "y" * 285]


def test_similar_rows_of_a_long_chain(spark):
    from gridloom.operators import dedupe

    # Each key differs by one letter from the one before it and by two from all others.
    base, n = "a" * 24, 460
    names = [base]
    for i in range(1, n):
        at, old = (i - 1) % 24, names[-1]
        names.append(old[:at] + chr(ord(old[at]) + 1) + old[at + 1 :])
    frame = spark.createDataFrame(list(enumerate(names)), "__rid long, name string")
    assert sorted(r[0] for r in dedupe.drop_similar(frame, ["name"], "__rid", 0.95).collect()) == list(range(0, n, 2))


GOLD = {
    "-2^2": "-4", "2^-1": "0.5", "2^3^2": "512", "50%": "0.5", "50%^2": "#NAME?", "1/0": "#DIV/0!", "IFERROR(1/0,0)": "0", "IF(FALSE,1)": "FALSE", "MOD(-7,3)": "2", "MOD(7,-3)": "-2", "ROUND(-2.5,0)": "-2", "ROUND(2.5,0)": "3", "INT(-1.5)": "-2", "QUOTIENT(-7,2)": "-3",
    "MEDIAN(1,2,4,9)": "3", "MODE(2,2,1,1)": "2", "MODE(1,2)": "#N/A", "PERCENTILE(1,2,4,0.25)": "1.5", "LARGE(5,1,3,2)": "3", "SMALL(5,1,3,4)": "#NUM!", 'PROPER("o\'neil x-y")': "O'Neil X-Y", 'SUBSTITUTE("a-b-c","-","+",2)': "a-b+c", 'TEXT(1234.5,"#,##0.00")': "1,234.50", 'TEXT(0.256,"0%")': "26%",
    'FIND("B","abc")': "#VALUE!", 'SEARCH("B","abc")': "2", "FACT(5)": "120", "GCD(12,18)": "6", "LCM(4,6)": "12", '"a"&1': "a1", "A1=0": "FALSE", "A1+1": "1", "FOO(1)": "#NAME?", "A1:A3": "#VALUE!", "LN(0)": "#NUM!", 'AVERAGE("x")': "#DIV/0!", "-50%": "-0.5", 'TEXTJOIN("-",TRUE,"a","","b")': "a-b", "XOR(TRUE,TRUE,TRUE)": "TRUE", "ROUNDUP(1.21,1)": "1.3", 'IF("x",1,2)': "#VALUE!",
}


@pytest.mark.parametrize("text", sorted(GOLD))
def test_formula(text):
    assert formula.shown(formula.evaluate(text)) == GOLD[text]


def test_sheets(spark):
    rows = [("s", 0, 0, "3"), ("s", 1, 0, "=A1*2"), ("s", 2, 0, "=SUM(A1:A2)"), ("s", 3, 0, "=A4"), ("s", 4, 0, '=COUNTIF(A1:A3,">3")'), ("s", 5, 0, "'=text"), ("t", 0, 0, "=IFERROR(A1,0)")]
    got = {(r.sheet, r.row): r.display for r in formula.recalculate(spark.createDataFrame(rows, "sheet string, row int, col int, input string")).collect()}
    assert got == {("s", 0): "3", ("s", 1): "6", ("s", 2): "9", ("s", 3): "#CIRCULAR!", ("s", 4): "2", ("s", 5): "=text", ("t", 0): "0"}
    assert formula.address("$B$12") == (11, 1) and formula.address("A0") is None and [formula.column_label(i) for i in (0, 25, 26)] == ["A", "Z", "AA"]


def test_csv():
    assert files.parse_csv("a;b\n1;2") == [["a", "b"], ["1", "2"]]
    assert files.parse_csv('"x ""q"" y",2') == [['x "q" y', "2"]]
    assert files.parse_csv('"a"b,c') == [["ab", "c"]] and files.parse_csv('a"b,c') == [['a"b', "c"]]
    assert files.parse_csv("a\n\n \nb\rc") == [["a"], [" "], ["b"], ["c"]]
    assert files.parse_csv('﻿h,"two\nlines"\n1,') == [["h", "two\nlines"], ["1", ""]] and files.parse_csv("") == []


def test_workbooks_and_documents(spark, tmp_path):
    data = files.xlsx_bytes({"One/Two": [["name", "n"], ["é<&>", "5"], ["", "=SUM(B2,1)"]], "x": [["only"]]}, formulas=True)
    (tmp_path / "a.xlsx").write_bytes(data)
    got = {(r.sheet, r.row, r.col): r.input for r in files.read_workbooks(spark, str(tmp_path / "a.xlsx"), True).collect()}
    assert got == {("One_Two", 0, 0): "name", ("One_Two", 0, 1): "n", ("One_Two", 1, 0): "é<&>", ("One_Two", 1, 1): "5", ("One_Two", 2, 1): "=SUM(B2,1)", ("x", 0, 0): "only"}
    assert files.xlsx_rows(data)[:2] == [["name", "n"], ["é<&>", "5"]]
    (tmp_path / "a.docx").write_bytes(files.docx_bytes(["one\ttwo", "", "three & four"]))
    assert files.read_documents(spark, str(tmp_path / "a.docx")).first().text == "one\ttwo\n\nthree & four"
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<!DOCTYPE x><a/>")
    with pytest.raises(files.Unsafe):
        list(files.xlsx_cells((tmp_path / "bad.xlsx").read_bytes()))
    assert files.decode_text("é".encode("cp1252")) == "é" and files.decode_text("é".encode("utf-16")) == "é"


def test_workflow(spark, tmp_path):
    table = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__rid long, N string, V string")
    names = lambda df: [r.N for r in df.collect()]
    three = table([("a", "10"), ("b", ""), ("c", "9")])
    assert names(workflow.sort_table(three, "V")) == ["b", "c", "a"] and names(workflow.sort_table(three, "v", True)) == ["a", "c", "b"]
    assert names(workflow.sort_table(table([("a", "1"), ("b", "1")]), "2", True)) == ["b", "a"]
    assert names(workflow.filter_rows(table([("a", "1"), ("b", "1")]), "1", "not")) == []
    assert workflow.keep_columns(three, "2, N").columns == ["__rid", "V", "N"]
    steps = [workflow.Step("PASTE_TEXT", "n;m\nx@y.com;2\nz;1"), workflow.Step("TEXT_TO_TABLE"), workflow.Step("SORT_TABLE", options={"column": "m"}), workflow.Step("EXPORT_CSV", options={"path": str(tmp_path / "out")}), workflow.Step("PASTE_TEXT", "mail a@b.com"), workflow.Step("EXTRACT_EMAILS")]
    assert [r.email for r in workflow.run(spark, steps).df.collect()] == ["a@b.com"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert [s.kind for s in workflow.decode(workflow.encode(steps))] == [s.kind for s in steps] and workflow.decode("{") == [] and workflow.decode('[{"kind": "NO"}]') == []
    for bad in ([], [workflow.Step("SORT_TABLE")], [workflow.Step("PASTE_TEXT"), workflow.Step("CLEAN_TABLE")], [workflow.Step("PASTE_TEXT"), workflow.Step("FIND_REPLACE")]):
        with pytest.raises(workflow.PlanError):
            workflow.validate(bad)
    comma = workflow.text_to_table(spark.createDataFrame([(0, 'a,b,c\n"x, ""y""",2,\nz')], "doc_id long, text string")).drop("__rid").collect()
    assert [tuple(r) for r in comma] == [('x, "y"', "2", ""), ("z", "", "")]
    assert workflow.moved([1, 2, 3], 0, 2) == [2, 3, 1]


def test_records(spark):
    base = "https://x.example/p/"
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "A", "offers": {"price": 3, "priceCurrency": "EUR"}, "url": "/a"}, {"@type": "Thing"}]}</script>'
    assert [(x["name"], x["price"], x["link"]) for x in records.items(base, ld)[1]] == [("A", "EUR 3", "https://x.example/a")]
    micro = '<div itemscope><span itemprop="name">B</span><meta itemprop="price" content="4"><i itemprop="brand">Z</i></div>'
    assert records.items(base, micro)[0] == "microdata" and records.items(base, micro)[1][0]["extra"] == [("Brand", "Z")]
    assert records.items(base, '<title>T</title><meta property="og:description" content="d">')[1][0] == {"name": "T", "description": "d", "price": None, "rating": None, "link": base, "image": None, "category": None, "extra": []}
    more = '<script type="application/ld+json">[{"@type": ["Thing", "Book"], "headline": " B ", "price": 0, "isbn": 12, "inStock": true, "author": [{"name": "X"}, "Y"], "date_published": "2024", "brand": {"name": "Z"}, "aggregateRating": {"ratingValue": 4.5}, "image": [{"url": "i.png"}], "none": null}, {"@type": "Product", "name": "A", "offers": [{"lowPrice": 0, "priceCurrency": "EUR"}]}, {"@type": "Product", "name": "A", "offers": {"price": 0, "priceCurrency": "EUR"}, "sku": "later"}]</script>'
    first, second = records.items(base, more)[1]
    assert (first["name"], first["price"], first["rating"], first["image"]) == ("B", "0", "4.5", base + "i.png") and first["extra"] == [("Isbn", "12"), ("Instock", "true"), ("Author", "X, Y"), ("Date Published", "2024"), ("Brand", "Z")]
    assert (second["price"], second["extra"]) == ("EUR 0", [])
    shop = "<ul>" + '<li class="c"><span class="title">N</span><a href="/x">go</a><dl><dt>Screen size</dt><dd>5 in</dd></dl><i class="brand-name">Q</i><b class="tag">T</b><span>Rooms: 3</span><span>Price: 9</span><em aria-label="rating 4 of 5">s</em><p>It costs € 5.50</p></li>' * 3 + "</ul>"
    strategy, made = records.items(base, shop)
    assert strategy == "cards" and len(made) == 3 and (made[0]["name"], made[0]["price"], made[0]["rating"], made[0]["category"], made[0]["description"]) == ("N", "€ 5.50", "rating 4 of 5", "T", "It costs € 5.50")
    assert made[0]["extra"] == [("Screen Size", "5 in"), ("Brand", "Q"), ("Rooms", "3")]
    chosen = {"container": "div.c", "title": "b", "price": "[data-p]", "link": "a[href*=go]"}
    assert [(x["name"], x["price"], x["link"]) for x in records.items(base, '<div class="c"><b>N</b><i data-p>9</i><a href="go/1">x</a></div>', chosen)[1]] == [("N", "9", "https://x.example/p/go/1")]
    assert records.tables(records.Tree("<table><tr><th>a<td>b<tr><td>c</table>").root) == [[["a", "b"], ["c"]]] and records.items(base, None) == ("none", [])


def test_invoices(spark):
    item = lambda q, p, a: ("x", q, p, a)
    rows = [(1, [item("2", "3.50", "")], "", "", ""), (2, [], "10.00", "1.80", ""), (3, [item("1", "", "7.00")], "7.05", "", ""), (4, [item("1", "", "7.00")], "8.00", "1.00", "9.00"), (5, [item("0", "", "7")], "", "2.00", "9.00")]
    frame = spark.createDataFrame(rows, f"id int, items array<{invoices.ITEM}>, subtotal string, tax string, total string")
    got = {r.id: r for r in invoices.checked(invoices.fill_gaps(frame)).collect()}
    assert got[1]["items"][0].amount == "7.00" and got[1].subtotal == "7.00" and got[2].total == "11.80" and got[5]["items"][0].unit_price == ""
    assert [got[i].items_review for i in (3, 4)] == [False, True] and not got[4].totals_review
    assert invoices.export_rows(frame, "id").count() == 5


def test_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, t in enumerate(["Hello world this is fine.", " "]):
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    for more in range(2):
        batches.run_files(spark, str(tmp_path / "in"), str(tmp_path / "history"), str(tmp_path / "state")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "history"))
        assert sorted((r.qualityScore, r.status) for r in got.collect()) == [(0, "FAILED"), (100, "SUCCESS")] + [(100, "SUCCESS")] * more
        (tmp_path / "in" / "later.txt").write_text("Another text, a good one too.")
    calls = itertools.count()

    def work():
        if next(calls) < 2:
            raise OSError
        return "done"

    pauses = []
    assert batches.with_retry(work, sleep=pauses.append) == "done" and pauses == [0.5, 1.0]
    assert [batches.backoff_ms(i) for i in range(6)] == [500, 1000, 2000, 4000, 8000, 8000]


def test_receipts(spark):
    from gridloom.operators import receipts

    def parse(*texts):
        rows = receipts.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
        return [({f["name"]: f["value"] for f in r["fields"]}, [tuple(i) for i in r["items"]]) for r in rows]

    ((fields, items),) = parse("TAX INVOICE\nCorner Shop\nSubtotal: 100.00\nGrand Total: 118.00\nGST 18.00\nDue date 01/02/2024\nDate: 5 Jan 2024\nTax ID: AB-12\nCoffee  2  3.50  7.00\nTea: 4.25\nServed by\nAnn\nSeat: 9")
    assert fields["Subtotal"] == "100.00" and fields["Company"] == "Corner Shop" and fields["Date"] == "5 Jan 2024" and fields["Cashier"] == "Ann"
    assert items == [("Coffee", "2", "3.50", "7.00"), ("Tea", "", "", "4.25")] and parse(None, "", " \n\t") == [({}, [])] * 3
    # A name's label alone takes the next line unless that is taken; a line serves one field; a label that repeats counts once.
    assert parse("Customer\nInvoice No: A-1", "Customer:\nAnn", "Shop\nTax 1.00\nTax 2.00\nSeat: 4a\nseat: 5b") == [({"Invoice Number": "A-1"}, []), ({"Customer": "Ann"}, []), ({"Tax": "1.00", "Company": "Shop", "Seat": "4a"}, [])]
    assert receipts.extract(spark.createDataFrame([], "doc_id long, text string, fields string")).columns == ["doc_id", "fields", "items", "subtotal", "tax", "total"]
    assert receipts.items_from_text(receipts.items_text([("a", "2", "3.50", "7.00")]) + "\nb | x | | 1") == [("a", "2", "3.50", "7.00"), ("b", "", "", "1")]


def test_layout():
    from gridloom.operators import layout

    word = lambda t, x, y, w=60: (t, x, y, x + w, y + 20)
    page = [word("Report", 0, 0), word("of", 70, 0, 20), word("May", 100, 0)] + [word(t, 300 * j, 60 + 30 * i) for i, r in enumerate((("Item", "Price"), ("Tea", "4.00"), ("Cake", "2.00"))) for j, t in enumerate(r)] + [word("big", 0, 150), word("Bye", 0, 400)]
    assert layout.layout_text(page) == "Report of May\n\nItem\tPrice\nTea\t4.00\nCake\t2.00\n\nbig\nBye"
    grid = lambda *rows: [word(t, x, 30 * i) for i, r in enumerate(rows) for t, x in r]
    wide = [("Total", 0), ("12", 300)]
    assert layout.layout_text(grid([("Item", 0), ("Price", 300)], [("Tea", 5), ("4", 310)], wide) + [word("far", 0, 400), word("off", 300, 400)]) == "Item\tPrice\nTea\t4\nTotal\t12\n\nfar off"
    # A row whose cell stands over two columns ends the table; cells without a column go to the nearest.
    assert layout.layout_text(grid([("a", 0), ("b", 150), ("c", 300)], [("d", 0), ("e", 150), ("f", 300)], [("g", 0), ("h", 300)]) + [word("i", 40, 90, 170), word("j", 290, 90, 60)]) == "a\tb\tc\nd\te\tf\ng\t\th\n\ni j"
    assert layout.layout_text(grid([("one", 0), ("two", 100)], *[[("x", 0)]] * 6), "prose") == "prose"
    assert [(c.text, c.left, c.right) for c in layout.joined_cells([("b", 40, 0, 60, 9), ("a", 0, 0, 50, 9), ("c", 100, 0, 110, 9)], 20)] == [("a b", 0, 60), ("c", 100, 110)] and layout.joined_cells([], 3) == []
    assert layout.layout_text(page[:4], "few") == "few" and layout.table_rows("x\na\tb\ny\nc\td\te") == [["a", "b", ""], ["", "", ""], ["c", "d", "e"]]


def test_book(spark):
    from gridloom.operators import book

    line = lambda t, x, y, w=400, h=20, b=0: (t, x, y, x + w, y + h, b)
    page = [
        line("12", 290, 10, 20), line("Chapter One", 200, 100, 200, 32), line("Of tea", 200, 140, 200, 32), line("T", 50, 200, 40, 60, 9), line("he pot was hy-", 100, 210, b=1), line("phenated here", 100, 232, b=1),
        line("and went on.", 100, 254, 150, b=1), line("A new one", 100, 276, b=1), line("it joins", 100, 500, b=2), line("INNER WORDS", 100, 600, 200, b=3), line("Last", 100, 650, b=4),
    ]
    sized = spark.createDataFrame([(1, page, "none", 600, 1000), (2, [line("7", 0, 980)], "none", 600, 1000)], f"page_id int, lines array<{book.LINE}>, text string, w int, h int")
    got = {r.page_id: r.text for r in book.extract(sized, width="w", height="h").collect()}
    assert got == {1: "# Chapter One Of tea\n\nThe pot was hyphenated here and went on.\n\nA new one it joins\n\n### INNER WORDS\n\nLast", 2: "none"}
    more = [
        ([line("INTRODUCTION", 100, 100), line("of words", 100, 122), line("1.2 Names", 100, 300, 200, 22), line("ends:", 100, 400), line("New", 100, 422)], "# INTRODUCTION\n\nof words\n\n### 1.2 Names\n\nends: New"),
        ([line("a", 0, 100), line("b", 0, 100, b=1), line("C", 0, 140, b=2)], "a b\n\nC"),
        ([line("So", 0, 50, 40, 70), line("mebody said it once or twice", 0, 130), line("X", 0, 160, 40, 70), line("A TITLE", 0, 240, 100, 40), line("yz is the end of it", 0, 300)], "Somebody said it once or twice\n\n# A TITLE\n\nXyz is the end of it"),
        ([line("half-", 0, 100), line("Way", 0, 122), line("won\u00ad", 0, 144), line("der", 0, 166)], "half- Way wonder"),
    ]
    frame = spark.createDataFrame([(1, [page[1], page[-1]], "f"), (2, None, "f"), (3, [], None), (4, [(" ", 0, 0, 1, 1, 0), (None, 0, 0, 1, 1, 0)], "f"), (1, [page[1], page[-1]], "f"), *[(10 + i, ls, "f") for i, (ls, _) in enumerate(more)]], f"page_id int, lines array<{book.LINE}>, text string")
    rows = [(r.page_id, r.text) for r in book.extract(frame).collect()]
    assert sorted(rows) == sorted([(1, "Chapter One\n\nLast"), (1, "Chapter One\n\nLast"), (2, "f"), (3, ""), (4, "f"), *[(10 + i, text) for i, (_, text) in enumerate(more)]])
    assert not any("Python" in line or "InPandas" in line or "Exchange" in line for line in book.extract(sized)._jdf.queryExecution().executedPlan().toString().splitlines())
    pages = [("a", 1, "# Top\n\nIt was a won-"), ("a", 2, " "), ("a", 3, "derful"), ("a", 4, "day.\n\nNext"), ("a", 5, "Upper"), ("a", 6, None), ("b", 1, "# H"), ("b", 2, "low"), ("b", 3, "er")]
    got = book.glued(spark.createDataFrame(pages, "book string, page int, text string"), "book", "page").orderBy("book", "page").collect()
    assert {b: "".join(r.glue + r.text for r in got if r.book == b) for b in "ab"} == {"a": "# Top\n\nIt was a wonderful day.\n\nNext\n\nUpper", "b": "# H\n\nlow er"}


def test_receipt_tables(spark):
    from gridloom.operators import receipt_tables as rt

    def line(y, *cells):
        return rt.Line(" ".join(t for t, _ in cells), y, y + 20, [(w, x + 9 * t.find(w), y, x + 9 * t.find(w) + 8 * len(w), y + 20) for t, x in cells for w in t.split()])

    head = line(0, ("Qty", 0), ("Details", 100), ("Rate", 300), ("Line Total", 400))
    body = [line(30, ("2", 0), ("Green tea", 100), ("3.50", 300), ("7.00", 410)), line(60, ("Cake", 100), ("4.00", 410)), line(90, ("3", 0), ("xx", 300), ("9.00", 410))]
    rows, header, aligned = rt.detect([line(-60, ("Shop", 0)), head, *body, line(120, ("Total", 100), ("11.00", 410)), line(150, ("Tea", 100), ("1.00", 410))])
    assert header and not aligned and rows == [("", "2", "3.50", "7.00"), ("", "", "", "4.00"), ("", "3", "", "9.00")]
    named = line(0, ("Item", 100), ("Qty", 0), ("Rate", 300), ("Amount", 400))
    rows, header, aligned = rt.detect([named, *body[:2], line(90, ("extra hot", 100)), line(120, ("Thank you", 100))])
    assert header and aligned and rows == [("Green tea", "2", "3.50", "7.00"), ("Cake extra hot", "", "", "4.00")]
    rows, header, aligned = rt.detect([line(0, ("Shop", 0)), line(30, ("Tea", 0), ("2", 150), ("3.50", 300), ("7.00", 400)), line(60, ("with milk", 0)), line(90, ("5.00", 400)), line(120, ("Pie", 0), ("$4.5", 400)), line(400, ("Far", 0), ("1.00", 400))])
    assert not header and aligned and rows == [("Tea with milk", "2", "3.50", "7.00"), ("Pie", "", "", "$4.5")]
    assert rt.detect([]) == ([], False, True) and [rt.number(t) for t in ("3 pcs", "(1,250.00)", "$5", " ", "Rs. 2.5")] == [None, -1250.0, 5.0, None, 2.5]
    word = lambda t, x, y: (t, x, y, x + 40, y + 20)
    scan = [("Item Amount", 0, 20, [word("Item", 0, 0), word("Amount", 200, 0)]), ("Tea 4.00", 30, 50, [word("Tea", 0, 30), word("4.00", 200, 30)])]
    frame = spark.createDataFrame([(1, "Item Amount\nTea 4.00\nTotal: 9.00", scan), (2, "Pie: 2.00", None), (3, None, [])], f"doc_id int, text string, lines {rt.LINES}")
    got = {r.doc_id: r for r in rt.extract(frame).collect()}
    assert [tuple(i) for i in got[1]["items"]] == [("Tea", "", "", "4.00")] and got[1].total == "9.00" and got[1].header_found and got[1].subtotal == "4.00"
    assert [tuple(i) for i in got[2]["items"]] == [("Pie", "", "", "2.00")] and got[3]["items"] == [] and not got[3].items_review


def test_exports(spark, tmp_path):
    from gridloom.sources import pdf

    table = "n\tm\n=1+1\tx\na,b\ty"
    steps = lambda kind, text, name, **o: [workflow.Step("PASTE_TEXT", text), *([workflow.Step("TEXT_TO_TABLE")] if "table" in name else []), workflow.Step(kind, options={"path": str(tmp_path / name), **o})]
    read = lambda name: [p.read_bytes() for p in sorted((tmp_path / name).glob("part-*"))]
    for name, kind, text, options in (("table1", "EXPORT_XLSX", table, {}), ("text1", "EXPORT_XLSX", "a\nb", {}), ("tabs1", "EXPORT_XLSX", "a\tb\nc", {}), ("table2", "EXPORT_DOCX", table, {}), ("table3", "EXPORT_DOCX", table, {"style": "plain"}), ("book", "EXPORT_DOCX", "# One\n\nTwo\nthree", {}), ("table4", "EXPORT_PDF", table, {}), ("book2", "EXPORT_PDF", "# One\n\nTwo", {})):
        workflow.run(spark, steps(kind, text, name, **options))
    assert [files.xlsx_rows(read(n)[0]) for n in ("table1", "text1", "tabs1")] == [[["n", "m"], ["=1+1", "x"], ["a,b", "y"]], [["Text"], ["a"], ["b"]], [["a", "b"], ["c"]]]
    assert files.docx_text(read("table2")[0]).split() == ["n", "m", "=1+1", "x", "a,b", "y"] and files.docx_text(read("table3")[0]) == "n,m\n'=1+1,x\n\"a,b\",y"
    assert files.docx_text(read("book")[0]) == "One\nTwo three" and all(x.startswith(b"%PDF-") for n in ("table4", "book2") for x in read(n))
    rows = spark.range(25).orderBy("id").selectExpr("array(cast(id as string)) as cells")
    assert files.write_parts(rows, str(tmp_path / "table1"), "txt", lambda held: "\n".join(r[0] for r in held).encode(), 4) == len(read("table1")) >= 7
    assert b"\n".join(read("table1")).decode().split() == [str(i) for i in range(25)]
    data, lost = pdf.text_pdf("é € \u4e2d " + "w" * 200 + "\n(a)\\", False)
    assert lost == 1 and data.count(b"/Type /Page ") == 1 and pdf.text_pdf("")[0].count(b"/Type /Page ") == 1
    assert pdf.printable("a\xa0b\xad\x07\u2019\U0001f600") == ("a b\u2019?", 1)
    long = pdf.book_pdf("# A\n\n## B\n\n" + "word " * 4000 + "\n\n# C")[0]
    assert long.count(b"/Type /Page ") > 5 and long.count(b"/Title") == 3 and b"/Outlines" in long
    for n, m in enumerate(re.finditer(rb"(?m)^(\d{10}) 00000 n", long), 1):
        assert long[int(m[1]) :].startswith(f"{n} 0 obj".encode())


def test_reading_pdf(spark, tmp_path):
    import zlib

    from gridloom.sources import pdf

    assert pdf.page_texts(pdf.text_pdf("H\u00e9llo (a)\\ \u20ac b\nsecond\n\nthird")[0]) == ["H\u00e9llo (a)\\ \u20ac b\nsecond\nthird"]
    assert pdf.page_texts(pdf.text_pdf("a\tbb\nccc\td\nplain", True)[0]) == ["a bb\nccc d\nplain"] and pdf.page_texts(pdf.text_pdf("")[0]) == [""]
    stream = lambda n, body, more=b"": b"%d 0 obj <</Length %d /Filter /FlateDecode %s>>\nstream\n" % (n, len(zlib.compress(body)), more) + zlib.compress(body) + b"\nendstream endobj\n"
    packed = b"1 0 2 33 <</Type/Catalog/Pages 2 0 R>>    <</Type/Pages/Kids[3 0 R 3 0 R]/Resources<</Font<</F 4 0 R>>>>>>"
    letters = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    shown = b"BT /F 10 Tf 1 0 0 1 50 700 Tm [<0001> -300 <0002>] TJ 0 -12 Td <0003> Tj 40 0 Td <0001> Tj ET"
    data = b"%PDF-1.5\n" + stream(9, packed, b"/Type/ObjStm/N 2/First 9") + b"3 0 obj <</Type/Page/Contents [5 0 R]>> endobj 4 0 obj <</ToUnicode 6 0 R>> endobj\n" + stream(5, shown) + stream(6, letters) + b"trailer <</Root 1 0 R>>"
    assert pdf.page_texts(data) == ["H i\nj H"]
    for bad in (b"", b"%PDF-1.4 trailer <</Encrypt 1 0 R>>"):
        with pytest.raises(pdf.Unreadable):
            pdf.page_texts(bad)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(data)
    step = workflow.Step("LOAD_PDF", options={"path": str(tmp_path / "in")})
    assert [r.text for r in workflow.run(spark, [step]).df.collect()] == ["H i\nj H"]
    (tmp_path / "in" / "b.pdf").write_bytes(b"none")
    assert [(r.page, r.text, r.error) for r in pdf.read_pdfs(spark, str(tmp_path / "in")).orderBy("path").collect()] == [(1, "H i\nj H", None), (0, "", "not a PDF")]
    with pytest.raises(workflow.PlanError):
        workflow.run(spark, [step])


def test_conversions(spark, tmp_path):
    from gridloom.sources import conversions, pdf

    cases = {("PDF ", None): ("DOCUMENT", "pdf", None), ("", "application/pdf; x=1"): ("DOCUMENT", "pdf", None), ("bin", "image/x-odd"): ("IMAGE", "bin", None), ("docx", "image/png"): ("DOCUMENT", "docx", None), ("zip", None): ("UNKNOWN", "zip", "ZIP archive"), ("", "application/zip"): ("UNKNOWN", "", "ZIP archive"), (None, None): ("UNKNOWN", "", None)}
    frame = spark.createDataFrame([(n, *k) for n, k in enumerate(cases)], "n int, e string, m string")
    assert [tuple(r.d) for r in frame.select("n", conversions.detected(F.col("e"), F.col("m")).alias("d")).orderBy("n").collect()] == list(cases.values())
    assert conversions.targets("DOCUMENT", "TXT") == ["pdf", "docx"] and conversions.targets("IMAGE", "jpeg") == ["png", "webp", "bmp"] and conversions.targets("VIDEO", "m4a") == ["m4a"] and conversions.targets("UNKNOWN", "") == []
    for folder in ("in/x", "in/y"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "in/x/a.txt").write_text("one\ntwo \u4e2d")
    (tmp_path / "in/y/a.docx").write_bytes(files.docx_bytes(["three"]))
    (tmp_path / "in/y/b.pdf").write_bytes(pdf.text_pdf("four")[0])
    (tmp_path / "in/y/c.zip").write_bytes(b"x")
    (tmp_path / "in/y/d.txt").write_bytes(b" ")
    for target, read in (("pdf", lambda b: "\n".join(pdf.page_texts(b))), ("docx", files.docx_text), ("txt", bytes.decode)):
        got = conversions.convert(spark, str(tmp_path / "in/*"), target, str(tmp_path / target)).orderBy("path").collect()
        assert [bool(r.error) for r in got] == [False, False, False, True, True] and [r.output is None for r in got] == [False, False, False, True, True]
        assert got[0].replaced == (target == "pdf") and len({r.output for r in got[:3]}) == 3 and got[2].output == f"b.{target}"
        assert [read((tmp_path / target / r.output).read_bytes()) for r in got[:3]] == ["one\ntwo " + ("?" if target == "pdf" else "\u4e2d"), "three", "four"]


def test_cleaning_report(spark):
    rows = [("a  b", "X@Y.com", "(555) 123-4567", "-5", "2", "3"), ("a b", "bad", "12", "$7", "", "4"), ("", "", "", "", "", ""), ("A B", "x@y.com", "5551234567", "7", "5", "")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__rid long, t string, e string, p string, cost string, q string, total string")
    types = {"t": "TEXT", "e": "EMAIL", "p": "PHONE", "cost": "CURRENCY", "q": "NUMBER", "total": "NUMBER"}
    o = cleaning.Options(action="BLANK", normalised=True, keys=("t",), missing="FLAG", calculated=(cleaning.Calculated("total", "q", "MULTIPLY", "cost"),), replaces=(cleaning.Replace("b", "B", column="t"),))
    counted, changes = cleaning.report(frame, o, types)
    got = counted.first().asDict()
    assert {k: got[k] for k in ("rows_in", "rows_out", "empty_rows_removed", "exact_duplicates_removed", "fuzzy_duplicates_removed", "duplicates_removed", "replacements_made", "calculated_cells_filled")} == {"rows_in": 4, "rows_out": 1, "empty_rows_removed": 1, "exact_duplicates_removed": 1, "fuzzy_duplicates_removed": 1, "duplicates_removed": 2, "replacements_made": 2, "calculated_cells_filled": 2}
    assert {k: got[k] for k in ("invalid_emails", "invalid_phones", "phones_normalized", "currency_cells_cleaned", "invalid_numeric_values", "missing_values_found", "missing_values_flagged", "rows_removed_for_invalid_values")} == {"invalid_emails": 1, "invalid_phones": 1, "phones_normalized": 1, "currency_cells_cleaned": 1, "invalid_numeric_values": 1, "missing_values_found": 9, "missing_values_flagged": 9, "rows_removed_for_invalid_values": 0}
    assert sorted((r["__rid"], r.column, r.before, r.after, r.reason) for r in changes.collect()) == [
        (0, "e", "X@Y.com", "x@y.com", "email normalized"), (0, "p", "(555) 123-4567", "5551234567", "phone normalized to 10 digits"), (0, "total", "3", "-10.00", "calculated: q × cost"),
        (1, "cost", "$7", "7", "currency cleaned to numeric"), (1, "e", "bad", "", "invalid email blanked"), (1, "p", "12", "", "invalid phone blanked"), (3, "total", "", "35.00", "calculated: q × cost"),
    ]
    out, invalid = cleaning.clean(frame, o, types)
    assert out.count() == 1 and sorted((r["__rid"], r.column, r.value, r.expected) for r in invalid.collect()) == [(0, "cost", "-5", "NUMBER"), (1, "e", "bad", "EMAIL"), (1, "p", "12", "PHONE")]
    gone = cleaning.report(frame, cleaning.Options(action="REMOVE_ROW", missing="REMOVE_ROW", exact=False), types)[0].first()
    assert (gone.rows_removed_for_invalid_values, gone.rows_removed_for_missing_values, gone.rows_out) == (2, 1, 0)
    assert cleaning.report(frame.limit(0), o, types)[0].first().rows_out == 0


def test_plan_edits_and_option_domains():
    steps = workflow.appended(workflow.appended([], "PASTE_TEXT"), "TEXT_TO_TABLE")
    assert steps[1].options == {"delimiter": "auto"} and workflow.projected(steps) == "TABLE" and workflow.projected([]) == "NONE"
    assert workflow.removed(steps, 0) == steps[1:] and workflow.truncated(steps, 1) == steps[:1] and workflow.moved(steps, 1, 0) == steps[::-1]
    assert len(workflow.duplicated(steps, 0)) == 3 and len(workflow.duplicated(steps * 20, 0)) == 40
    with pytest.raises(workflow.PlanError):
        workflow.appended(steps, "NO_SUCH")
    with pytest.raises(workflow.PlanError):
        workflow.validate([workflow.Step("PASTE_TEXT", "a"), workflow.Step("FIND_REPLACE", options={"find": "a", "case": "sometimes"})])


def test_what_may_be_tried_again():
    import socket

    from gridloom.streaming import batches

    class Answer(Exception):
        def __init__(self, code):
            self.code = code

    assert [batches.may_pass(e) for e in (OSError(), TimeoutError(), RuntimeError(), Answer(503), Answer(429), Answer(404), ValueError(), socket.gaierror(), FileNotFoundError())] == [True, True, True, True, True, False, False, False, False]
    tried, pauses = [], []

    def work():
        tried.append(1)
        if len(tried) < 3:
            raise OSError
        return "done"

    assert batches.with_retry(work, sleep=pauses.append) == "done" and pauses == [0.5, 1.0]
    with pytest.raises(ValueError):
        batches.with_retry(lambda: int("x"), sleep=pauses.append)


def test_dependents_of_edited_cells():
    from gridloom.operators import formula

    a = lambda t: formula.address(t)
    sheet = {a("A1"): "1", a("B1"): "=A1", a("C1"): "=SUM(A1:B9)", a("D1"): "=IF(C1>0,B1,2)", a("E1"): "=5", a("F1"): "=F1+A1", a("G1"): "=(", a("H1"): "plain A1", a("I1"): "=$A$1&\"A1\"", **{(r, 20): f"=U{r}" for r in range(1, 2000)}, (0, 20): "=A1"}
    found = formula.dependents(sheet, {a("A1")})
    assert found == {a("B1"), a("C1"), a("D1"), a("F1"), a("I1"), *((r, 20) for r in range(2000))}
    assert formula.dependents(sheet, {a("E1")}) == set() and formula.dependents(sheet, {a("C1")}) == {a("D1")}
    assert formula.references("=SUM(B2:A1,C3)+-D4%") and sorted(formula.references("=SUM(B2:A1,C3)")) == [(0, 0, 1, 1), (2, 2, 2, 2)] and formula.references("=)(") == []


def test_edits_of_empty_and_repeated_cells(spark):
    from gridloom.operators import formula

    cells = spark.createDataFrame([("s", 0, 0, "1"), ("s", 0, 1, "=A1+C1"), (None, 0, 0, "=2")], "sheet string, row int, col int, input string")
    edits = spark.createDataFrame([("s", 0, 2, "5"), ("s", 0, 0, "3"), ("s", 0, 0, "2"), ("new", 0, 0, "=1+1")], "sheet string, row int, col int, input string")
    got = {(r.sheet, r.row, r.col): (r.display, r.changed) for r in formula.edited(formula.recalculate(cells), edits).collect()}
    assert got == {("s", 0, 0): ("3", True), ("s", 0, 1): ("8", True), ("s", 0, 2): ("5", True), ("", 0, 0): ("2", False), ("new", 0, 0): ("2", True)}
    assert formula.edited(formula.recalculate(cells), edits.limit(0)).where("changed").count() == 0


def test_labels_beyond_the_columns_are_kept(spark):
    from gridloom.operators import records

    row = ("u", *["x"] * len(records.FIELDS), [("a", "1"), ("b", "2"), ("c", "3")], "cards")
    frame = spark.createDataFrame([row, ("v", *[None] * len(records.FIELDS), [("a", "4")], "cards")], records.SCHEMA)
    got = records.flat(frame, most_labels=1).orderBy("Source").collect()
    assert [(r.a, r.More) for r in got] == [("1", {"b": "2", "c": "3"}), ("4", {})] and "More" not in records.flat(frame).columns


def test_saved_workflows_have_a_limit(spark):
    from gridloom.operators import history

    rows = spark.range(history.MOST_SAVED).selectExpr("id", "'n' as name", "'[]' as stepsJson", "0 as stepCount", "id as createdAt")
    with pytest.raises(ValueError):
        history.saved(rows, "more", "[]", 0, 1)
    assert history.saved(rows.limit(0), "x" * 100, "[]", 0, 1).first().name == "x" * 80


def test_similar_keys_with_a_common_part(spark):
    """Against every pair, on keys that share long parts, of all lengths around the threshold's steps."""
    import random

    from gridloom.operators import dedupe

    rng = random.Random(6)
    keys = {""}
    while len(keys) < 140:
        key = list(rng.choice(["common beginning of names ", "ab", "common "]) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 12))))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(key) + 1)
            key[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        keys.add("".join(key).strip())
    keys = sorted(keys)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    frame = spark.createDataFrame(list(enumerate(keys)), "rid long, key string")
    for threshold in (0.6, 0.8, 0.92, 1.0):
        want = {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and 1 - distance(a, b) / max(len(a), len(b)) >= threshold}
        assert {tuple(r) for r in dedupe._pairs(frame, threshold).collect()} == want, threshold


def test_linked_data_types_and_lazy_images():
    kinds = ["Product", "ARTICLE", "newsArticle", "BlogPosting", "recipe", "Event", "Book", "Movie", "JobPosting", "Restaurant", "localbusiness", "SoftwareApplication", "Offer"]
    page = lambda types: records.Tree("".join(f'<script type="application/ld+json">{{"@type": "{t}", "name": "n {t}"}}</script>' for t in types)).root
    assert [r["name"] for r in records.json_ld(page(kinds), "https://x.example/")] == [f"n {t}" for t in kinds]
    assert records.json_ld(page(["Organization", "Person", "Course", "WebSite"]), "https://x.example/") == []
    for name in ("data-src", "data-lazy-src", "data-lazy", "data-original", "data-echo"):
        root = records.Tree(f'<img src="data:image/gif;base64,AAAA" {name}="real.png">').root
        assert records.image_of(root, "https://x.example/a/") == "https://x.example/a/real.png"
    assert records.image_of(records.Tree('<img src="data:image/gif;base64,AAAA">').root, "https://x.example/") is None


def test_similar_offers_grow_with_edits_squared(spark):
    """Offers of a row by its key's length; and long keys against every pair."""
    import random

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for length, threshold in ((32, 0.92), (300, 0.92), (1000, 0.92), (1000, 0.99)):
        frame = spark.createDataFrame([(i, word(length)) for i in range(4)], "rid long, key string").selectExpr("rid", "key", "length(key) as n")
        edits = int((1 - threshold) * length + 1e-9)
        assert dedupe._offers(frame, threshold).count() <= 4 * 3 * (edits + 3) ** 2
    keys = [word(300) for _ in range(6)]
    for i, edits in enumerate((3, 23, 24, 25, 30, 0)):
        at = sorted(rng.sample(range(300), edits), reverse=True)
        other = list(keys[i])
        for a in at:
            other[a : a + 1] = rng.choice([["X"], [], [other[a], "Y"]])
        keys.append("".join(other) + "z" * (edits == 0))
    near = lambda a, b: spark.range(1).selectExpr(f"levenshtein('{a}', '{b}') as d").first().d / max(len(a), len(b)) <= 0.08
    want = {(i, i + 6) for i in range(6) if near(keys[i], keys[i + 6])}
    assert {tuple(r) for r in dedupe._pairs(spark.createDataFrame(list(enumerate(keys)), "rid long, key string"), 0.92).collect()} == want and len(want) >= 3
