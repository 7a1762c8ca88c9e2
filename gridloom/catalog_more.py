"""More queries over the test tables: files of all formats, web addresses, reports, saved workflows, edits of sheets, formulas.

Files are written by the query itself into the checkpoint folder, from the test tables, and read again.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from .catalog import _RUNS, _VISIBLE_SQL, cell_query, formula_query, load, query, runs
from .functions import addresses, cells
from .operators import cache_files, dependents, formula, history, invoices, layout, lineage, records
from .operators.lineage import spread
from .operators.history_table import HistoryTable
from .plans import workflow
from .sources import files, pdf, tables
from .streaming import batches

CUSTOMER = ("customer", {"id": "c_custkey", "name": "c_name"})

cell_query("retry_backoff", CUSTOMER, "id", lambda c: batches.retry_pause(c % 8), "least(8000.0, 500.0 * pow(2.0, @@ % 8))::double")
cell_query("safe_extension", CUSTOMER, "id", lambda c: cells.safe_extension(F.when(c % 3 == 0, F.concat(F.lit(".x"), c % 100)).when(c % 3 == 1, "../up").otherwise("much-too-long")), "case @@ % 3 when 0 then concat('.x', @@ % 100) else '.tmp' end")
cell_query(
    "output_name", CUSTOMER, "id",
    lambda c: cells.output_name(F.when(c % 4 == 0, F.concat(F.lit("../a/b\\c"), c, F.lit("?.csv"))).when(c % 4 == 1, F.concat(F.repeat(F.lit("x"), 130), c, F.lit(".json"))).when(c % 4 == 2, " .. ").otherwise(F.concat(F.lit("plain <"), c, F.lit(">.txt.")))),
    "case @@ % 4 when 0 then concat('c', @@, '_.csv') when 1 then concat(repeat('x', 115), '.json') when 2 then 'output' else concat('plain _', @@, '_.txt') end",
)


@query("url_list", "select c_custkey as id, unnest([concat('https://shop', c_custkey, '.example'), 'http://b.example/x', concat('HTTPS://c.example/', c_custkey)]) as url from customer")
def _(s, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit(" shop"), k, F.lit(".example ,http://b.example/x\n\nHTTPS://c.example/"), k, F.lit(",, http://b.example/x \nshop"), k, F.lit(".example"))
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(addresses.url_list(text)).alias("url"))


_HOSTS = "http://news.example/a?b#c|https://user:pw@news.example/|ftp://news.example/|http://localhost:8080/|http://10.#.0.1/|https://172.16.#.9/|http://172.32.#.9/|http://192.168.#.1/|http://100.64.#.1/|http://100.128.#.1/|http://[::1]/|http://[fd00::#]/|http://[2001:db8::#]:80/x|http://[fe80::1]/|http://[::ffff:127.0.0.1]/|http://2130706433/|http://8.8.#.8/|https://|news.example|http://198.18.#.1/|http://169.254.#.1/|http://224.0.#.1/".split("|")
_PUBLIC = [0, 6, 9, 12, 16]


@query("public_urls", f"select c_custkey as id, n::int as n, list_contains({_PUBLIC}, n) as public from customer, range({len(_HOSTS)}) t(n)")
def _(s, d):
    urls = F.array(*[F.replace(F.lit(u), F.lit(".#."), F.concat(F.lit("."), F.col("c_custkey") % 100, F.lit("."))) for u in _HOSTS])
    urls = F.transform(urls, lambda u: F.replace(u, F.lit("::#"), F.lit("::7")))
    return spread(load(s, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), F.posexplode(urls).alias("n", "url")).select("id", "n", addresses.public_url("url").alias("public"))


# Pages of the table as they are.
_TITLE_SQL = "trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
for _name, _mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _TITLE_SQL = f"replace({_TITLE_SQL}, '&{_name};', '{_mark}')"
_LINKS_SQL = """list_transform(list_distinct(list_filter(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), lambda x: trim(x) <> '')), lambda x: case when x like '/%' then concat(regexp_extract(url, '^(https?://[^/]*)', 1), x) else x end)"""


@query("scrape_fallback", f"select {_TITLE_SQL} as title, url, len({_LINKS_SQL})::varchar as links, '0' as tables, substring({_VISIBLE_SQL}, 1, 300) as preview from pages")
def _(s, d):
    return records.fallback(load(s, d, "pages")).toDF("title", "url", "links", "tables", "preview")


@query(
    "scrape_summary",
    f"select url, unnest(range(4))::int as place, unnest(['Title', 'URL', 'Links found', 'Text preview']) as field, unnest([{_TITLE_SQL}, url, len({_LINKS_SQL})::varchar, substring({_VISIBLE_SQL}, 1, 500)]) as value from pages",
)
def _(s, d):
    return records.summary(load(s, d, "pages")).toDF("url", "place", "field", "value")


@query("html_links_absolute", f"select url, unnest({_LINKS_SQL}) as link from pages")
def _(s, d):
    return load(s, d, "pages").select("url", F.explode(F.array_distinct(F.transform(records.links(F.col("html")), lambda x: records.absolute(x, F.col("url"))))).alias("link"))


@query("scrape_report", f"select url, concat('URL: ', url, chr(10), 'Title: ', {_TITLE_SQL}, chr(10), chr(10), {_VISIBLE_SQL}, chr(10), chr(10), '--- LINKS ---', chr(10)) as head, len({_LINKS_SQL})::int as links from pages")
def _(s, d):
    parts = F.split("report", "--- LINKS ---\n", 2)
    return records.report(load(s, d, "pages")).select("url", F.concat(parts[0], F.lit("--- LINKS ---\n")).alias("head"), F.regexp_count(parts[1], F.lit("\n")).alias("links"))


# Invoices and saved workflows.
@query("invoice_quality", "select o_orderkey as id, (20 * (2 + (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int))::int as quality from orders")
def _(s, d):
    k = F.col("o_orderkey")
    rows = load(s, d, "orders").select(k.alias("id"), F.lit("Shop").alias("company"), F.when(k % 2 == 0, "7").otherwise(" ").alias("number"), F.lit("2024-01-05").alias("date"), F.when(k % 3 == 0, "A. Buyer").alias("customer"), F.lit("").alias("total"))
    return invoices.quality(rows).select("id", "quality")


_SAVED = "select n_nationkey::bigint as id, n_name as name, '[]' as stepsJson, 0 as stepCount, (n_nationkey * 37 % 11)::bigint as createdAt from nation"


def _saved(s, d):
    return load(s, d, "nation").selectExpr("cast(n_nationkey as bigint) as id", "n_name as name", "'[]' as stepsJson", "0 as stepCount", "cast(n_nationkey * 37 % 11 as bigint) as createdAt")


query("saved_list", f"select * from ({_SAVED}) order by createdAt desc, id desc limit 500")(lambda s, d: history.listed(_saved(s, d)))
query("saved_count", f"select count(*) as n from ({_SAVED})")(lambda s, d: history.counted(_saved(s, d)))
query("saved_by_id", f"select * from ({_SAVED}) where id = 7")(lambda s, d: history.by_id(_saved(s, d), 7))
query("saved_delete", f"select * from ({_SAVED}) where id <> 7")(lambda s, d: history.deleted(_saved(s, d), "id", 7))
query("saved_insert", f"select * from ({_SAVED}) union all select 25, 'Untitled workflow', '[1]', 1, 99")(lambda s, d: history.saved(_saved(s, d), "  ", "[1]", 1, 99).select("id", "name", "stepsJson", "stepCount", "createdAt"))
query("history_clear", "select 0::bigint as n")(lambda s, d: history.counted(history.emptied(_saved(s, d))))


@query("history_record", "select event_id as id, least(100, event_id % 150)::int as qualityScore, concat('u***@mail.org paid ', event_id) as outputPreview from events")
def _(s, d):
    runs = load(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 150).cast("int").alias("qualityScore"), F.concat(F.lit("user"), "user_id", F.lit("@mail.org paid "), "event_id").alias("outputPreview"))
    return history.recorded(runs).select("id", "qualityScore", "outputPreview")


# Edits of sheets: A1 is the size of a part, which B1, C1 and E1 depend on and D1 and F1 do not.
_FORMULAS = ("=A1*2", "=B1+1", "=5", "=SUM(A1:C1)", '=D1&"x"')


def _sheets(s, d):
    first = [F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("p_size").cast("string").alias("input"))]
    rest = [F.struct(F.lit(0).alias("row"), F.lit(i).alias("col"), F.lit(f).alias("input")) for i, f in enumerate(_FORMULAS, 1)]
    return load(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sheet"), F.explode(F.array(*first, *rest)).alias("c")).select("sheet", "c.*")


@query(
    "formula_edit",
    "select concat('p', p_partkey) as sheet, unnest([0, 1, 2, 3, 4, 5])::int as col, unnest([x::varchar, (2 * x)::varchar, (2 * x + 1)::varchar, '5', (5 * x + 1)::varchar, '5x']) as display, unnest([e, e, e, false, e, false]) as changed"
    " from (select p_partkey, case when p_partkey % 2 = 0 then p_size + 1 else p_size end as x, p_partkey % 2 = 0 as e from part)",
)
def _(s, d):
    edits = load(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), (F.col("p_size") + 1).cast("string").alias("input"))
    return formula.edited(formula.recalculate(_sheets(s, d)), edits).select("sheet", "col", "display", "changed")


@query("sheet_rows", "select concat('p', p_partkey) as sheet, unnest([1, 2, 3])::int as row, unnest([concat(p_size, '|'), '|', concat('|', 2 * p_size)]) as line from part")
def _(s, d):
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("input"))
    rows = F.array(cell(1, 2, F.col("p_size").cast("string")), cell(3, 3, F.lit("=C2*2")), cell(9, 9, F.lit(" ")))
    sheets = load(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sheet"), F.explode(rows).alias("c")).select("sheet", "c.*")
    return formula.sheet_rows(formula.recalculate(sheets)).select("sheet", "row", F.array_join("cells", "|").alias("line"))


@query("sheet_from_table", "select 'regions' as sheet, 0 as row, unnest([0, 1])::int as col, unnest(['r_name', 'r_note']) as input union all select 'regions', r_regionkey + 1, unnest([0, 1])::int, unnest([r_name, concat(chr(39), '=', r_regionkey)]) from region")
def _(s, d):
    df = load(s, d, "region").select((F.col("r_regionkey") + 1).alias("__rid"), "r_name", F.concat(F.lit("="), "r_regionkey").alias("r_note"))
    return formula.rows_to_cells(df, "regions", "__rid")


@query("sheet_used_range", 'select concat(\'p\', p_partkey) as sheet, 0 as top, 0 as bottom, 0 as "left", 5 as "right" from part')
def _(s, d):
    return formula.used_range(_sheets(s, d))


# The remaining functions, each on a part's size and name.
formula_query(
    "formula_tests",
    [("=ISNUMBER(A1)", "'TRUE'"), ("=ISTEXT(A2)", "'TRUE'"), ("=ISBLANK(Z9)", "'TRUE'"), ("=ISERROR(1/0)", "'TRUE'"), ("=ISERROR(A1)", "'FALSE'"), ("=TRUE()", "'TRUE'"), ("=IF(FALSE(),1,A1)", "p_size"), ("=NOSUCH(A1)", "'#NAME?'"), ("=A1/0", "'#DIV/0!'"), ("=A1:A2", "'#VALUE!'"), ("=COUNT(A1:A2)", "1"), ("=COUNTA(A1:A2)", "2"), ("=COUNTBLANK(A1:A2,Z9)", "1")],
)
formula_query(
    "formula_angles",
    [("=ROUND(PI(),6)", "'3.141593'"), ("=ROUND(SIN(A1)^2+COS(A1)^2,6)", "1"), ("=ROUND(TAN(ATAN(A1)),4)", "p_size"), ("=ROUND(SIN(ASIN(1/A1))*A1,6)", "1"), ("=ROUND(COS(ACOS(1/A1))*A1,6)", "1"), ("=ROUND(ATAN2(A1,A1)-ATAN(1),6)", "0"), ("=ROUND(LOG(2^A1,2),6)", "p_size"), ("=FACT(MOD(A1,6))", "factorial((p_size % 6)::int)::bigint"), ("=TRUNC(-A1/4)", "-(p_size // 4)"), ("=PRODUCT(A1,2,3)", "p_size * 6"), ("=SUMSQ(A1,3)", "p_size * p_size + 9"), ("=AVERAGE(A1,A1+2)", "p_size + 1"), ("=VAR(A1,A1+2)", "2"), ("=VARP(A1,A1+2)", "1"), ("=STDEVP(A1,A1+4)", "2"), ("=ROUND(STDEV(A1,A1+2)^2,6)", "2"), ("=50%*A1*2", "p_size"), ("=-A1^2+2*A1^2", "p_size * p_size")],
)
formula_query(
    "formula_more_text",
    [('=TRIM("  "&A2&"  ")', "p_name"), ("=CONCATENATE(A2,A1)", "concat(p_name, p_size)"), ('=CONCAT(A1,"-",A2)', "concat(p_size, '-', p_name)"), ('=TEXT(A1,"0.00")', "concat(p_size, '.00')"), ('=FIND("#",A2&"#")', "strpos(concat(p_name, '#'), '#')"), ('=SEARCH("Z",A2&"z")', "strpos(lower(concat(p_name, 'z')), 'z')"), ('=REPLACE(A2,1,2,"__")', "concat('__', substr(p_name, 3))"), ('=PROPER("o\'neil "&A1&"x")', "concat('O''Neil ', p_size, 'X')"), ('=VALUE("$"&A1)', "p_size"), ("=CLEAN(A2)", "p_name"), ("=CODE(CHAR(65+MOD(A1,26)))", "65 + p_size % 26"), ("=LEN(A2&A1)", "length(p_name) + length(p_size::varchar)")],
)


@query("cell_row", "select c_custkey as id, c_custkey - 1 as value from customer")
def _(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), cells.cell_row(F.concat(F.lit("$AB$"), "c_custkey")).cast("long").alias("value"))


# Tables in files: written from the nations, read by name, with delimiter, encoding and quotes found out.
def _folder(s) -> str:
    lineage.ensure_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _nations(s, d):
    return [[str(r["n_nationkey"]), r["n_name"], f'{r["n_regionkey"]},5'] for r in load(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 nations


def _scan_query(name, file, data):
    """A file made of all nations, read as a table: key, name and a text with a comma."""

    @query(name, "select n_nationkey::varchar as key, n_name as name, concat(n_regionkey, ',5') as text from nation")
    def _(s, d):
        path = f"{_folder(s)}/{file}"
        files.put_file(s, path, data([["key", "name", "text"], *_nations(s, d)]))
        return tables.read_table(s, path).drop("__rid")


_scan_query("csv_scan", "a.csv", lambda rows: ("﻿" + "\r\n".join(files.csv_line(r) for r in rows) + "\r\n\r\n").encode())
_scan_query("csv_scan_semicolons", "a.csv", lambda rows: "\n".join(";".join(r) for r in rows).encode("cp1252"))
_scan_query("csv_scan_tabs_utf16", "a.csv", lambda rows: "\r".join("\t".join(f'"{x}"' for x in r) for r in rows).encode("utf-16"))
_scan_query("xlsx_scan", "a.xlsx", lambda rows: files.xlsx_bytes({"One": rows, "Two": [["no"]]}))
_scan_query("json_scan", "a.json", lambda rows: ("[" + ", ".join('{"key": %s, "name": "%s", "text": "%s"}' % tuple(r) for r in rows[1:]) + "]").encode())


@query("csv_scan_splits", "select doc_id::varchar as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents union all select doc_id::varchar, '', coalesce(source, '') from documents")
def _(s, d):
    """All documents as CSV files with quoted line ends, half of them with other columns in another order, read in splits."""
    folder, docs = _folder(s), load(s, d, "documents")
    asis = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.select("doc_id", F.col("text"), "lang").write.options(**asis).csv(f"{folder}/a")
    docs.select(F.col("source").alias("lang"), "doc_id").write.options(**asis).csv(f"{folder}/b")
    return tables.read_table(s, f"{folder}/*").drop("__rid")


@query("xlsx_folder_scan", "select concat(f, '-', n_nationkey) as key, n_name as name from nation, range(3) t(f)")
def _(s, d):
    folder = _folder(s)
    for f in range(3):
        files.put_file(s, f"{folder}/{f}.xlsx", files.xlsx_bytes({"S": [["key", "name"], *([f"{f}-{k}", n] for k, n, _ in _nations(s, d))]}))
    return tables.read_table(s, folder).drop("__rid")


@query("txt_scan", 'select n_name as "Text" from nation')
def _(s, d):
    path = f"{_folder(s)}/a.txt"
    files.put_file(s, path, "\n\n".join(n for _, n, _ in _nations(s, d)).encode())
    return tables.read_table(s, path).drop("__rid")


@query("xlsx_to_csv", "select n_nationkey::varchar as key, n_name as name, concat(n_regionkey, ',5') as text from nation")
def _(s, d):
    folder = _folder(s)
    files.put_file(s, f"{folder}/in.xlsx", files.xlsx_bytes({"One": [["key", "name", "text"], *_nations(s, d)]}))
    tables.to_csv(s, f"{folder}/in.xlsx", f"{folder}/out")
    return files.read_csv(s, f"{folder}/out")


@query("csv_to_xlsx", "select n_nationkey::varchar as key, n_name as name, concat(n_regionkey, ',5') as text from nation")
def _(s, d):
    folder = _folder(s)
    files.put_file(s, f"{folder}/in.csv", "\n".join(files.csv_line(r) for r in [["key", "name", "text"], *_nations(s, d)]).encode())
    tables.to_xlsx(s, f"{folder}/in.csv", f"{folder}/out")
    return tables.read_table(s, f"{folder}/out").drop("__rid")


def _regions(s, d):
    return load(s, d, "region").select((4 - F.col("r_regionkey")).alias("__rid"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))


def _lines(s, folder):
    """The lines of the files of a folder, numbered in order."""
    parts = s.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value").where("value <> ''")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("x")).select(F.array_join(F.transform("x", lambda x: x["value"]), "").alias("t"))  # five regions
    return whole.select(F.posexplode(F.split("t", "\n")).alias("n", "line")).where("line <> ''")


def _sink_query(name, kind, line, header):
    sql = f"select n::int as n, line from (select 5 - r_regionkey {'' if header else '- 1'} as n, {line} as line from region{f' union all select 0, {header}' if header else ''})"

    @query(name, sql)
    def _(s, d):
        folder = f"{_folder(s)}/out"
        files.write_table(_regions(s, d), folder, kind)
        return _lines(s, folder)


_sink_query("txt_sink", "TXT", "concat(r_name, chr(9), r_regionkey)", "concat('name', chr(9), 'key')")
_sink_query("json_sink", "JSON", "concat('{\"name\":\"', r_name, '\",\"key\":\"', r_regionkey, '\"}')", "")


def _one_file_query(name, kind, sql):
    """All documents with their source, written by many tasks as one file, and its lines with their numbers."""

    @query(name, sql)
    def _(s, d):
        path = f"{_folder(s)}/out.{kind.lower()}"
        rows = load(s, d, "documents").select(F.col("doc_id").alias("__rid"), F.col("doc_id").alias("id"), F.concat(F.lit("a "), F.coalesce("source", F.lit("")), F.lit(', "b"')).alias("name"))
        files.write_table(rows, path, kind)
        assert s.read.format("binaryFile").load(path).count() == 1
        return s.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))


_ONE = "(select doc_id as id, concat('a ', coalesce(source, ''), ', \"b\"') as name, row_number() over (order by doc_id) as k from documents)"
_one_file_query("csv_one_file", "CSV", f"select k::int as n, concat(id, ',\"', replace(name, '\"', '\"\"'), '\"') as line from {_ONE} union all select 0, 'id,name'")
_one_file_query("txt_one_file", "TXT", f"select k::int as n, concat(id, chr(9), name) as line from {_ONE} union all select 0, concat('id', chr(9), 'name')")
_one_file_query(
    "json_one_file", "JSON",
    f"with o as {_ONE}, z as (select count(*) as m from o) select 0 as n, '[' as line union all select (4 * m + 1)::int, ']' from z"
    " union all select (4 * k - 3 + j)::int, case j when 0 then '  {' when 1 then concat('    \"id\": \"', id, '\",') when 2 then concat('    \"name\": \"', replace(name, '\"', chr(92) || '\"'), '\"') when 3 then case when k = m then '  }' else '  },' end end from o, z, (values (0), (1), (2), (3)) t(j)",
)


@query("xlsx_sink", "select r_name as name, r_regionkey::varchar as key from region")
def _(s, d):
    folder = f"{_folder(s)}/out"
    files.write_table(_regions(s, d), folder, "XLSX")
    return tables.read_table(s, folder).drop("__rid")


def _names(s, d) -> str:
    return "\n".join(f"{r['n_name']}, {r['n_regionkey']}" for r in load(s, d, "nation").orderBy("n_nationkey").collect())  # 25 nations


@query("flow_export_text", "select (row_number() over (order by n_nationkey) - 1)::int as n, concat(n_name, ', ', n_regionkey) as line from nation")
def _(s, d):
    folder = f"{_folder(s)}/out"
    workflow.run(s, [workflow.Step("PASTE_TEXT", _names(s, d)), workflow.Step("EXPORT_TXT", options={"path": folder})])
    return _lines(s, folder)


@query("flow_export_text_csv", "select concat(n_name, ', ', n_regionkey) as \"Text\" from nation")
def _(s, d):
    folder = f"{_folder(s)}/out"
    workflow.run(s, [workflow.Step("PASTE_TEXT", _names(s, d)), workflow.Step("EXPORT_CSV", options={"path": folder})])
    return files.read_csv(s, folder)


@query("flow_load_sheet", "select n_nationkey::varchar as key, n_name as name from nation where n_nationkey::varchar like '%1%'")
def _(s, d):
    path = f"{_folder(s)}/in.csv"
    files.put_file(s, path, "\n".join(";".join(r[:2]) for r in [["key", "name"], *_nations(s, d)]).encode())
    return workflow.run(s, [workflow.Step("LOAD_SHEET", options={"path": path}), workflow.Step("FILTER_ROWS", options={"value": "1", "column": "key"})]).df.drop("__rid")


@query("flow_scrape_summary", "select unnest(['Title', 'URL', 'Links found', 'Text preview']) as \"Field\", unnest([concat('T ', n_name), concat('https://x.example/', n_nationkey), '1', 'Only words.']) as \"Value\" from nation")
def _(s, d):
    folder = f"{_folder(s)}/pages"
    html = F.concat(F.lit("<html><head><title>T "), "n_name", F.lit('</title></head><body><p>Only <a href="#a">words</a>.</p></body></html>'))
    load(s, d, "nation").select(F.concat(F.lit("https://x.example/"), "n_nationkey").alias("url"), html.alias("html")).write.parquet(folder)
    return workflow.run(s, [workflow.Step("SCRAPE_URL", options={"path": folder})]).df.drop("__rid")


@query("csv_sink_guarded", "select n_nationkey::varchar as key, concat(chr(39), '=', n_name) as \"'=value\" from nation")
def _(s, d):
    folder = f"{_folder(s)}/out"
    files.write_csv(load(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("="), "n_name").alias("=value")), folder)
    return s.read.option("header", True).csv(folder)


@query("files_by_size_and_age", "select concat(n_nationkey, '.txt') as name, true as old from nation where length(n_name) <= 6")
def _(s, d):
    folder = _folder(s)
    for key, name, _ in _nations(s, d):
        files.put_file(s, f"{folder}/{key}.txt", name.encode())
    old = tables.stale(s, folder, "2999-01-01 00:00:00").select("path", F.lit(True).alias("old"))
    return tables.within(s, folder, 6).join(old, "path").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "old")


@query(
    "sheet_dependents",
    "select 'orders' as sheet, o_orderkey::bigint as \"row\", 1::bigint as col from orders where o_orderkey % 100 = 0"
    " union all select 'orders', o_orderkey, 2 from orders where o_orderkey % 100 = 0 or o_orderkey % 100 >= 98 and o_orderkey // 100 * 100 + 100 <= (select max(o_orderkey) from orders)"
    " union all select 'orders', o_orderkey, 3 from orders where o_orderkey % 100 < 50",
)
def _(s, d):
    """A sheet with a row for each order: doubles, sums of three rows, and running sums that begin anew every 50 rows."""
    r = "o_orderkey"
    inputs = f"array(string(o_totalprice), concat('=A', {r} + 1, '*2'), concat('=SUM(B', {r} + 1, ':B', {r} + 3, ')'), if({r} % 50 = 0, concat('=A', {r} + 1), concat('=D', {r}, '+A', {r} + 1)))"
    cells = load(s, d, "orders").selectExpr("'orders' as sheet", f"{r} as row", f"posexplode({inputs}) as (col, input)")
    edits = load(s, d, "orders").where(f"{r} % 100 = 0").selectExpr("'orders' as sheet", f"{r} as row", "0 as col")
    return dependents.dependents(cells, edits, 4096)


_EVENT_RUNS = "event_id as id, event_type as feature, (value > 50)::int as qualityScore, user_id, (epoch_us(ts) // 1000)::bigint as timestamp from events"


@query(
    "history_written",
    f"with r as (select {_EVENT_RUNS}), e as (select id, feature, case when user_id = 7 then 99 else qualityScore end as qualityScore, timestamp from r where timestamp >= 1704844800000 + 3600000 and feature <> 'error')"
    " select id, feature, qualityScore, timestamp from e order by timestamp desc, id desc limit 5000",
)
def _(s, d):
    """All events as runs of a history by days: inserted twice, updated, expired, deleted from, and cut to the newest 5,000."""
    runs = load(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("feature"), (F.col("value") > 50).cast("int").alias("qualityScore"), "user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000").alias("timestamp"))
    table = HistoryTable(s, f"{_folder(s)}/history", "id bigint, feature string, qualityScore int, user_id bigint, timestamp bigint")
    table.insert(runs)
    table.insert(runs.where("id % 3 = 0"))
    table.update(F.col("user_id") == 7, qualityScore=99)
    table.expire(1704844800000 + 3600000)
    table.delete(F.col("feature") == "error")
    table.keep_newest(5000)
    return table.rows().select("id", "feature", "qualityScore", "timestamp")


@query("cache_lookups", f"select * from {_RUNS} where status = 'SUCCESS' qualify row_number() over (partition by feature, inputHash order by timestamp desc, id desc) = 1")
def _(s, d):
    """The cached run of every feature and input, from files clustered by hash."""
    folder = f"{_folder(s)}/cache"
    cache_files.write(runs(s, d), folder)
    return cache_files.lookups(s, folder, runs(s, d))


query("history_append", f"select id, feature, status from {_RUNS} union all select id + 1000000000, 'COPY', null from {_RUNS} where id % 10 = 0")(
    lambda s, d: history.inserted(runs(s, d), runs(s, d).where("id % 10 = 0").select((F.col("id") + 1000000000).alias("id"), F.lit("COPY").alias("feature"))).select("id", "feature", "status")
)
query("history_all_capped", f"select * from {_RUNS} order by timestamp desc, id desc limit 2000")(lambda s, d: history.recent(runs(s, d), 2000))

_PAIR = "case c_custkey % 4 when 0 then c_name when 1 then concat('x', substring(c_name, 3)) when 2 then '' else concat(c_name, c_mktsegment) end"


@query("string_similarity", f"select c_custkey as id, case when c_name = o then 1.0 else 1 - levenshtein(c_name, o) / greatest(length(c_name), length(o)) end::double as similarity from (select c_custkey, c_name, {_PAIR} as o from customer)")
def _(s, d):
    pairs = load(s, d, "customer").withColumn("o", F.expr(_PAIR))
    return pairs.select(F.col("c_custkey").alias("id"), cells.similarity(F.col("c_name"), F.col("o")).cast("double").alias("similarity"))


@query("dangerous_formulas", "select c_custkey as id, c_custkey % 5 in (0, 1, 4) as dangerous from customer")
def _(s, d):
    k = F.col("c_custkey")
    kinds = [F.concat(F.lit("cmd|' /c calc"), k, F.lit("'!A0")), F.concat(F.lit('=WebService ("http://x/'), k, F.lit('")')), F.concat(F.lit("=SUM(A1:A"), k, F.lit(")")), F.concat(F.lit("a|b"), k), F.concat(F.lit("1+EXEC("), k, F.lit(")"))]
    return load(s, d, "customer").select(k.alias("id"), cells.dangerous_formula(F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))).alias("dangerous"))


@query("invoice_items_check", "select id, abs(items - subtotal) > greatest(0.02, 0.01 * greatest(items, subtotal)) as items_review from (select l_orderkey as id, sum(floor(l_extendedprice))::double as items, sum(floor(l_extendedprice))::double + (l_orderkey % 3) * 5000 as subtotal from lineitem group by l_orderkey)")
def _(s, d):
    """The lines of every order as an invoice's items, held against a subtotal that is right for every third order."""
    amount = F.floor("l_extendedprice")
    item = F.struct(F.lit("line").alias("description"), F.lit("1").alias("quantity"), amount.cast("string").alias("unit_price"), amount.cast("string").alias("amount"))
    orders = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item.cast(invoices.ITEM)).alias("items"), F.sum(amount).alias("n"))  # an order's lines
    some = orders.select("id", "items", (F.col("n") + F.col("id") % 3 * 5000).cast("string").alias("subtotal"), F.lit("").alias("tax"), F.lit("").alias("total"))
    return invoices.checked(some).select("id", "items_review")


@query("layout_rows", "select n_nationkey::bigint as page_id, unnest([0, 1, 2])::int as row, unnest([concat('a|', n_name, '|'), '||', 'x|y|z']) as line from nation")
def _(s, d):
    text = F.concat(F.lit("Title\na\t"), "n_name", F.lit("\nprose\nx\ty\tz\nend"))
    pages = load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), text.alias("text"))
    return layout.rows_of_pages(pages).select("page_id", "row", F.array_join("cells", "|").alias("line"))


# PDF files: one of two pages for each nation, made, put together, cut and turned in tasks.
def _pdfs(s, d):
    def run(batches):
        for batch in batches:
            yield batch[["key", "place"]].assign(content=[pdf.text_pdf(f"{n}\n" + "x\n" * 80 + f"end of {n}")[0] for n in batch["name"]])

    return load(s, d, "nation").selectExpr("n_regionkey as key", "n_nationkey as place", "n_name as name").mapInPandas(run, "key int, place int, content binary")


def _pages(df, *keep):
    def run(batches):
        for batch in batches:
            rows = [(*k, n, t.split("\n")[0], int(p.get("Rotate") or 0)) for *k, data in zip(*(batch[c] for c in (*keep, "content"))) for f in [pdf.File(bytes(data))] for n, (p, t) in enumerate(((p, pdf.page_text(f, p)) for p in f.pages()), 1)]
            yield pd.DataFrame(rows, columns=[*keep, "page", "first", "turned"])

    return df.mapInPandas(run, ", ".join(f"{k} int" for k in keep) + ", page int, first string, turned int")


@query("pdf_merge", "select n_regionkey::int as key, (2 * row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as page, n_name as first from nation")
def _(s, d):
    return _pages(pdf.merged_by(_pdfs(s, d), "key", "place"), "key").where("page % 2 = 1").select("key", "page", "first")


@query("pdf_page_range", "select n_nationkey::int as place, 1 as page, true as has_end from nation")
def _(s, d):
    second = pdf.edited(_pdfs(s, d), lambda x: pdf.page_range(x, 2, 9)).drop("error")
    texts = batches.pdf_texts(second.select(F.col("place").cast("string").alias("path"), "content"))
    return _pages(second, "place").join(texts, F.col("place").cast("string") == F.col("path")).select("place", "page", F.contains("text", F.lit("end of ")).alias("has_end"))


@query("pdf_rotate", "select n_nationkey::int as place, unnest([1, 2])::int as page, 270 as turned from nation")
def _(s, d):
    turned = pdf.edited(pdf.edited(_pdfs(s, d), lambda x: pdf.rotated(x, 180)).drop("error"), pdf.rotated).drop("error")
    return _pages(turned, "place").select("place", "page", "turned")


@query("pdf_page_count", "select n_nationkey::int as place, '2' as pages from nation")
def _(s, d):
    return pdf.edited(_pdfs(s, d), lambda x: str(pdf.page_count(x)).encode()).select("place", F.col("content").cast("string").alias("pages"))
