"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL.

Messy inputs are derived from clean tables by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import cells
from .operators import cleaning, dedupe, emails, history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Messy tables: (table, select list that Spark and DuckDB share).
CUSTOMER = (
    "customer",
    {
        "id": "c_custkey",
        "name": "case c_custkey % 3 when 0 then concat('  ', lower(c_name), '   Ltd ') when 1 then concat(upper(c_name), ' ltd') else concat(c_name, '  LTD~^') end",
        "email": "case c_custkey % 6 when 0 then concat(' Customer.', c_custkey, '@Example.COM ') when 1 then concat('c', c_custkey, '@mail.example.org') when 2 then '' when 3 then concat('no-address-', c_custkey) when 4 then concat('x', c_custkey, '@b') else concat('A_', c_custkey, '@co.uk') end",
        "phone": "case c_custkey % 5 when 0 then concat('(555) 12', c_custkey % 10, '-4567') when 1 then concat('+91 98765 4321', c_custkey % 10) when 2 then concat('1-555-123-456', c_custkey % 10) when 3 then '12345' else concat('0919876543', 200 + c_custkey % 100) end",
        "segment": "c_mktsegment",
        "member": "case c_custkey % 6 when 0 then 'Y' when 1 then ' true ' when 2 then '0' when 3 then 'F' when 4 then 'maybe' else 'no' end",
        "amount": "concat(cast(floor(c_acctbal) as bigint), '')",
    },
)
ORDERS = (
    "orders",
    {
        "id": "o_orderkey",
        "day": "case o_orderkey % 6 when 0 then concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate)) when 1 then concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) when 2 then concat(' ', day(o_orderdate), ' ', substring('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 as int), 3), ' ', year(o_orderdate)) when 3 then concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(o_orderdate) * 3 - 2 as int), 3), ' ', day(o_orderdate), ', ', year(o_orderdate)) when 4 then concat(month(o_orderdate), '.', day(o_orderdate), '.', year(o_orderdate) % 100) else concat('31/', month(o_orderdate), '/', year(o_orderdate)) end",
        "price": "case o_orderkey % 6 when 0 then concat('$', cast(floor(o_totalprice) as bigint), '.25') when 1 then concat('(₹', cast(floor(o_totalprice) as bigint), ')') when 2 then concat('Rs. ', cast(floor(o_totalprice) as bigint), '.50') when 3 then concat(cast(floor(o_totalprice) as bigint), ' USD') when 4 then '--' else concat('€ 1,', 100 + o_orderkey % 900) end",
        "priority": "o_orderpriority",
        "quantity": "case o_orderkey % 7 when 0 then '' when 1 then concat('-', o_orderkey % 50) else concat('', o_orderkey % 50) end",
    },
)
EVENTS = (
    "events",
    {
        "id": "event_id",
        "kind": "case event_id % 5 when 0 then '' when 1 then '  ' else event_type end",
        "who": "case event_id % 5 when 0 then '' when 2 then ' ' else concat('u', user_id) end",
        "note": "case event_id % 5 when 0 then ' ' when 3 then '' else props end",
    },
)


def messy(spark, sf_dir, table) -> DataFrame:
    name, fields = table
    return load(spark, sf_dir, name).selectExpr(*[f"{e} as {c}" for c, e in fields.items()])


def messy_sql(table) -> str:
    name, fields = table
    return f"(select {', '.join(f'{e} as {c}' for c, e in fields.items())} from {name})"


TRIM = r"regexp_replace(@@, '^\s+|\s+$', '', 'g')"


def cell_query(name: str, table, source: str, made: Callable[[Column], Column], sql: str) -> None:
    """One cell expression over a messy column: (id, value)."""
    query(name, f"select id, {sql.replace('@@', source)} as value from {messy_sql(table)}")(lambda s, d: messy(s, d, table).select("id", made(F.col(source)).alias("value")))


def _date_sql(first: str) -> str:
    part = lambda p, g: f"try_cast(regexp_extract(v, '{p}', {g}) as int)"
    iso, dmy, mdy, num = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[\s-]+([A-Za-z]{3,9})[\s,-]+(\d{2,4})$", r"^([A-Za-z]{3,9})[\s,]+(\d{1,2}),?\s+(\d{2,4})$", r"^(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})$"
    month = lambda p, g: "list_position(['" + "','".join(cells.MONTHS) + f"'], lower(substring(regexp_extract(v, '{p}', {g}), 1, 3)))"
    yr = lambda p, g: f"case when length(regexp_extract(v, '{p}', {g})) <= 2 then case when {part(p, g)} <= 30 then 2000 + {part(p, g)} else 1900 + {part(p, g)} end else {part(p, g)} end"
    made = lambda y, m, d: f"strftime(try_cast(concat(lpad(cast({y} as varchar), 4, '0'), '-', lpad(cast({m} as varchar), 2, '0'), '-', lpad(cast({d} as varchar), 2, '0')) as date), '%Y-%m-%d')"
    a, b, y = part(num, 1), part(num, 2), yr(num, 3)
    by_hint = made(y, a, b) if first == "month" else made(y, b, a)
    return f"""(select case when regexp_matches(v, '{iso}') then {made(part(iso, 1), part(iso, 2), part(iso, 3))}
      when regexp_matches(v, '{dmy}') then {made(yr(dmy, 3), month(dmy, 2), part(dmy, 1))}
      when regexp_matches(v, '{mdy}') then {made(yr(mdy, 3), month(mdy, 1), part(mdy, 2))}
      when regexp_matches(v, '{num}') then case when {a} > 12 and {b} <= 12 then {made(y, b, a)} when {b} > 12 and {a} <= 12 then {made(y, a, b)} else {by_hint} end end
      from (select trim(@@) as v))"""


PHONE_SQL = "(select case when length(x) = 10 then x when length(x) = 11 and x like '1%' then substring(x, 2) when length(x) = 12 and x like '91%' then substring(x, 3) when length(x) = 13 and x like '091%' then substring(x, 4) end from (select regexp_replace(@@, '[^0-9]', '', 'g') as x))"
EMAIL_SQL = f"(select case when regexp_full_match(x, '{cells.EMAIL}') then x end from (select lower(trim(@@)) as x))"
NUMBER_SQL = r"""(select case when n = '' then null when t like '(%)' then -abs(try_cast(n as double)) else try_cast(n as double) end from (select t, regexp_replace(regexp_replace(regexp_replace(t, '^\((.*)\)$', '\1'), '(?i)\b(INR|USD|EUR|GBP|Rs\.?)\s*', '', 'g'), '[₹$€£,\s]', '', 'g') as n from (select trim(@@) as t)))"""
CURRENCY_SQL = r"""(select case when s = floor(s) then cast(cast(s as bigint) as varchar) else cast(s as varchar) end from (select case when t like '(%)' then -abs(n) else n end as s from (select t, try_cast(regexp_replace(regexp_replace(t, '(?i)[₹$€£,\s]|INR|USD|EUR|GBP|Rs\.?', '', 'g'), '[^0-9.\-]', '', 'g') as double) as n from (select trim(@@) as t))))"""
BOOL_SQL = "(select case when x in ('yes','y','true','t','1') then 'Yes' when x in ('no','n','false','f','0') then 'No' end from (select lower(trim(@@)) as x))"

cell_query("clean_trim", CUSTOMER, "name", cells.ws_trim, TRIM)
cell_query("clean_collapse", CUSTOMER, "name", cells.collapse, r"regexp_replace(@@, '\s+', ' ', 'g')")
cell_query("clean_strip_unwanted", CUSTOMER, "name", cells.strip_unwanted, r"regexp_replace(@@, '[~^]', '', 'g')")
cell_query("clean_case_lower", CUSTOMER, "name", lambda c: cells.change_case(c, "LOWER"), "lower(@@)")
cell_query("clean_case_upper", CUSTOMER, "name", lambda c: cells.change_case(c, "UPPER"), "upper(@@)")
cell_query("clean_case_title", CUSTOMER, "name", cells.title, "array_to_string(list_transform(string_split(@@, ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')")
cell_query("clean_replace_literal", CUSTOMER, "name", lambda c: cells.replace_all(c, "LTD", "$1 GmbH", ignore_case=True), "regexp_replace(@@, 'ltd', '$1 GmbH', 'gi')")
cell_query("clean_replace_regex", CUSTOMER, "name", lambda c: cells.replace_all(c, "#0*(\\d+)", "No $1", regex=True), r"regexp_replace(@@, '#0*(\d+)', 'No \1', 'g')")
cell_query("clean_email_normalize", CUSTOMER, "email", cells.normal_email, EMAIL_SQL)
cell_query("clean_phone_normalize", CUSTOMER, "phone", cells.normal_phone, PHONE_SQL)
cell_query("clean_boolean_normalize", CUSTOMER, "member", cells.normal_boolean, BOOL_SQL)
cell_query("clean_date_normalize", ORDERS, "day", cells.normal_date, _date_sql("day"))
cell_query("clean_date_month_first", ORDERS, "day", lambda c: cells.normal_date(c, True), _date_sql("month"))
cell_query("clean_currency_normalize", ORDERS, "price", cells.normal_currency, CURRENCY_SQL)
cell_query("parse_number", ORDERS, "price", cells.parse_number, NUMBER_SQL)
cell_query("csv_sanitize", ORDERS, "quantity", lambda c: cells.guarded(F.concat(F.lit("="), c)), "case when length(@@) > 0 then concat(chr(39), '=', @@) else concat('=', @@) end")
cell_query("sha256_key", CUSTOMER, "name", cells.content_key, "sha256(@@)")
cell_query("format_number", CUSTOMER, "id", lambda c: cells.format_number(c / 7.0), "printf('%.2f', floor(@@ / 7.0 * 100.0 + 0.5) / 100.0)")
cell_query("quality_label", CUSTOMER, "id", lambda c: cells.quality_label(c % 101), "case when @@ % 101 >= 85 then 'Excellent' when @@ % 101 >= 65 then 'Good' when @@ % 101 >= 40 then 'Fair' else 'Poor' end")
cell_query("duration_text", CUSTOMER, "id", lambda c: cells.duration_text(c * 250), "case when @@ * 250 < 1000 then concat(@@ * 250, 'ms') else printf('%.1fs', floor(@@ * 250 / 100.0 + 0.5) / 10.0) end")
cell_query("numeric_range_flags", CUSTOMER, "amount", lambda c: c.try_cast("double") < F.lit(cleaning.numeric_range("amount")[0]), "try_cast(@@ as double) < 0")
cell_query("approximately_equal", CUSTOMER, "id", lambda c: cells.nearly(c.cast("double"), c * 1.0 + c % 5), "abs(@@ - (@@ * 1.0 + @@ % 5)) <= greatest(0.02, (@@ * 1.0 + @@ % 5) * 0.01)")
_ref = lambda c: F.concat(F.char(65 + c % 26), F.char(65 + c % 7), c.cast("string"))
cell_query("cell_reference", CUSTOMER, "id", lambda c: cells.cell_column(_ref(c)).cast("long") * 10_000_000 + cells.cell_row(_ref(c)), "((1 + @@ % 26) * 26 + @@ % 7) * 10000000::bigint + @@ - 1")
cell_query("size_text", CUSTOMER, "id", lambda c: cells.size_text(c * 1700), "case when @@ * 1700 >= 1000000 then printf('%.1f MB', floor(@@ * 1700 / 100000.0 + 0.5) / 10.0) when @@ > 0 then printf('%.1f KB', floor(@@ * 1700 / 100.0 + 0.5) / 10.0) else '0 B' end")
cell_query("sheet_name", CUSTOMER, "name", lambda c: cells.safe_sheet_name(F.concat(c, F.lit(":/[x]*?"), c)), "substring(regexp_replace(concat(@@, ':/[x]*?', @@), '[\\\\/?*\\[\\]:]', '_', 'g'), 1, 31)")


@query("clean_calculated_column", "select l_orderkey, l_linenumber, printf('%.2f', floor(cast(l_quantity as double) * l_discount * 100.0 + 0.5) / 100.0) as value from lineitem")
def _(s, d):
    value = cells.format_number(cells.calculate(cells.parse_number(F.col("l_quantity").cast("string")), "MULTIPLY", cells.parse_number(F.col("l_discount").cast("string"))))
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


@query("divide_by_zero", "select l_orderkey, l_linenumber, case when l_discount <> 0 then l_tax / l_discount end as value from lineitem")
def _(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", cells.calculate(F.col("l_tax"), "DIVIDE", F.col("l_discount")).alias("value"))


_EVENT = f"(select id, regexp_replace(trim(kind), '\\s+', ' ', 'g') as kind, regexp_replace(trim(who), '\\s+', ' ', 'g') as who, regexp_replace(trim(note), '\\s+', ' ', 'g') as note from {messy_sql(EVENTS)})"
_AS_TEXT = dict.fromkeys(("kind", "who", "note"), "TEXT")


def _events(s, d, o: cleaning.Options):
    df = messy(s, d, EVENTS).withColumnRenamed("id", cleaning.RID)
    return cleaning.clean(df, o, _AS_TEXT)[0].withColumnRenamed(cleaning.RID, "id")


query("drop_empty_rows", f"select * from {_EVENT} where kind <> '' or who <> '' or note <> ''")(lambda s, d: _events(s, d, cleaning.Options(exact=False)))
query("drop_missing_required", f"select * from {_EVENT} where kind <> ''")(lambda s, d: _events(s, d, cleaning.Options(exact=False, missing="REMOVE_ROW", required=("kind",))))
# Gaps are filled before empty rows go, so that there are none.
query("missing_fill", f"select id, case when kind = '' then 'unknown' else kind end as kind, case when who = '' then 'unknown' else who end as who, case when note = '' then 'unknown' else note end as note from {_EVENT}")(lambda s, d: _events(s, d, cleaning.Options(exact=False, missing="FILL", fill="unknown")))


@query("missing_flag", f"select sum((kind = '')::int + (who = '')::int + (note = '')::int)::bigint as missing_values_found, sum((kind = '')::int + (who = '')::int + (note = '')::int)::bigint as missing_values_flagged, 0::bigint as missing_values_filled, count(*) filter (kind = '' and who = '' and note = '')::bigint as empty_rows_removed from {_EVENT}")
def _(s, d):
    df = messy(s, d, EVENTS).withColumnRenamed("id", cleaning.RID)
    return cleaning.report(df, cleaning.Options(exact=False, missing="FLAG"), _AS_TEXT)[0].select("missing_values_found", "missing_values_flagged", "missing_values_filled", "empty_rows_removed")


def _votes_sql() -> str:
    """The vote of each column's first 50 values: the best type of those whose pattern the most match, the earlier on ties."""
    columns = list(CUSTOMER[1])
    long = " union all ".join(f"select id, '{c}' as col, trim(concat({c}, '')) as v from {messy_sql(CUSTOMER)}" for c in columns)
    shares = ", ".join(f"avg(regexp_full_match(v, '{p.replace(chr(39), chr(39) * 2)}')::int) as s{i}" for i, p in enumerate(cells.TYPES.values()))
    best = f"greatest({', '.join(f's{i}' for i in range(len(cells.TYPES)))})"
    named = " ".join(f"when s{i} = {best} then '{t}'" for i, t in enumerate(cells.TYPES))
    return f"with l as ({long}), f as (select * from (select *, row_number() over (partition by col order by id) as n from l where v <> '') where n <= 50), s as (select col, {shares} from f group by col) select col, case when {best} < 0.8 then 'TEXT' else case {named} end end as type from s"


@query("detect_column_types", _votes_sql())
def _(s, d):
    found = cleaning.detect(cleaning.with_ordinals(messy(s, d, CUSTOMER), "id"))
    return s.createDataFrame(list(found.items()), "col string, type string")


@query("dedupe_exact", "select min(doc_id) as doc_id, text from documents group by text")
def _(s, d):
    return dedupe.keep_first(load(s, d, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query("dedupe_key_columns", "select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) as n from documents) where n = 1")
def _(s, d):
    return dedupe.keep_first(load(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query("dedupe_normalized", f"select id, segment, member from (select *, row_number() over (partition by lower(trim(segment)), lower(trim(member)) order by id) as n from {messy_sql(CUSTOMER)}) where n = 1")
def _(s, d):
    return dedupe.keep_first(messy(s, d, CUSTOMER).select("id", "segment", "member"), ["segment", "member"], "id", normalised=True)


# Three names for each customer: the second is near the first, the third near the second, and for some near the first too.
_NAMES = "(select c_custkey * 3 + k as id, case k when 0 then m when 1 then concat('zz', substring(m, 3)) when 2 then concat('zz', substring(m, 3, case c_custkey % 3 when 0 then 30 else 28 end), case c_custkey % 3 when 0 then '' else 'yy' end) end as name from (select c_custkey, md5(concat('', c_custkey)) as m, k from customer, (values (0), (1), (2)) t(k)))"
_FAR = "1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) < 0.92"


@query(
    "dedupe_similarity",
    f"with n as {_NAMES}, w as (select id // 3 as c, max(name) filter (id % 3 = 0) as a, max(name) filter (id % 3 = 1) as b, max(name) filter (id % 3 = 2) as d from n group by 1),"
    f" k as (select *, {_FAR.format('a', 'b')} as keep_b from w), l as (select *, {_FAR.format('a', 'd')} and (not keep_b or {_FAR.format('b', 'd')}) as keep_d from k)"
    " select id, name from n join l on l.c = n.id // 3 where n.id % 3 = 0 or n.id % 3 = 1 and keep_b or n.id % 3 = 2 and keep_d",
)
def _(s, d):
    one = load(s, d, "customer").selectExpr("c_custkey", "md5(concat('', c_custkey)) as m", "explode(array(0, 1, 2)) as k")
    names = one.selectExpr("c_custkey * 3 + k as id", "case k when 0 then m when 1 then concat('zz', substring(m, 3)) else concat('zz', substring(m, 3, case c_custkey % 3 when 0 then 30 else 28 end), case c_custkey % 3 when 0 then '' else 'yy' end) end as name")
    return dedupe.drop_similar(names, ["name"], "id")


_LONG = "concat({})".format(", ".join(f"md5(concat('{i}-', s_suppkey, '-', {{0}}))" for i in range(10)))


@query("dedupe_similarity_long", f"select s_suppkey * 3 + k as id, {_LONG.format('k')} as name from supplier, (values (0), (2)) t(k)")
def _(s, d):
    """Names of 320 letters: the second of a supplier is 16 edits from its first, the third has nothing in common with them."""
    one = load(s, d, "supplier").selectExpr("s_suppkey", "explode(array(0, 1, 2)) as k").withColumn("m", F.expr(_LONG.format("if(k = 1, 0, k)")))
    edited = "concat('zzz', substring(m, 4, 97), 'yyy', substring(m, 101, 100), substring(m, 206, 110), 'xx', 'www')"
    return dedupe.drop_similar(one.selectExpr("s_suppkey * 3 + k as id", f"if(k = 1, {edited}, m) as name"), ["name"], "id")


_TYPES = "Product ARTICLE newsArticle BlogPosting recipe Event Book Movie JobPosting Restaurant localbusiness SoftwareApplication Offer Organization".split()


@query("html_linked_types", "select concat('https://x.example/', p_partkey) as url, case when p_partkey % 14 = 13 then 'page' else 'json-ld' end as strategy, case when p_partkey % 14 = 13 then concat('T ', p_partkey) else p_name end as name from part")
def _(s, d):
    """A page for each part with linked data of one of the record types in any case, or of another type, which is no record."""
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("p_partkey") % 14 + 1).cast("int"))
    html = F.concat(F.lit("<title>T "), "p_partkey", F.lit('</title><script type="application/ld+json">{"@type": "'), kind, F.lit('", "name": "'), "p_name", F.lit('"}</script>'))
    return records.extract(load(s, d, "part").select(F.concat(F.lit("https://x.example/"), "p_partkey").alias("url"), html.alias("html"))).select("url", "strategy", "name")


def _clean(s, d):
    df = messy(s, d, ORDERS).select("id", "day", "price", "priority").withColumnRenamed("id", cleaning.RID)
    return cleaning.clean(df, cleaning.Options(), {"day": "DATE", "price": "CURRENCY", "priority": "TEXT"})


_cleaned = f"""with m as (select id, regexp_replace(trim(day), '\\s+', ' ', 'g') as day, regexp_replace(trim(price), '\\s+', ' ', 'g') as price, priority from {messy_sql(ORDERS)}),
c as (select *, {_date_sql("day").replace('@@', 'day')} as day2, {CURRENCY_SQL.replace('@@', 'price')} as price2 from m)"""


@query("clean_pipeline", _cleaned + " select min(id) as id, coalesce(day2, day) as day, coalesce(price2, price) as price, priority from c group by 2, 3, 4")
def _(s, d):
    return _clean(s, d)[0].withColumnRenamed(cleaning.RID, "id")


@query("clean_invalid_cells", _cleaned + " select id, 'day' as col, (select day from " + messy_sql(ORDERS) + " o where o.id = c.id) as value, 'DATE' as expected from c where day2 is null union all select id, 'price', (select price from " + messy_sql(ORDERS) + " o where o.id = c.id), 'CURRENCY' from c where price2 is null union all select id, 'price', price2, 'NUMBER' from c where price2::double < 0")
def _(s, d):
    return _clean(s, d)[1].select(F.col(cleaning.RID).alias("id"), F.col("column").alias("col"), "value", "expected")


@query("clean_remove_invalid_rows", f"select id, email from (select id, trim(email) as raw, {EMAIL_SQL.replace('@@', 'email')} as email from {messy_sql(CUSTOMER)}) where email is not null")
def _(s, d):
    df = messy(s, d, CUSTOMER).select(F.col("id").alias(cleaning.RID), "email")
    out, _ = cleaning.clean(df, cleaning.Options(action="REMOVE_ROW", exact=False), {"email": "EMAIL"})
    return out.select(F.col(cleaning.RID).alias("id"), "email")


@query("table_quality", f"select cast(floor(least(100, sum(f) / (count(*) * 3) * 50 + 35 + count(distinct k) / count(*) * 15)) as int) as score from (select (case when trim(kind) = '' then 0 else 1 end + case when trim(who) = '' then 0 else 1 end + case when trim(note) = '' then 0 else 1 end)::double as f, concat_ws('|', kind, who, note) as k from {messy_sql(EVENTS)})")
def _(s, d):
    return cleaning.table_quality(messy(s, d, EVENTS).withColumnRenamed("id", cleaning.RID))


@query("text_quality", r"""select doc_id, case when trim(text) = '' then 0 else cast(floor(least(100.0, greatest(0.0, least(1.0, length(trim(text)) / 20.0) * 30 + length(regexp_replace(text, '[^\p{L}\p{Nd}\s.,;:!?()''"_/@%&-]', '', 'g')) / length(text)::double * 30
  + case when list_sum(list_transform(w, lambda x: length(x))) / len(w)::double between 2.0 and 12.0 then 20.0 else 8.0 end + (1.0 - len(list_filter(l, lambda x: trim(x) = '')) / len(l)::double) * 20))) as int) end as score
  from (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w, string_split(text, chr(10)) as l from documents)""")
def _(s, d):
    return load(s, d, "documents").select("doc_id", cells.text_quality("text").alias("score"))


@query("word_char_count", r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as words, length(text)::int as chars from documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", cells.word_count("text").alias("words"), cells.char_count("text").alias("chars"))


_MAILS = rf"""with t as (select doc_id, unnest(regexp_split_to_array(text, '\s+')) as token from documents),
c as (select doc_id, regexp_replace(unnest(regexp_extract_all(token, '{cells.EMAIL}')), '^[.,_-]+|[.,_-]+$', '', 'g') as e from t where length(token) between 5 and 320 and contains(token, '@')),
v as (select doc_id, e, regexp_full_match(e, '{cells.EMAIL}') and length(e) <= 254 and length(split_part(e, '@', 1)) <= 64 and e not like '%..%' and e not like '.%' and split_part(e, '@', 1) not like '%.' and not regexp_matches(split_part(e, '@', 2), '(^|[.])-|-([.]|$)') as good from c)"""


@query("emails_extract", _MAILS + " select distinct doc_id, lower(e) as email from v where good")
def _(s, d):
    return emails.extract(load(s, d, "documents"), "text", "doc_id").select("doc_id", F.explode("emails").alias("email"))


@query("emails_duplicates", _MAILS + " select doc_id, (count(*) - count(distinct lower(e)))::int as duplicates_removed from v where good group by doc_id")
def _(s, d):
    return emails.extract(load(s, d, "documents"), "text", "doc_id").where("size(emails) > 0").select("doc_id", "duplicates_removed")


@query("emails_quality", f"select cast(floor(count(*) filter (regexp_full_match(email, '{cells.EMAIL}')) / count(*) * 70 + count(distinct email) / count(*) * 30) as int) as score from {messy_sql(CUSTOMER)}")
def _(s, d):
    return emails.list_quality(messy(s, d, CUSTOMER))


@query("privacy_mask", r"select doc_id, regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***@\2', 'g'), '\b(?:\d[ -]?){8,15}(\d)[ -]?(\d)[ -]?(\d)[ -]?(\d)[ -]?\b', '••••\1\2\3\4', 'g') as masked from documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", cells.masked("text").alias("masked"))


# Job history: events in the shape of runs.
RUNS = {
    "id": "event_id",
    "feature": "upper(event_type)",
    "inputHash": "md5(concat('', user_id))",
    "qualityScore": "cast(event_id % 101 as int)",
    "status": "case event_id % 4 when 0 then 'FAILED' when 1 then 'PARTIAL' else 'SUCCESS' end",
    "durationMs": "event_id % 977",
    "timestamp": "event_id * 1000 % 7919",
}
_RUNS = f"(select {', '.join(f'{e} as {c}' for c, e in RUNS.items())} from events)"


def runs(s, d):
    return load(s, d, "events").selectExpr(*[f"{e} as {c}" for c, e in RUNS.items()])


query("history_totals", f"select count(*) as total, count(*) filter (status = 'SUCCESS') as succeeded, count(*) filter (status = 'FAILED') as failed, avg(qualityScore) as mean_quality, count(*) filter (status = 'SUCCESS') / count(*) * 100 as success_rate from {_RUNS}")(lambda s, d: history.totals(runs(s, d)))
query("history_by_feature", f"select feature, count(*) as runs from {_RUNS} group by 1")(lambda s, d: history.by_feature(runs(s, d)))
query("history_top_feature", f"select feature, count(*) as runs from {_RUNS} group by 1 order by 2 desc, 1 limit 1")(lambda s, d: history.top_feature(runs(s, d)))
query("history_avg_duration", f"select avg(durationMs) as mean_ms from {_RUNS} where feature = 'CLICK'")(lambda s, d: history.mean_duration(runs(s, d), "CLICK"))
query("history_recent", f"select * from {_RUNS} order by timestamp desc, id desc limit 100")(lambda s, d: history.recent(runs(s, d)))
query("history_recent_feature", f"select * from {_RUNS} where feature = 'CLICK' order by timestamp desc, id desc limit 20")(lambda s, d: history.recent(runs(s, d), 20, "CLICK"))
query("history_batch_log", f"select * from (select * from {_RUNS} order by timestamp desc, id desc limit 20) where feature like 'C%'")(lambda s, d: history.batch_log(runs(s, d), prefix="C"))
query("history_cache_hit", f"select * from {_RUNS} where feature = 'CLICK' and inputHash = md5('7') and status = 'SUCCESS' order by timestamp desc, id desc limit 1")(lambda s, d: history.cached(runs(s, d), "CLICK", "8f14e45fceea167a5a36dedd4bea2543"))
query("history_prune", f"select * from {_RUNS} order by timestamp desc, id desc limit 500")(lambda s, d: history.newest(runs(s, d), 500))
query("history_expire", f"select * from {_RUNS} where timestamp >= 4000")(lambda s, d: history.since(runs(s, d), 4000))
query("history_mark_run", f"select * replace (case when id = 7 then 99 else timestamp end as timestamp) from {_RUNS}")(lambda s, d: history.updated(runs(s, d), "id", 7, timestamp=99))

# Workflows.
from .operators import formula, invoices, records  # noqa: E402
from .plans import workflow  # noqa: E402
from .streaming import batches  # noqa: E402


def part(s, d):
    return cleaning.with_ordinals(load(s, d, "part").selectExpr("p_partkey", "p_name", "p_brand", "concat(p_size, '') as p_size")).withColumn(workflow.RID, F.col("p_partkey").cast("long"))


_PART = "(select concat(p_partkey, '') as p_partkey, p_name, p_brand, concat(p_size, '') as p_size from part)"


def filter_query(name, rule, value, column, sql):
    query(name, f"select * from {_PART} where {sql}")(lambda s, d: workflow.filter_rows(part(s, d), value, rule, column).drop(workflow.RID))


filter_query("flow_filter_contains", "contains", "BRAND#1", "p_brand", "lower(p_brand) like '%brand#1%'")
filter_query("flow_filter_not", "not", "brand#1", "3", "lower(p_brand) not like '%brand#1%'")
filter_query("flow_filter_equals", "equals", " 7 ", "P_SIZE", "p_size = '7'")
filter_query("flow_filter_starts", "starts", "brand#2", "p_brand", "lower(p_brand) like 'brand#2%'")
filter_query("flow_filter_any_column", "contains", "11", "", "contains(p_partkey, '11') or contains(p_name, '11') or contains(p_brand, '11') or contains(p_size, '11')")
filter_query("flow_filter_not_any", "not", "1", "", "not (contains(p_partkey, '1') or contains(p_name, '1') or contains(p_brand, '1') or contains(p_size, '1'))")


@query("flow_keep_columns", f"select p_brand, p_partkey from {_PART}")
def _(s, d):
    return workflow.keep_columns(part(s, d), "3, P_PARTKEY").drop(workflow.RID)


def sort_query(name, column, descending, order):
    def run(s, d):
        ordered = workflow.sort_table(part(s, d), column, descending)
        return cleaning.dense_ordinals(ordered, "place").select("p_partkey", (F.col("place") + 1).alias("place"))

    query(name, f"select p_partkey, row_number() over (order by {order}) as place from {_PART}")(run)


sort_query("flow_sort_numeric", "p_size", False, "try_cast(p_size as double), cast(p_partkey as bigint)")
sort_query("flow_sort_text", "p_brand", False, "lower(regexp_replace(p_brand, '[^0-9.-]', '', 'g'))::double, cast(p_partkey as bigint)")
sort_query("flow_sort_descending", "p_size", True, "try_cast(p_size as double) desc, cast(p_partkey as bigint) desc")


@query("flow_text_to_table", "select concat('', event_id) as id, event_type as type, concat('u', user_id) as who from events where event_id > 0")
def _(s, d):
    lines = load(s, d, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") == 0, "id; type ;who").otherwise(F.concat_ws(" ; ", "event_id", "event_type", F.concat(F.lit("u"), "user_id"))).alias("text"))
    return workflow.text_to_table(lines).drop(workflow.RID)


@query("flow_table_to_text", "select -1::bigint as doc_id, 'r_name | r_regionkey' as text union all select r_regionkey::bigint, concat(r_name, ' | ', r_regionkey) from region")
def _(s, d):
    df = load(s, d, "region").select(F.col("r_regionkey").cast("long").alias(workflow.RID), "r_name", F.col("r_regionkey").cast("string"))
    return workflow.table_to_text(df, "pipe")


@query("flow_clean_text", r"select doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), ' {2,}', ' ', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') as text from documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", workflow.tidy_text(F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("  \r\n"))).alias("text"))


@query("flow_find_replace", "select doc_id, regexp_replace(text, 'the', 'T$1', 'gi') as text, len(regexp_extract_all(text, '(?i)the'))::int as n from documents")
def _(s, d):
    text, n = workflow.find_replace(F.col("text"), "the", "T$1")
    return load(s, d, "documents").select("doc_id", text.alias("text"), n.alias("n"))


# Formulas by the engine: a sheet for each nation with the balances of its customers in column A, formulas over them in B.
_OVER = "=AVERAGE(@)|=SUM(@)|=MIN(@)|=MAX(@)|=MEDIAN(@)|=PERCENTILE(@,0.9)|=VAR(@)|=VARP(@)|=STDEV(@)|=STDEVP(@)|=SUMSQ(@)|=COUNT(@)|=COUNTA(@)|=COUNTBLANK(@,C9)|=COUNTIF(@,\">=5000\")|=SUMIF(@,\">=5000\")|=AVERAGEIF(@,\"<1000\")|=LARGE(@,2)|=SMALL(@,3)".split("|")


@query(
    "formula_stats",
    "with b as (select c_nationkey as k, floor(c_acctbal) as x from customer), s as (select k, [avg(x), sum(x), min(x), max(x), median(x), quantile_cont(x, 0.9), var_samp(x), var_pop(x), stddev_samp(x), stddev_pop(x), sum(x * x), count(*), count(*), 1,"
    " count(*) filter (x >= 5000), sum(x) filter (x >= 5000), avg(x) filter (x < 1000), list_sort(list(x), 'desc')[2], list_sort(list(x))[3]] as v from b group by k having count(*) filter (x >= 5000) > 0 and count(*) filter (x < 1000) > 0 and count(*) > 3)"
    f" select k::int as nation, unnest(range({len(_OVER)}))::int as n, round(unnest(v), 3) as value from s",
)
def _(s, d):
    balances = load(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("sheet"), F.floor("c_acctbal").alias("x"), "c_custkey")
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey")) - 1
    values = balances.select("sheet", place.cast("int").alias("row"), F.lit(0).alias("col"), F.col("x").cast("string").alias("input"))
    size = balances.groupBy("sheet").agg(F.count("*").alias("n"), F.count_if(F.col("x") >= 5000).alias("high"), F.count_if(F.col("x") < 1000).alias("low")).where("n > 3 and high > 0 and low > 0")
    formulas = size.select("sheet", F.posexplode(F.array(*[F.lit(f) for f in _OVER])).alias("row", "f"), F.lit(1).alias("col"), "n")
    formulas = formulas.select("sheet", "row", "col", F.replace("f", F.lit("@"), F.concat(F.lit("A1:A"), "n")).alias("input"))
    done = formula.recalculate(values.join(size.select("sheet"), "sheet", "left_semi").unionAll(formulas)).where("col = 1")
    return done.select(F.col("sheet").cast("int").alias("nation"), F.col("row").alias("n"), F.round(F.col("display").cast("double"), 3).alias("value"))


# A sheet for each order, the quantities of its lines in column A.
_LINES = "(select l_orderkey as id, l_quantity::bigint as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from lineitem)"


def order_sheets(s, d, *formulas: str):
    """(id, displays) of formulas over the quantities of each order, for which an @ stands."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = load(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("sheet"), (F.row_number().over(along) - 1).alias("row"), F.lit(0).alias("col"), F.col("l_quantity").cast("long").cast("string").alias("input"))
    heads = lines.groupBy("sheet").agg(F.concat(F.lit("A1:A"), F.max("row") + 1).alias("over")).select("sheet", F.posexplode(F.array(*[F.replace(F.lit(f), F.lit("@"), F.col("over")) for f in formulas])).alias("row", "input"), F.lit(1).alias("col"))
    done = formula.recalculate(lines.unionByName(heads)).where("col = 1").groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", "display"))).alias("x"))  # as many as formulas
    return done.select(F.expr("cast(substring(sheet, 2) as bigint)").alias("id"), F.transform("x", lambda x: x["display"]).alias("displays"))


@query("formula_mode", f"select id, coalesce(max(q) filter (r = 1 and n > 1)::varchar, '#N/A') as display from (select *, row_number() over (partition by id order by n desc, first) as r from (select id, q, count(*) as n, min(place) as first from {_LINES} group by 1, 2)) group by id")
def _(s, d):
    return order_sheets(s, d, "=MODE(@)").select("id", F.get("displays", F.lit(0)).alias("display"))


@query("formula_countif_sumif", f"select id, concat_ws('|', count(*) filter (q >= 30), coalesce(sum(q) filter (q >= 30), 0), count(*) filter (q <> 7), coalesce(round(avg(q) filter (q < 10))::bigint::varchar, '#DIV/0!')) as line from {_LINES} group by 1")
def _(s, d):
    return order_sheets(s, d, '=COUNTIF(@,">=30")', '=SUMIF(@,">=30")', '=COUNTIF(@,"<>7")', '=ROUND(AVERAGEIF(@,"<10"),0)').select("id", F.concat_ws("|", "displays").alias("line"))


@query("formula_workbook", "select concat('p', p_partkey) as sheet, cast(p_size * 2 + 1 as varchar) as display from part")
def _(s, d):
    base = load(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sheet"), F.col("p_size").cast("string").alias("size"))
    cells_ = base.select("sheet", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("size").alias("input")), F.struct(F.lit(1).alias("row"), F.lit(0).alias("col"), F.lit("=SUM(A1,A1)").alias("input")), F.struct(F.lit(2).alias("row"), F.lit(0).alias("col"), F.lit("=IF(A2>=0,A2+1,0)").alias("input")))).alias("c")).select("sheet", "c.*")
    return formula.recalculate(cells_).where("row = 2").select("sheet", "display")


# Web pages.
@query("html_title", r"select page_id, replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') as title from pages".replace('\\"', '"'))
def _(s, d):
    return load(s, d, "pages").select("page_id", records.page_title(F.col("html")).alias("title"))


@query("html_links", """select page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), lambda x: trim(x) <> ''))) as link from pages""")
def _(s, d):
    return load(s, d, "pages").select("page_id", F.explode(records.links(F.col("html"))).alias("link"))


_TEXT_SQL = r"trim(regexp_replace(@@, '[\s\p{Z}]+', ' ', 'g'))"
_BODY_SQL = r"regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>|<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?i)</?(?:b|i|em|strong|a|span|u|small|code)\b[^>]*>', '', 'g')"
_VISIBLE_SQL = _TEXT_SQL.replace("@@", "replace(" * 8 + f"regexp_replace({_BODY_SQL}, '<[^>]*>', ' ', 'g')" + "".join(f", '&{n};', '{m}')" for n, m in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&"))))


@query("html_text", f"select page_id, {_VISIBLE_SQL} as text from pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", records.visible_text(F.col("html")).alias("text"))


def _shop(s, d):
    """A page with a table and a page with cards for each nation."""
    n = load(s, d, "nation")
    rows = F.concat(*[F.concat(F.lit("<tr><td>"), F.lit(k), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr>")) for k in ("a", "b")])
    cards = F.concat(*[F.concat(F.lit(f'<li class="card"><h3>{k} '), F.col("n_name"), F.lit('</h3><a href="/i/'), F.col("n_nationkey").cast("string"), F.lit(f'">go</a><p>Text {k}</p><span class="price">$1'), F.col("n_nationkey").cast("string"), F.lit(".50</span></li>")) for k in ("A", "B", "C")])
    return n.select(F.concat(F.lit("https://x.example/"), "n_nationkey").alias("url"), F.concat(F.lit("<html><title>t</title><table>"), rows, F.lit("</table><ul>"), cards, F.lit("</ul></html>")).alias("html"))


@query("html_tables", "select concat('https://x.example/', n_nationkey) as url, r as row, k as first, n_name as second from nation, (values (0, 'a'), (1, 'b')) t(r, k)")
def _(s, d):
    return records.page_tables(_shop(s, d)).select("url", "row", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))


@query("html_cards", "select concat('https://x.example/', n_nationkey) as url, concat(k, ' ', n_name) as name, concat('Text ', k) as description, concat('$1', n_nationkey, '.50') as price, concat('https://x.example/i/', n_nationkey) as link from nation, (values ('A'), ('B'), ('C')) t(k)")
def _(s, d):
    return records.extract(_shop(s, d)).select("url", "name", "description", "price", "link")


# Invoices: an order with its lines, some figures left out.
def _invoices(s, d):
    money = lambda c: F.format_string("%.2f", c)
    lines = load(s, d, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("q"), (F.col("l_orderkey") % 90 + F.col("l_linenumber")).cast("double").alias("p"), "l_linenumber")
    item = F.struct(F.concat(F.lit("line "), "l_linenumber").alias("description"), F.col("q").cast("string").alias("quantity"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(money(F.col("p"))).alias("unit_price"), F.when(F.col("l_linenumber") % 3 == 1, "").otherwise(money(F.col("q") * F.col("p"))).alias("amount"))
    return lines.groupBy("l_orderkey").agg(F.collect_list(item).alias("items")).select(F.col("l_orderkey").alias("id"), "items", F.lit("").alias("subtotal"), F.lit("10.00").alias("tax"), F.lit("").alias("total"))


@query("invoice_gap_fill", "select l_orderkey as id, printf('%.2f', sum(floor(l_quantity) * (l_orderkey % 90 + l_linenumber))) as subtotal, printf('%.2f', sum(floor(l_quantity) * (l_orderkey % 90 + l_linenumber)) + 10) as total from lineitem group by 1")
def _(s, d):
    return invoices.fill_gaps(_invoices(s, d)).select("id", "subtotal", "total")


@query("invoice_export", "select l_orderkey as id, concat('line ', l_linenumber) as description, printf('%.2f', floor(l_quantity) * (l_orderkey % 90 + l_linenumber)) as amount from lineitem")
def _(s, d):
    return invoices.export_rows(invoices.fill_gaps(_invoices(s, d)), "id").select("id", "description", "amount")


@query("invoice_totals_check", "select o_orderkey as id, abs(o_totalprice + 1 - (o_totalprice + o_orderkey % 40)) > greatest(0.02, greatest(abs(o_totalprice + 1), abs(o_totalprice + o_orderkey % 40)) * 0.01) as totals_review from (select o_orderkey, o_orderkey % 2000 + 0.0 as o_totalprice from orders)")
def _(s, d):
    base = F.col("o_orderkey") % 2000
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array().cast(f"array<{invoices.ITEM}>").alias("items"), base.cast("string").alias("subtotal"), F.lit("1.00").alias("tax"), (base + F.col("o_orderkey") % 40).cast("string").alias("total"))
    return invoices.checked(rows).select("id", "totals_review")


@query("event_counts", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2")
def _(s, d):
    return batches.event_counts(load(s, d, "events"))

# Receipts and scanned tables, composed from orders and nations.
from .operators import layout, receipts  # noqa: E402


def _receipts(s, d):
    o = load(s, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 90 + 10).cast("string").alias("a"))
    text = F.concat(F.lit("Corner Shop\nInvoice No: INV-"), "k", F.lit("\nDate: 05/06/2024\nBill To:\nBuyer "), "k", F.lit("\nCoffee beans   2   3.50   7.00\nTea - "), "a", F.lit(".25\nSubtotal: "), "a", F.lit(".00\nTax 1.00\nGrand Total: "), "a", F.lit(".99\nTill: 4\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("invoice_parse", "select o_orderkey as doc_id, concat('INV-', o_orderkey) as number, 'Corner Shop' as company, concat('Buyer ', o_orderkey) as customer, '05/06/2024' as day, concat(o_orderkey % 90 + 10, '.00') as subtotal, '1.00' as tax, concat(o_orderkey % 90 + 10, '.99') as total, '4' as till, concat('Coffee beans|2|3.50|7.00;Tea|||', o_orderkey % 90 + 10, '.25') as items from orders")
def _(s, d):
    got = receipts.extract(_receipts(s, d))
    of = lambda name: F.try_element_at(F.map_from_entries("fields"), F.lit(name))
    items_ = F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["description"], x["quantity"], x["unit_price"], x["amount"])), ";")
    return got.select("doc_id", of("Invoice Number").alias("number"), of("Company").alias("company"), of("Customer").alias("customer"), of("Date").alias("day"), "subtotal", "tax", "total", of("Till").alias("till"), items_.alias("items"))


@query("ocr_layout_table", "select n_nationkey::bigint as page_id, concat('Key', chr(9), 'Name', chr(10), n_nationkey, chr(9), n_name, chr(10), n_regionkey, chr(9), 'region') as text from nation")
def _(s, d):
    cell = lambda text, x, y: F.struct(text.alias("text"), F.lit(x).alias("left"), F.lit(y).alias("top"), F.lit(x + 80).alias("right"), F.lit(y + 20).alias("bottom"))
    grid = (("Key", "Name"), ("n_nationkey", "n_name"), ("n_regionkey", "region"))
    text = lambda t: F.col(t).cast("string") if t.startswith("n_") else F.lit(t)
    words = F.array(*[cell(text(t), 10 + 300 * j, 10 + 30 * i) for i, r in enumerate(grid) for j, t in enumerate(r)])
    return layout.extract(load(s, d, "nation").select(F.col("n_nationkey").alias("page_id"), words.alias("words"), F.lit("none").alias("text")))


# Books and receipts with boxes, composed from nations, customers and orders.
from .operators import book, receipt_tables  # noqa: E402


@query("book_text", r"select n_nationkey::bigint as page_id, concat('# Chapter ', n_nationkey, chr(10), chr(10), 'The land ', n_name, ' is a wonderful place in region ', n_regionkey, '.', chr(10), chr(10), 'A new paragraph') as text from nation")
def _(s, d):
    line = lambda text, y, h, right: F.struct(text.alias("text"), F.lit(100).alias("left"), F.lit(y).alias("top"), F.lit(right).alias("right"), F.lit(y + h).alias("bottom"), F.lit(1).alias("block"))
    parts = (F.concat(F.lit("Chapter "), "n_nationkey"), F.concat(F.lit("The land "), "n_name", F.lit(" is a wonder-")), F.concat(F.lit("ful place in region "), "n_regionkey", F.lit(".")), F.lit("A new paragraph"), F.col("n_nationkey").cast("string"))
    places = ((60, 40, 400), (150, 20, 600), (172, 20, 400), (194, 20, 500), (980, 15, 120))
    return book.extract(load(s, d, "nation").select(F.col("n_nationkey").alias("page_id"), F.array(*[line(t, *p) for t, p in zip(parts, places)]).alias("lines"), F.lit("none").alias("text"), F.lit(1000).alias("high")), height="high")


@query(
    "book_join_pages",
    "select c_nationkey::bigint as book, c_custkey::bigint as page, case when lag(c_custkey) over w is null then '' when c_custkey % 3 = 1 and lag(c_custkey) over w % 3 = 0 then '' else concat(chr(10), chr(10)) end as glue,"
    " case c_custkey % 3 when 0 then concat('Page ', c_custkey, ' is a won', case when lead(c_custkey) over w % 3 = 1 then '' else '-' end) when 1 then concat('derful one ', c_custkey, '.') else concat('# Title ', c_custkey) end as text from customer window w as (partition by c_nationkey order by c_custkey)",
)
def _(s, d):
    text = "case c_custkey % 3 when 0 then concat('Page ', c_custkey, ' is a won-') when 1 then concat('derful one ', c_custkey, '.') else concat('# Title ', c_custkey) end as text"
    return book.glued(load(s, d, "customer").selectExpr("cast(c_nationkey as long) as book", "c_custkey as page", text), "book", "page")


@query(
    "receipt_table",
    "select o_orderkey as doc_id, o_orderkey % 2 = 0 as header_found, true as aligned, printf('%.2f', (o_orderkey % 9 + 1) * 2.5 + 4.25) as subtotal,"
    " concat('Coffee beans extra dark|', o_orderkey % 9 + 1, '|2.50|', printf('%.2f', (o_orderkey % 9 + 1) * 2.5), ';Tea|', case when o_orderkey % 2 = 0 then '|' else '1|4.25' end, '|4.25') as items from orders",
)
def _(s, d):
    word = lambda t, x, y: F.struct(t.alias("text"), F.lit(x).alias("left"), F.lit(y).alias("top"), F.lit(x + 50).alias("right"), F.lit(y + 20).alias("bottom"))

    def line(y, *words):
        parts = [(F.lit(t) if isinstance(t, str) else t, x) for t, x in words]
        return F.struct(F.concat_ws(" ", *[t for t, _ in parts]).alias("text"), F.lit(y).alias("top"), F.lit(y + 20).alias("bottom"), F.array(*[word(t, x, y) for t, x in parts]).alias("words"))

    even, count = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 9 + 1
    head = line(40, (F.when(even, "Qty").otherwise("Corner"), 0), (F.when(even, "Item").otherwise("Shop"), 100), (F.when(even, "Rate").otherwise("of"), 300), (F.when(even, "Amount").otherwise("May"), 400))
    first = line(70, (count.cast("string"), 0), ("Coffee", 100), ("beans", 155), ("2.50", 300), (F.format_string("%.2f", count * 2.5), 400))
    wrap, last = line(100, ("extra", 100), ("dark", 155)), line(130, (F.when(even, "").otherwise("1"), 0), ("Tea", 100), ("4.25", 400))
    scans = load(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("text"), F.array(head, first, wrap, last, line(160, ("Total", 100), ("99.00", 400))).alias("lines"))
    got = receipt_tables.extract(scans)
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["description"], x["quantity"], x["unit_price"], x["amount"])), ";")
    return got.select("doc_id", "header_found", "aligned", "subtotal", shown.alias("items"))


# Counters and changes of a cleaning run.
def _report(s, d):
    df = messy(s, d, ORDERS).select("id", "day", "price", "priority").withColumnRenamed("id", cleaning.RID)
    return cleaning.report(df, cleaning.Options(), {"day": "DATE", "price": "CURRENCY", "priority": "TEXT"})


@query(
    "clean_report_metrics",
    _cleaned + ", k as (select count(*) as n from (select distinct coalesce(day2, day), coalesce(price2, price), priority from c)) select count(*)::bigint as rows_in, any_value(k.n)::bigint as rows_out, (count(*) - any_value(k.n))::bigint as duplicates_removed,"
    " count(*) filter (day2 is null)::bigint as dates_unparseable, count(*) filter (day2 <> day)::bigint as dates_standardized, count(*) filter (price2 is null or price2::double < 0)::bigint as invalid_numeric_values, count(*) filter (price2 <> price)::bigint as currency_cells_cleaned,"
    " (count(*) - any_value(k.n))::bigint as exact_duplicates_removed, sum((day is null or trim(day) = '')::int + (price is null or trim(price) = '')::int + (priority is null or trim(priority) = '')::int)::bigint as missing_values_found,"
    " count(*) filter (trim(concat(day, price, priority)) = '')::bigint as empty_rows_removed from c, k",
)
def _(s, d):
    return _report(s, d)[0].select("rows_in", "rows_out", "duplicates_removed", "dates_unparseable", "dates_standardized", "invalid_numeric_values", "currency_cells_cleaned", "exact_duplicates_removed", "missing_values_found", "empty_rows_removed")


@query("clean_change_log", _cleaned + " select id, 'day' as col, day as before, day2 as after, 'date standardized to YYYY-MM-DD' as reason from c where day2 <> day union all select id, 'price', price, price2, 'currency cleaned to numeric' from c where price2 <> price")
def _(s, d):
    return _report(s, d)[1].select(F.col(cleaning.RID).alias("id"), F.col("column").alias("col"), "before", "after", "reason")


@query("clean_url_flags", "select page_id as id, case when page_id % 3 = 0 then concat('no link ', page_id) else url end as value from pages where page_id % 3 = 0")
def _(s, d):
    links = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("no link "), "page_id")).otherwise(F.col("url"))
    return cleaning.clean(load(s, d, "pages").select(F.col("page_id").alias(cleaning.RID), links.alias("link")), cleaning.Options(), {"link": "URL"})[1].select(F.col(cleaning.RID).alias("id"), "value")


# Mails in which every second address is none: dots side by side, at an end, or labels that start with a hyphen.
_LETTERS = "concat('Write to ', c_name, ' at c', c_custkey, case c_custkey % 4 when 0 then '..x@mail.org' when 1 then '@-mail.org' when 2 then '.@mail.org' else '@mail.org' end, ', or Ask@mail', c_custkey, '.com; ask@MAIL', c_custkey, '.com') as text"


@query("emails_rejected", "select id, concat('c', id, case id % 4 when 0 then '..x@mail.org' when 1 then '@-mail.org' else '.@mail.org' end) as email from (select c_custkey as id from customer) where id % 4 <> 3")
def _(s, d):
    return emails.extract(load(s, d, "customer").selectExpr("c_custkey as id", _LETTERS), "text", "id").select("id", F.explode("rejected").alias("email"))


# Formulas: a sheet for each part, its size in A1 and its name in A2, a formula in each row of column B.
def formula_query(name, pairs):
    def run(s, d):
        rows = [(0, 0, F.col("p_size").cast("string")), (1, 0, F.col("p_name")), *[(i, 1, F.lit(f)) for i, (f, _) in enumerate(pairs)]]
        cell = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("input")) for r, c, v in rows])).alias("c")
        sheets = load(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sheet"), cell).select("sheet", "c.*")
        return formula.recalculate(sheets).where("col = 1").select("sheet", F.col("row").cast("int").alias("n"), "display")

    shown = ", ".join(f"cast({sql} as varchar)" for _, sql in pairs)
    query(name, f"select concat('p', p_partkey) as sheet, unnest(range({len(pairs)}))::int as n, unnest([{shown}]) as display from (select p_partkey, p_size::bigint as p_size, p_name from part)")(run)


formula_query(
    "formula_round_family",
    [("=ROUND(A1/4,0)", "floor(p_size / 4 + 0.5)::bigint"), ("=ROUNDUP(A1/4,0)", "ceil(p_size / 4)::bigint"), ("=ROUNDDOWN(-A1/4,0)", "-(p_size // 4)"), ("=INT(-A1/4)", "floor(-p_size / 4)::bigint"), ("=QUOTIENT(A1,4)", "p_size // 4"), ("=CEILING(A1,7)", "(ceil(p_size / 7) * 7)::bigint"), ("=FLOOR(A1,7)", "(p_size // 7) * 7"), ("=MROUND(A1,7)", "(floor(p_size / 7 + 0.5) * 7)::bigint")],
)
formula_query(
    "formula_numbers",
    [("=POWER(A1,2)", "p_size * p_size"), ("=SQRT(A1*A1)", "p_size"), ("=SIGN(A1-25)", "sign(p_size - 25)::bigint"), ("=ABS(A1-25)", "abs(p_size - 25)"), ("=GCD(A1,12)", "gcd(p_size, 12)"), ("=LCM(A1,12)", "lcm(p_size, 12)"), ("=ROUND(LOG10(10^A1),6)", "p_size"), ("=ROUND(DEGREES(RADIANS(A1)),6)", "p_size"), ("=MOD(A1,7)", "p_size % 7"), ("=ROUND(EXP(LN(A1)),6)", "p_size")],
)
formula_query(
    "formula_ranked",
    [("=LARGE(A1,10,20,30,2)", "list_sort([p_size, 10, 20, 30], 'desc')[2]"), ("=SMALL(A1,10,20,30,3)", "list_sort([p_size, 10, 20, 30])[3]"), ("=PERCENTILE(A1,10,20,30,40,0.5)", "list_sort([p_size, 10, 20, 30, 40])[3]"), ("=MEDIAN(A1,10,20)", "list_sort([p_size, 10, 20])[2]"), ("=MAX(A1,25)-MIN(A1,25)", "abs(p_size - 25)")],
)
formula_query(
    "formula_logic",
    [("=IF(A1>=25,\"big\",\"small\")", "case when p_size >= 25 then 'big' else 'small' end"), ("=IFERROR(1/(A1-A1),\"none\")", "'none'"), ("=AND(A1>10,A1<40)", "upper(cast(p_size > 10 and p_size < 40 as varchar))"), ("=OR(A1<10,A1>40)", "upper(cast(p_size < 10 or p_size > 40 as varchar))"), ("=XOR(ISODD(A1),A1>25)", "upper(cast((p_size % 2 = 1) <> (p_size > 25) as varchar))"), ("=NOT(ISEVEN(A1))", "upper(cast(p_size % 2 = 1 as varchar))")],
)
formula_query(
    "formula_text_family",
    [("=LEFT(A2,3)", "left(p_name, 3)"), ("=RIGHT(A2,2)", "right(p_name, 2)"), ("=MID(A2,2,3)", "substr(p_name, 2, 3)"), ("=LEN(A2)", "length(p_name)"), ("=UPPER(A2)&\"-\"&A1", "concat(upper(p_name), '-', p_size)"), ("=SUBSTITUTE(A2,\"a\",\"@\")", "replace(p_name, 'a', '@')"), ("=REPT(\"x\",MOD(A1,5))", "repeat('x', (p_size % 5)::int)"), ("=TEXTJOIN(\"/\",TRUE,A1,\"\",A2)", "concat(p_size, '/', p_name)"), ("=EXACT(A2,LOWER(A2))", "upper(cast(p_name = lower(p_name) as varchar))")],
)


# Records of web pages by each strategy: a page of linked data, of microdata and of none for each nation.
def _site(s, d):
    n, key = load(s, d, "nation"), F.col("n_nationkey").cast("string")
    linked = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "P '), "n_name", F.lit('", "url": "/p/'), key, F.lit('", "offers": {"price": '), key, F.lit(', "priceCurrency": "EUR"}}]}</script>'))
    micro = F.concat(F.lit('<div itemscope><b itemprop="name">M '), "n_name", F.lit('</b><meta itemprop="price" content="'), key, F.lit('"><a itemprop="url" href="m/'), key, F.lit('">x</a><i itemprop="SIZE">'), key, F.lit("</i></div>"))
    bare = F.concat(F.lit("<title>T "), "n_name", F.lit('</title><meta property="og:description" content="About '), key, F.lit('">'))
    return n.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"https://x.example/{k}/"), key).alias("url"), v.alias("html")) for k, v in (("l", linked), ("m", micro), ("t", bare))])).alias("p")).select("p.*")


@query(
    "html_strategies",
    "select concat('https://x.example/l/', n_nationkey) as url, 'json-ld' as strategy, concat('P ', n_name) as name, null as description, concat('EUR ', n_nationkey) as price, concat('https://x.example/p/', n_nationkey) as link from nation"
    " union all select concat('https://x.example/m/', n_nationkey), 'microdata', concat('M ', n_name), null, concat(n_nationkey, ''), concat('https://x.example/m/m/', n_nationkey) from nation"
    " union all select concat('https://x.example/t/', n_nationkey), 'page', concat('T ', n_name), concat('About ', n_nationkey), null, concat('https://x.example/t/', n_nationkey) from nation",
)
def _(s, d):
    return records.extract(_site(s, d)).select("url", "strategy", "name", "description", "price", "link")


@query("scrape_union_rows", "select concat('https://x.example/', k, '/', n_nationkey) as \"Source\", concat(upper(case k when 'l' then 'p' else k end), ' ', n_name) as \"Name\", case k when 'm' then concat(n_nationkey, '') else '' end as size_ from nation, (values ('l'), ('m'), ('t')) t(k)")
def _(s, d):
    return records.flat(records.extract(_site(s, d))).select("Source", "Name", F.col("Size").alias("size_"))


from .sources import conversions  # noqa: E402


@query("file_kinds", "select p_partkey, case p_partkey % 4 when 0 then 'DOCUMENT' when 1 then 'IMAGE' when 2 then 'UNKNOWN' else 'AUDIO' end as category, case p_partkey % 4 when 0 then 'pdf' when 1 then 'jpeg' when 2 then 'zip' else '' end as extension, case p_partkey % 4 when 2 then 'ZIP archive' end as unsupported from part")
def _(s, d):
    k = F.col("p_partkey") % 4
    extension, mime = F.when(k == 0, " PDF").when(k == 1, "jpeg").when(k == 2, "Zip").otherwise(""), F.when(k == 1, "video/mp4").when(k == 3, "audio/x-odd; rate=1")
    return load(s, d, "part").select("p_partkey", conversions.detected(extension, mime).alias("d")).select("p_partkey", "d.*")


from . import catalog_more  # noqa: E402, F401
