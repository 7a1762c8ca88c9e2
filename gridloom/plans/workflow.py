"""Workflows: linear plans of typed steps, checked before anything runs, composed as DataFrames.

Data flow as TEXT (doc_id, text), TABLE (strings with ``__rid``) or EMAILS (email). Nothing runs before a step that needs
a look at the data (sorting, splitting) or the caller does.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import cleaning, emails
from ..sources import files, one_file, pdf, tables

RID = cleaning.RID
NONE, TEXT, TABLE, EMAILS = "NONE", "TEXT", "TABLE", "EMAILS"
# Kinds of steps with what they take and give.
KINDS = {
    "SCAN_IMAGES": ((NONE,), TEXT), "LOAD_PDF": ((NONE,), TEXT), "LOAD_SHEET": ((NONE,), TABLE), "SCAN_TABLE": ((NONE,), TABLE), "SCRAPE_URL": ((NONE,), TABLE), "PASTE_TEXT": ((NONE,), TEXT),
    "CLEAN_TABLE": ((TABLE,), TABLE), "EXTRACT_EMAILS": ((TEXT, TABLE), EMAILS), "TEXT_TO_TABLE": ((TEXT,), TABLE), "TABLE_TO_TEXT": ((TABLE,), TEXT), "CLEAN_TEXT": ((TEXT,), TEXT),
    "FIND_REPLACE": ((TEXT,), TEXT), "FILTER_ROWS": ((TABLE,), TABLE), "SORT_TABLE": ((TABLE,), TABLE), "KEEP_COLUMNS": ((TABLE,), TABLE),
    "EXPORT_CSV": ((TABLE, TEXT, EMAILS), NONE), "EXPORT_XLSX": ((TABLE, TEXT, EMAILS), NONE), "EXPORT_TXT": ((TEXT, TABLE, EMAILS), NONE), "EXPORT_PDF": ((TEXT, TABLE, EMAILS), NONE), "EXPORT_DOCX": ((TEXT, TABLE, EMAILS), NONE),
}
REQUIRED = {"FIND_REPLACE": ("find",), "FILTER_ROWS": ("value",), "SORT_TABLE": ("column",), "KEEP_COLUMNS": ("columns",), "LOAD_PDF": ("path",), "LOAD_SHEET": ("path",), "SCRAPE_URL": ("path",)}
MOST_STEPS, LONGEST_FIELD = 40, 20_000
STYLES = ("auto", "book", "table", "plain")
DOMAINS = {
    "SCAN_IMAGES": {"mode": ("layout", "book", "plain")}, "TEXT_TO_TABLE": {"delimiter": ("auto", "tab", "comma", "semicolon", "spaces")}, "TABLE_TO_TEXT": {"separator": ("tab", "comma", "pipe")},
    "FIND_REPLACE": {"case": ("ignore", "match")}, "FILTER_ROWS": {"rule": ("contains", "not", "equals", "starts")}, "SORT_TABLE": {"order": ("asc", "desc")}, "EXPORT_PDF": {"style": STYLES}, "EXPORT_DOCX": {"style": STYLES},
}
# End of fixed values.


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    kind: str
    text: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def opt(self, name: str, default: str = "") -> str:
        return self.options.get(name, default)


@dataclass(frozen=True)
class Data:
    kind: str
    df: DataFrame | None = None


def encode(steps: list[Step]) -> str:
    """JSON of a plan: 40 steps and 20,000 characters a field at most, without paths of opened files."""
    cut = lambda t: t[:LONGEST_FIELD]
    return json.dumps([{"kind": s.kind, "textInput": cut(s.text), "options": {k: cut(v) for k, v in s.options.items() if k != "path"}} for s in steps[:MOST_STEPS]])


def decode(text: str) -> list[Step]:
    """A plan from JSON; unknown steps are skipped and broken JSON is an empty plan."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    rows = [s for s in found if isinstance(s, dict) and s.get("kind") in KINDS] if isinstance(found, list) else []
    return [Step(s["kind"], str(s.get("textInput", "")), {str(k): str(v) for k, v in (s.get("options") or {}).items()}) for s in rows[:MOST_STEPS]]


def appended(steps: list[Step], kind: str) -> list[Step]:
    """A plan with a step more, whose options are the first legal ones."""
    if kind not in KINDS:
        raise PlanError(f"unknown kind {kind}")
    return [*steps, Step(kind, options={name: values[0] for name, values in DOMAINS.get(kind, {}).items()})]


def removed(steps: list[Step], at: int) -> list[Step]:
    return steps[:at] + steps[at + 1 :]


def truncated(steps: list[Step], at: int) -> list[Step]:
    return steps[:at]


def projected(steps: list[Step]) -> str:
    """What the last step gives, which the next one has to take."""
    return KINDS[steps[-1].kind][1] if steps else NONE


def moved(steps: list[Step], at: int, to: int) -> list[Step]:
    rest = steps[:at] + steps[at + 1 :]
    return [*rest[:to], steps[at], *rest[to:]]


def duplicated(steps: list[Step], at: int) -> list[Step]:
    return steps if len(steps) >= MOST_STEPS else [*steps[: at + 1], replace(steps[at]), *steps[at + 1 :]]


def validate(steps: list[Step]) -> None:
    """Raise PlanError for a plan that cannot run: kinds that do not fit, options that are missing."""
    if not steps:
        raise PlanError("there are no steps")
    given = NONE
    for n, s in enumerate(steps, 1):
        if s.kind not in KINDS:
            raise PlanError(f"step {n}: unknown kind {s.kind}")
        takes, gives = KINDS[s.kind]
        # An export gives nothing, so a source may follow it.
        if given not in takes:
            raise PlanError(f"step {n}: {s.kind} takes {' or '.join(takes)}, not {given}")
        if missing := [o for o in REQUIRED.get(s.kind, ()) if not s.opt(o)]:
            raise PlanError(f"step {n}: {s.kind} needs {', '.join(missing)}")
        for name, values in DOMAINS.get(s.kind, {}).items():
            if s.opt(name, values[0]) not in values:
                raise PlanError(f"step {n}: {name} must be {' or '.join(values)}")
        given = gives


def column_of(df: DataFrame, spec: str) -> str:
    """A column by its number from 1 on, else by its name without regard to case."""
    names = cleaning.body(df)
    if re.fullmatch(r"\d+", spec.strip()) and 1 <= int(spec) <= len(names):
        return names[int(spec) - 1]
    for n in names:
        if n.strip().lower() == spec.strip().lower():
            return n
    raise PlanError(f'column "{spec}" was not found')


def filter_rows(df: DataFrame, value: str, rule: str = "contains", column: str = "") -> DataFrame:
    """Rows with a cell that matches, in one column or any; for the rule ``not`` in all."""
    low, bare = value.lower(), value.strip().lower()

    def match(c: str) -> Column:
        v = F.lower(F.coalesce(F.col(f"`{c}`"), F.lit("")))
        return {"not": ~F.contains(v, F.lit(low)), "equals": cells.ws_trim(v) == bare, "starts": F.startswith(cells.ws_trim(v), F.lit(bare))}.get(rule, F.contains(v, F.lit(low)))

    if column.strip():
        return df.where(match(column_of(df, column)))
    parts = [match(c) for c in cleaning.body(df)]
    return df.where(reduce((lambda a, b: a & b) if rule == "not" else (lambda a, b: a | b), parts))


def sort_key(df: DataFrame, column: str) -> Column:
    """What a column is sorted by: numbers if every cell has one or is blank (blanks first), else lower-case text."""
    v = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    n = F.regexp_replace(v, r"[^0-9.\-]", "").try_cast("double")
    numeric = df.agg(F.coalesce(F.bool_and(n.isNotNull() | cells.blank(v)), F.lit(False)).alias("x")).first()["x"]
    return F.coalesce(n, F.lit(float("-inf"))) if numeric else F.lower(v)


def sort_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Stable; descending is the ascending order turned round, ties too."""
    key = sort_key(df, column_of(df, column))
    return df.orderBy(key.desc(), F.col(RID).desc()) if descending else df.orderBy(key.asc(), F.col(RID).asc())


def keep_columns(df: DataFrame, specs: str) -> DataFrame:
    chosen = [column_of(df, s) for s in specs.split(",") if s.strip()]
    if not chosen:
        raise PlanError("list the columns to keep")
    return df.select(*([RID] if RID in df.columns else []), *[F.col(f"`{c}`").alias(n) for c, n in zip(chosen, files.unique_names(chosen))])


def tidy_text(text: Column) -> Column:
    """Line ends unified, lines trimmed (those with tabs at the end only), runs of spaces and blank lines shortened."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    end = lambda x: F.regexp_replace(x, r"[\s\p{Z}]+\z", "")
    line = F.transform(lines, lambda x: F.when(F.contains(end(x), F.lit("\t")), end(x)).otherwise(F.regexp_replace(cells.ws_trim(x), " {2,}", " ")))
    return cells.ws_trim(F.regexp_replace(F.array_join(line, "\n"), "\n{3,}", "\n\n"))


def find_replace(text: Column, find: str, to: str, ignore_case: bool = True) -> tuple[Column, Column]:
    """(text, number of replacements)."""
    pattern = ("(?i)" if ignore_case else "") + cells.literal(find)
    return cells.replace_all(text, find, to, ignore_case=ignore_case), F.regexp_count(text, F.lit(pattern))


def text_to_table(df: DataFrame, delimiter: str = "auto") -> DataFrame:
    """Lines of all texts to rows, the first as the header; the delimiter by a vote of the lines."""
    lines = df.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("n", "line")).where(~cells.blank("line"))
    if delimiter == "auto":
        has = lambda d: F.count_if(F.contains("line", F.lit(d)))
        r = lines.agg(F.count("*").alias("n"), has("\t").alias("t"), has(";").alias("s"), has(",").alias("c")).first()
        if not r["n"]:
            raise PlanError("there is no text to split")
        delimiter = "tab" if r["t"] else "semicolon" if r["s"] * 2 >= r["n"] else "comma" if r["c"] * 2 >= r["n"] else "spaces"
    if delimiter == "comma":
        # One quoted field may hold commas; quotes are left as the exact parser leaves them.
        raw = F.regexp_extract_all("line", F.lit(r'("(?:[^"]|"")*"[^,]*|[^,]*)(?:,|$)'), F.lit(1))
        raw = F.when(F.col("line").endswith(","), raw).otherwise(F.filter(raw, lambda x, i: i < F.size(raw) - F.when(F.element_at(raw, -1) == "", 1).otherwise(0)))
        parts = F.transform(raw, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, r'\A"((?:[^"]|"")*)"', "$1"), '""', '"')).otherwise(x))
    else:
        pattern = {"tab": "\t", "semicolon": ";"}.get(delimiter, r"\s{2,}")
        parts = F.split(cells.ws_trim("line") if delimiter == "spaces" else F.col("line"), pattern, -1)
    rows = lines.select("doc_id", "n", F.transform(parts, cells.ws_trim).alias("cells"))
    width = rows.agg(F.max(F.size("cells")).alias("w")).first()["w"]
    first = rows.orderBy("doc_id", "n").limit(1).first()
    if first is None:
        raise PlanError("there is no text to split")
    names = files.unique_names(list(first["cells"]) + [""] * (width - len(first["cells"])))
    rest = rows.where((F.col("doc_id") != first["doc_id"]) | (F.col("n") != first["n"]))
    numbered = rest.orderBy("doc_id", "n").withColumn(RID, F.monotonically_increasing_id())
    return numbered.select(RID, *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def table_to_text(df: DataFrame, separator: str = "tab") -> DataFrame:
    """A row of text for each table row, in order (``doc_id`` -1 is the header)."""
    sep = {"comma": ", ", "pipe": " | "}.get(separator, "\t")
    names = cleaning.body(df)
    head = df.sparkSession.createDataFrame([(-1, sep.join(names))], "doc_id long, text string")
    return head.unionAll(df.select(F.col(RID).cast("long").alias("doc_id"), F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]).alias("text")))


def extract_emails(data: Data) -> DataFrame:
    text = data.df if data.kind == TEXT else table_to_text(data.df)
    return emails.extract(text, "text").select(F.explode("emails").alias("email")).distinct()


def lines_table(df: DataFrame) -> DataFrame:
    """Texts as a table: a row for each line, in columns where there are tabs."""
    if df.agg(F.bool_or(F.contains("text", F.lit("\t"))).alias("tabs")).first()["tabs"]:
        return text_to_table(df, "tab")
    lines = df.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("n", "Text"))
    return lines.orderBy("doc_id", "n").withColumn(RID, F.monotonically_increasing_id()).select(RID, "Text")


def layout_style(data: Data, chosen: str = "auto") -> str:
    """How a document looks: as chosen, else a table for tables, a book for texts with headings, columns for those with tabs."""
    if chosen != "auto":
        return chosen
    if data.kind != TEXT:
        return "table" if data.kind == TABLE else "plain"
    marks = data.df.agg(F.bool_or(F.col("text").rlike(r"(?m)^#{1,3} ")).alias("book"), F.bool_or(F.contains("text", F.lit("\t"))).alias("tabs")).first()
    return "book" if marks["book"] else "table" if marks["tabs"] else "plain"


def export_parts(s: Step, data: Data) -> None:
    """A workbook, document or PDF in parts: rows in order, each part with the header; texts by doc_id, in cells at tabs
    (workbooks) or as they are."""
    df, text = data.df, data.kind == TEXT
    order = next((c for c in (RID, "doc_id", "email") if c in df.columns), None)
    names = ["text"] if text else [c for c in df.columns if c != RID]
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = (df.orderBy(order) if order else df).select(F.array(*map(cell, names)).alias("cells"))
    if s.kind == "EXPORT_XLSX":
        tabs = text and bool(df.agg(F.bool_or(F.contains("text", F.lit("\t"))).alias("x")).first()["x"])
        if text:
            lines = rows.select(F.explode(F.split(F.get("cells", F.lit(0)), r"\r\n|\n|\r", -1)).alias("line"))
            rows = lines.select((F.split("line", "\t", -1) if tabs else F.array("line")).alias("cells"))
        head = [] if tabs else [["Text"] if text else names]
        files.write_parts(rows, s.opt("path"), "xlsx", lambda held: files.xlsx_bytes({"Workflow": head + held}))
        return
    style = layout_style(data, s.opt("style", "auto"))
    if data.kind == TABLE and style == "plain":
        rows = rows.select(F.transform("cells", cells.guarded).alias("cells"))
        head, line = [files.csv_line(list(df.sparkSession.range(1).select(*[cells.guarded(F.lit(n)) for n in names]).first()))], files.csv_line
    else:
        head, line = ["\t".join(names)] if data.kind == TABLE else [], "\t".join
    made = (lambda t: files.docx_bytes(t.split("\n"), style)) if s.kind == "EXPORT_DOCX" else (lambda t: (pdf.book_pdf(t) if style == "book" else pdf.text_pdf(t, style == "table"))[0])
    files.write_parts(rows, s.opt("path"), s.kind[7:].lower(), lambda held: made(re.sub(r"\r\n?", "\n", "\n".join(head + [line(c) for c in held]))))


def run_step(spark: SparkSession, s: Step, data: Data) -> Data:
    df = data.df
    if s.kind == "PASTE_TEXT":
        return Data(TEXT, spark.createDataFrame([(0, s.text)], "doc_id long, text string"))
    if s.kind == "LOAD_PDF":
        pages = pdf.read_pdfs(spark, s.opt("path"))
        bad = pages.where("error is not null").first()
        if bad:
            raise PlanError(f"{bad['path']}: {bad['error']}")
        # A text for each file, its pages in order.
        texts = pages.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
        return Data(TEXT, texts.select(F.xxhash64("path").alias("doc_id"), "text"))
    if s.kind == "LOAD_SHEET":
        return Data(TABLE, tables.read_table(spark, s.opt("path")))
    if s.kind == "SCRAPE_URL":
        from ..operators import records

        pages = spark.read.parquet(s.opt("path"))
        found = records.extract(pages)
        if found.where("strategy not in ('page', 'none')").isEmpty():
            return Data(TABLE, records.summary(pages).orderBy("url", "place").withColumn(RID, F.monotonically_increasing_id()).select(RID, "Field", "Value"))
        return Data(TABLE, cleaning.with_ordinals(records.flat(found)))
    if s.kind == "CLEAN_TABLE":
        return Data(TABLE, cleaning.clean(df)[0])
    if s.kind == "EXTRACT_EMAILS":
        return Data(EMAILS, extract_emails(data))
    if s.kind == "TEXT_TO_TABLE":
        return Data(TABLE, text_to_table(df, s.opt("delimiter", "auto")))
    if s.kind == "TABLE_TO_TEXT":
        return Data(TEXT, table_to_text(df, s.opt("separator", "tab")))
    if s.kind == "CLEAN_TEXT":
        return Data(TEXT, df.withColumn("text", tidy_text(F.col("text"))))
    if s.kind == "FIND_REPLACE":
        return Data(TEXT, df.withColumn("text", find_replace(F.col("text"), s.opt("find"), s.opt("replace"), s.opt("case", "ignore") == "ignore")[0]))
    if s.kind == "FILTER_ROWS":
        return Data(TABLE, filter_rows(df, s.opt("value"), s.opt("rule", "contains"), s.opt("column")))
    if s.kind == "SORT_TABLE":
        return Data(TABLE, sort_table(df, s.opt("column"), s.opt("order", "asc") == "desc"))
    if s.kind == "KEEP_COLUMNS":
        return Data(TABLE, keep_columns(df, s.opt("columns")))
    if s.kind == "EXPORT_TXT" and data.kind != TABLE:
        # A path with an extension is one file, another one a folder of parts.
        write = one_file.write_lines if s.opt("path").lower().endswith(".txt") else files.write_lines
        write(df, s.opt("path"), *(("text", "doc_id") if data.kind == TEXT else ("email", "email")))
        return Data(NONE)
    if s.kind in ("EXPORT_CSV", "EXPORT_TXT"):
        write = one_file.write_csv if s.opt("path").lower().endswith((".csv", ".txt")) else files.write_csv
        write(lines_table(df) if data.kind == TEXT else df, s.opt("path"))
        return Data(NONE)
    if s.kind in ("EXPORT_XLSX", "EXPORT_DOCX", "EXPORT_PDF"):
        export_parts(s, data)
        return Data(NONE)
    raise PlanError(f"{s.kind} needs a device or a format library that is not available")


def run(spark: SparkSession, steps: list[Step]) -> Data:
    validate(steps)
    return reduce(lambda data, s: run_step(spark, s, data), steps, Data(NONE))
