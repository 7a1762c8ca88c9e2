"""File formats: delimited text, JSON, plain text, XLSX and DOCX, with standard-library parsers where Spark has no reader.

Bulk CSV goes through Spark's reader (``read_csv``); ``parse_csv`` keeps ragged rows and odd quotes of single files.
"""

from __future__ import annotations

import codecs
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import guarded

# Limits of one file.
MOST_ROWS = 300_000
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES = 5_000, 64 << 20, 256 << 20
LONGEST_CELL = 32_000
# End of fixed values.


def decode_text(data: bytes) -> str:
    """By byte-order mark, else strict UTF-8, else Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def sniff_delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes in the first line; that order on ties."""
    line = re.match(r'(?:"[^"]*"|[^"\n])*', text)[0]
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",;\t", key=lambda d: (bare.count(d), -",;\t".index(d)))


FIELD = re.compile(r'(?:"((?:[^"]|"")*)(?:"|\Z))?([^%s\r\n]*)(%s|\r\n|\r|\n|\Z)')


def csv_rows(text: str, d: str) -> Iterator[tuple[int, int, list[str]]]:
    """(offset, end, fields) of each row of a text. A quote opens a quoted field at its start only; what follows the closing
    quote is added to it; rows of one empty field are left out; ragged rows stay."""
    field = re.compile(FIELD.pattern % (re.escape(d), re.escape(d)))
    row, at, began = [], 0, 0
    while True:
        m = field.match(text, at)
        row.append((m[1] or "").replace('""', '"') + m[2])
        at = m.end()
        if m[3] != d or not m[3]:
            if row != [""]:
                yield began, m.end(2), row
            row, began = [], at
            if at >= len(text):
                return


def parse_csv(text: str) -> list[list[str]]:
    """Rows of fields of a whole file, its delimiter found out; a file of blanks alone has none."""
    text = text.removeprefix("\ufeff")
    return [row for _, _, row in csv_rows(text, sniff_delimiter(text))] if text.strip() else []


def format_of(name: str) -> str:
    return {"xlsx": "XLSX", "xls": "XLSX", "json": "JSON", "txt": "TXT"}.get(name.rpartition(".")[2].lower(), "CSV")


def unique_names(header: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def to_table(spark: SparkSession, rows: list[list[str]], rid: str = "__rid") -> DataFrame:
    """Rows with a header as strings and ordinals; short rows are padded, longer ones widen the table."""
    if not rows:
        return spark.createDataFrame([], f"{rid} long")
    width = max(map(len, rows))
    names = unique_names(rows[0] + [""] * (width - len(rows[0])))
    frame = pd.DataFrame([r + [""] * (width - len(r)) for r in rows[1:]], columns=names, dtype=object)
    frame.insert(0, rid, range(len(frame)))
    return spark.createDataFrame(frame, ", ".join([f"{rid} long", *(f"`{n.replace('`', '``')}` string" for n in names)]))


def read_csv(spark: SparkSession, path: str, sep: str = ",", quoted_newlines: bool = True) -> DataFrame:
    """CSV by Spark's reader; files whose quoted fields hold no ends of lines are split among tasks."""
    return spark.read.option("header", True).option("multiLine", quoted_newlines).option("quote", '"').option("escape", '"').option("sep", sep).csv(path).na.fill("")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).na.fill("")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("length(value) > 0").withColumnRenamed("value", "Text")


def csv_line(fields: list[str]) -> str:
    return ",".join('"' + f.replace('"', '""') + '"' if re.search(r'[",\r\n]', f) else f for f in fields)


def write_csv(df: DataFrame, path: str, rid: str = "__rid") -> None:
    """Every cell and name guarded against being read as a formula; rows by ordinal in ranges."""
    body = df.orderBy(rid).drop(rid) if rid in df.columns else df
    names = body.sparkSession.range(1).select(*[guarded(F.lit(c)).alias(str(i)) for i, c in enumerate(body.columns)]).first() if body.columns else ()
    body.select(*[guarded(F.col(f"`{c}`").cast("string")).alias(n) for c, n in zip(body.columns, names)]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, rid: str = "__rid") -> None:
    """An object of strings for each row, in order, one to a line."""
    body = df.orderBy(rid).drop(rid) if rid in df.columns else df
    body.select(*[F.col(f"`{c}`").cast("string") for c in body.columns]).write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, rid: str = "__rid", sep: str = "\t") -> None:
    """The header and the rows, in order, cells joined by tabs and as they are."""
    names = [c for c in df.columns if c != rid]
    place = F.col(rid).cast("long") if rid in df.columns else F.lit(0).cast("long")
    rows = df.select(F.lit(1).alias("part"), place.alias("place"), F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]).alias("value"))
    head = df.sparkSession.createDataFrame([(0, 0, sep.join(names))], "part int, place long, value string")
    head.unionAll(rows).orderBy("part", "place").select("value").write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """The texts of a column as they are, in order."""
    (df.orderBy(order) if order else df).select(F.col(f"`{column}`").cast("string").alias("value")).na.fill("").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """A table as CSV, JSON, TXT or XLSX: text kinds as one file if the path has the kind's extension, else as a folder of parts."""
    if kind != "XLSX" and path.lower().endswith(f".{kind.lower()}"):
        from . import one_file

        one_file.WRITERS[kind](df, path)
    elif kind == "XLSX":
        names = [c for c in df.columns if c != "__rid"]
        ordered = df.orderBy("__rid") if "__rid" in df.columns else df
        rows = ordered.select(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]).alias("cells"))
        write_parts(rows, path, "xlsx", lambda held: xlsx_bytes({"Sheet1": [names, *held]}))
    else:
        {"CSV": write_csv, "JSON": write_json, "TXT": write_text}[kind](df, path)


class Unsafe(ValueError):
    pass


def _open(data: bytes) -> zipfile.ZipFile:
    """A zip archive within the limits and without document type declarations in its XML."""
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or any(i.file_size > MOST_ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > MOST_BYTES:
        raise Unsafe("archive beyond the limits")
    for i in infos:
        if i.filename.endswith((".xml", ".rels")):
            head = z.read(i)
            if b"<!DOCTYPE" in head or "<!DOCTYPE".encode("utf-16-le") in head or "<!DOCTYPE".encode("utf-16-be") in head:
                raise Unsafe("document type declaration")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry) of the sheets of a workbook."""
    names = set(z.namelist())
    links = {}
    if "xl/_rels/workbook.xml.rels" in names:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    if "xl/workbook.xml" in names:
        for n, s in enumerate(x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"):
            target = links.get(next((v for k, v in s.attrib.items() if _local(k) == "id" and k != "id"), None)) or f"worksheets/sheet{n + 1}.xml"
            entry = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            out.append((s.get("name", f"Sheet{n + 1}"), entry if entry in names else f"xl/worksheets/sheet{n + 1}.xml"))
    return [(n, e) for n, e in out if e in names]


def xlsx_cells(data: bytes, formulas: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of every cell of a workbook."""
    from ..operators.formula import address

    z = _open(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
    for name, entry in _sheets(z):
        row = -1
        for r in (x for x in ElementTree.fromstring(z.read(entry)).iter() if _local(x.tag) == "row"):
            row = int(r.get("r", row + 2)) - 1
            if row > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} rows")
            col = -1
            for c in r:
                at = address(c.get("r", ""))
                col = at[1] if at else col + 1
                parts = {_local(x.tag): x for x in c}
                kind, v = c.get("t"), parts["v"].text or "" if "v" in parts else ""
                if formulas and "f" in parts and parts["f"].text:
                    text = "=" + parts["f"].text
                elif kind == "s":
                    text = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                else:
                    text = {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v
                yield name, row, col, text


def read_workbooks(spark: SparkSession, path: str, formulas: bool = False) -> DataFrame:
    """(path, sheet, row, col, input) of all workbooks under a path, one file to a task's batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                rows = [(p, *cell) for cell in xlsx_cells(bytes(data), formulas)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "input"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, col int, input string")


def xlsx_rows(data: bytes, sheet: int = 0) -> list[list[str]]:
    """One sheet as rows of fields, gaps as empty ones."""
    names = [n for n, _ in _sheets(_open(data))]
    rows: dict[int, dict[int, str]] = {}
    for name, r, c, t in xlsx_cells(data):
        if names and name == names[sheet]:
            rows.setdefault(r, {})[c] = t
    return [[row.get(c, "") for c in range(max(row) + 1)] for _, row in sorted(rows.items())]


ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def xlsx_bytes(sheets: dict[str, list[list[str]]], formulas: bool = False) -> bytes:
    """A workbook: bold frozen headers, widths by content, numbers as numbers; dangerous or unwanted formulas as text."""
    from ..operators.formula import column_label

    types = ['<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', '<Default Extension="xml" ContentType="application/xml"/>', '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>', '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>']
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book, links, parts = [], [], {}
    names = unique_names([re.sub(r"[\\/?*\[\]:]", "_", n)[:28] or "Sheet" for n in sheets])
    for k, (name, rows) in enumerate(zip(names, sheets.values()), 1):
        types.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        book.append(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>')
        links.append(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        width = max(map(len, rows), default=0)
        widths = [min(55, max(10, 2 + max((len(r[c]) for r in rows if c < len(r)), default=0))) for c in range(width)]
        lines = []
        for i, row in enumerate(rows):
            cells = []
            for j, v in enumerate(row):
                v, ref, style = ILLEGAL.sub("", v)[:LONGEST_CELL], f"{column_label(j)}{i + 1}", ' s="1"' if i == 0 else ""
                if formulas and v.startswith("=") and not re.search(r"(?i)\b(WEBSERVICE|FILTERXML|RTD|CALL|REGISTER|EXEC)\s*\(", v) and not ("|" in v and "!" in v):
                    cells.append(f'<c r="{ref}"{style}><f>{escape(v[1:])}</f></c>')
                elif i and re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?", v):
                    cells.append(f'<c r="{ref}"{style}><v>{v}</v></c>')
                elif v:
                    cells.append(f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
        columns = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>{f"<cols>{columns}</cols>" if columns else ""}<sheetData>{"".join(lines)}</sheetData></worksheet>'
    links.append(f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/>')
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{"".join(types)}</Types>'
    parts["_rels/.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(book)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>'
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry, xml in parts.items():
            z.writestr(entry, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def docx_text(data: bytes) -> str:
    """Text runs, tabs and line breaks of a document, a line for each paragraph; fallback content is left out."""
    out = []

    def walk(node, in_tabs=False):
        tag = _local(node.tag)
        if tag == "Fallback":
            return
        if tag == "t":
            out.append(node.text or "")
        elif tag == "tab" and not in_tabs:
            out.append("\t")
        elif tag in ("br", "cr"):
            out.append("\n")
        for child in node:
            walk(child, tag == "tabs")
        if tag == "p":
            out.append("\n")

    walk(ElementTree.fromstring(_open(data).read("word/document.xml")))
    return "".join(out).rstrip("\n")


def _paragraph(text: str, before: str = "", look: str = "") -> str:
    parts = "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(ILLEGAL.sub("", x))}</w:t>' for x in text.split("\t"))
    return f"<w:p>{before}<w:r>{look}{parts}</w:r></w:p>"


def _word_table(lines: list[str]) -> str:
    rows = [x.split("\t") for x in lines]
    width = max(map(len, rows))
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:space="0" w:color="808080"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    body = "".join(f"<w:tr>{''.join(f'<w:tc><w:tcPr><w:tcW w:w={chr(34)}{9000 // width}{chr(34)} w:type={chr(34)}dxa{chr(34)}/></w:tcPr>{_paragraph(c)}</w:tc>' for c in r + [''] * (width - len(r)))}</w:tr>" for r in rows)
    return f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{f"<w:gridCol w:w={chr(34)}{9000 // width}{chr(34)}/>" * width}</w:tblGrid>{body}</w:tbl><w:p/>'


def _book_part(block: str) -> str:
    level = min(3, len(re.match("#*", block)[0]))
    if not level:
        return _paragraph(block.replace("\n", " "), '<w:pPr><w:spacing w:after="160"/></w:pPr>')
    centre = '<w:jc w:val="center"/>' if level == 1 else ""
    return _paragraph(block[level:].strip(), f'<w:pPr><w:keepNext/><w:spacing w:before="280" w:after="140"/>{centre}</w:pPr>', f'<w:rPr><w:b/><w:sz w:val="{(40, 32, 28)[level - 1]}"/></w:rPr>')


def docx_bytes(paragraphs: list[str], style: str = "plain") -> bytes:
    """A document: a paragraph for each line; style ``table`` makes runs of lines with tabs tables, ``book`` has headings."""
    if style == "book":
        body = "".join(_book_part(b.strip()) for b in "\n".join(paragraphs).split("\n\n") if b.strip())
    else:
        body = "".join(_word_table(list(run)) if tabbed else "".join(map(_paragraph, run)) for tabbed, run in groupby(paragraphs, lambda p: style == "table" and "\t" in p))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}<w:sectPr/></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry, xml in parts.items():
            z.writestr(entry, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


#: Lines of a part of a file that is written in parts, unless a single text has more.
PART_LINES = 100_000


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file through Hadoop's file systems, so that a path may be remote."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for n in range(0, len(data), 1 << 22):
            stream.write(bytearray(data[n : n + (1 << 22)]))
    finally:
        stream.close()


def reachable(spark: SparkSession, path: str) -> str | None:
    """The full address of a path whose file system tasks can write to by themselves, else None."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    address = re.sub(r"\A(file):/+", r"\1:///", full).replace("s3a://", "s3://", 1)
    try:
        fs.FileSystem.from_uri(address)
    except (pa.ArrowException, OSError, ImportError):
        return None
    return address


def put_files(named: DataFrame, folder: str) -> int:
    """Write the files (name, data) into a folder; their number.

    Tasks write them, each under a passing name first, so that a task that is run again leaves whole files. Where tasks
    cannot reach the file system by themselves, the driver writes one file at a time.
    """
    from ..operators.lineage import cut

    spark = named.sparkSession
    address = reachable(spark, folder)
    if address is None:
        count = 0
        for r in cut(named.select("name", "data")).toLocalIterator():
            put_file(spark, f"{folder}/{r['name']}", bytes(r["data"]))
            count += 1
        return count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(address)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                passing = f"{base}/_{uuid.uuid4().hex}-{name}"
                with system.open_output_stream(passing) as out:
                    out.write(data.as_buffer())
                system.move(passing, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return named.select("name", "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_parts(rows: DataFrame, path: str, extension: str, make: Callable[[list[list[str]]], bytes], part_lines: int = PART_LINES) -> int:
    """A folder of files made from ``rows`` (cells array<string>), in the order of their partitions; the number of files.

    Tasks make and write the files, each of at most ``part_lines`` lines (a cell may have several; one row is never
    parted). Files that the folder held before go.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held, lines = TaskContext.get().partitionId(), 0, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{part:05d}.{extension}"]), pa.array([make(held)], pa.binary())], names=["name", "data"])

        for batch in batches:
            for cells in batch.column(0).to_pylist():
                size = max((c or "").count("\n") for c in cells or [""]) + 1
                if held and lines + size > part_lines:
                    yield made()
                    part, held, lines = part + 1, [], 0
                held.append([c or "" for c in cells or []])
                lines += size
        if held:
            yield made()

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    count = put_files(rows.select("cells").mapInArrow(run, "name string, data binary"), path)
    if not count:
        put_file(spark, f"{path}/part-00000-00000.{extension}", make([]))
    return count or 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the DOCX files under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [docx_text(bytes(c)) for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
