"""CSV files of any size read in splits, with quoted line ends: the state at a split's start is found by a prefix scan.

A line's end leaves a reader at the start of a row or inside a quoted field, so a line is a function of two states. Spark's
text source deals a file to splits; a first pass composes the lines of each split for both states and each delimiter that
the file may have (lines without a quote leave the state as it is and are not looked at), the functions of a file's splits
are composed in order, and the second pass parses all splits at once, each from its own state. What a split has of a row
that began in another one is a fragment; a file's fragments are put together by the row they belong to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import written
from . import files

DELIMITERS = b",;\t"
#: A row's ordinal is its file's number times this, plus its place, so a file may have 8 TB.
PLACES = 1 << 43

# Quoted text up to its closing quote; fields that end in a delimiter or a carriage return; what is left of a field.
QUOTED = re.compile(rb'(?:[^"]|"")*+')
FIELDS = {d: re.compile(rb'(?:(?:"(?:[^"]|"")*+"[^%c\r]*+|[^"%c\r][^%c\r]*+)?+[%c\r])*+' % ((d,) * 4)) for d in DELIMITERS}
REST = {d: re.compile(rb"[^%c\r]*+[%c\r]?+" % (d, d)) for d in DELIMITERS}

FOUND = "path string, whole long, file long, block long, size long, after array<boolean>, head string, utf16 boolean, broken boolean"
PARSED = "file int, at long, cells array<string>, blank boolean, fragment binary, tail boolean"


def inside_after(line: bytes, delimiter: int, inside: bool) -> bool:
    """Whether the end of a line lies inside a quoted field, if its start does or does not."""
    at = 0
    if inside:
        at = QUOTED.match(line).end()
        if at == len(line):
            return True
        at = REST[delimiter].match(line, at + 1).end()
        if line[at - 1] != delimiter and line[at - 1] != 13:
            return False
    at = FIELDS[delimiter].match(line, at).end()
    return line[at : at + 1] == b'"' and QUOTED.match(line, at + 1).end() == len(line)


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file, block, whole, value, valid): the lines of all files as bytes, in order inside each split; ``file`` is the path's hash, ``whole`` its bytes."""
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"))
    return text.select("path", F.xxhash64("path").alias("file"), "block", "whole", F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, file, block) of rows of one split that stand together."""
    file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for first, end in zip([0, *edges], [*edges, len(file)], strict=True):
        if end > first:
            yield int(first), int(end), int(file[first]), int(block[first])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: its lines' bytes, its end's state by delimiter and start's state, and what its file's first row tells."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.bool_()), pa.string(), pa.bool_(), pa.bool_()]
    now: dict | None = None

    def out() -> pa.RecordBatch:
        now["head"] = b"\n".join(begun).decode("latin-1")
        return pa.record_batch([pa.array([now[c]], k) for c, k in zip(names, kinds, strict=True)], names)

    for batch in batches:
        told = batch.column("value").is_valid().to_numpy(zero_copy_only=False)
        for first, end, file, block in _runs(batch):
            if now is None or (now["file"], now["block"]) != (file, block):
                if now:
                    yield out()
                now = {"path": batch.column("path")[first].as_py(), "whole": batch.column("whole")[first].as_py(), "file": file, "block": block, "size": 0, "after": [False, True] * len(DELIMITERS), "head": None, "utf16": False, "broken": False}
                begun, quotes, closed = [], 0, block > 0
            now["size"] += int(batch.column("size").slice(first, end - first).to_numpy(zero_copy_only=False).sum())
            for at in np.flatnonzero(told[first:end]) + first:
                line = batch.column("value")[int(at)].as_py()
                if not closed:
                    if not begun:
                        now["utf16"] = line.startswith((b"\xff\xfe", b"\xfe\xff"))
                        line = line.removeprefix(b"\xef\xbb\xbf")
                    # The first line ends at the first line end outside quotes, whatever the delimiter is.
                    begun.append(line)
                    quotes += line.count(b'"')
                    closed = quotes % 2 == 0
                if b'"' in line:
                    now["after"] = [inside_after(line, d, now["after"][2 * i + s]) for i, d in enumerate(DELIMITERS) for s in (0, 1)]
                now["broken"] |= not batch.column("valid")[int(at)].as_py()
    if now:
        yield out()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file: its delimiter, whether it is UTF-16 or no UTF-8, and where each split's first line begins, and in which state."""
    for batch in batches:
        rows = []
        for path, whole, file, splits in zip(*(batch.column(c).to_pylist() for c in ("path", "whole", "file", "splits")), strict=True):
            delimiter = files.sniff_delimiter(next((s["head"] for s in splits if s["head"]), ""))
            i, inside, place, opens, places = DELIMITERS.index(delimiter.encode()), False, 0, [], []
            for s in splits:
                opens.append(inside)
                places.append(place)
                inside, place = s["after"][2 * i + inside], place + s["size"]
            # The reader counts one byte too many if the last line has no end, and may leave out the three of a byte-order mark.
            end = "\n" if inside and place - whole not in (1, -2) else ""
            rows.append((path, file, i, end, any(s["utf16"] for s in splits), any(s["broken"] for s in splits), [s["block"] for s in splits], places, opens))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "file", "delimiter", "end", "utf16", "broken", "blocks", "places", "opens"])


def file_states(lines: DataFrame) -> DataFrame:
    """(path, file, delimiter, end, utf16, broken, blocks, places, opens) of each file that has a line; the delimiter is found out from what the first split has of the first line.

    ``blocks``: the splits that have lines; ``places``: where the first line of each begins; ``opens``: whether inside quotes. ``end`` is the last line's end if a quoted field is open there, which goes on to the file's end.
    """
    # Python gets the length of every line, and the lines that can tell something.
    tells = (F.instr(F.col("value").cast("string"), '"') > 0) | ~F.col("valid") | (F.col("block") == 0)
    found = lines.select("path", "whole", "file", "block", (F.length("value") + 1).cast("long").alias("size"), "valid", F.when(tells, F.col("value")).alias("value")).mapInArrow(_scanned, FOUND)
    # A file has a row for each of its splits here.
    each = found.groupBy("path", "whole", "file").agg(F.array_sort(F.collect_list(F.struct("block", "size", "after", "head", "utf16", "broken"))).alias("splits"))
    return each.mapInArrow(_composed, "path string, file long, delimiter int, end string, utf16 boolean, broken boolean, blocks array<long>, places array<long>, opens array<boolean>")


class _Sink:
    """Rows and fragments of a task, given out in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.binary(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], ["file", "at", "cells", "blank", "fragment", "tail"])
            self.rows = []

    def row(self, file: int, at: int, cells: list[str], blank: bool) -> None:
        if cells != [""]:
            self.rows.append((file, at, cells, blank, None, None))

    def text(self, file: int, text: str, delimiter: str, place) -> None:
        """Whole rows of a text; ``place`` gives a row's place by its offset."""
        for at, end, cells in files.csv_rows(text, delimiter):
            self.row(file, place(at), cells, not text[at:end].strip())

    def fragment(self, file: int, at: int, lines: list[bytes], tail: bool) -> None:
        self.rows.append((file, at, None, None, b"\n".join(lines), tail))


def _parser(known):
    """Parses lines of splits; ``known``: a broadcast of (number, delimiter, broken, blocks, places, opens) by file, those left out are not read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, split, held, start, at, inside = _Sink(), None, [], 0, 0, False

        def close() -> None:
            """The rest of a split: all of it if it began inside quotes and they are still open, else the row that has begun."""
            if split is not None and held:
                sink.fragment(number, start, held, not inside)

        for batch in batches:
            for first, end, file, block in _runs(batch):
                if (file, block) != split:
                    close()
                    split, held, skipped = None, [], file not in known.value
                    if skipped:
                        continue
                    split, (number, delimiter, broken, blocks, places, opens) = (file, block), known.value[file]
                    d, encoding = chr(delimiter), "cp1252" if broken else "utf-8"
                    place = int(np.searchsorted(blocks, block))
                    at = start = int(places[place])
                    inside = bool(opens[place])
                elif skipped:
                    continue
                for line in batch.column("value").slice(first, end - first).to_pylist():
                    if at == 0:
                        line = line.removeprefix(b"\xef\xbb\xbf")
                    length = len(line) + 1
                    if not held and not inside and b'"' not in line:
                        # Carriage returns part rows; the offsets in letters keep rows in order within the line.
                        offset = at
                        for part in line.decode(encoding, "replace").split("\r"):
                            sink.row(number, offset, part.split(d), not part.strip())
                            offset += len(part) + 1
                    else:
                        if not held:
                            start = at
                        held.append(line)
                        if b'"' in line:
                            still = inside_after(line, delimiter, inside or len(held) > 1)
                        else:
                            still = True
                        if not still:
                            if inside:
                                sink.fragment(number, start, held, False)
                            else:
                                sink.text(number, b"\n".join(held).decode(encoding, "replace"), d, lambda o, start=start: start + o)
                            held, inside = [], False
                    at += length
            yield from sink.batches(10_000)
        close()
        yield from sink.batches()

    return parse


def _stitcher(known):
    """Rows from the fragments of one row, or of a row and those that end on its last line; ``known``: (delimiter, broken, end) by file number."""

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink()
        for batch in batches:
            for number, parts, last in zip(*(batch.column(c).to_pylist() for c in ("file", "parts", "last")), strict=True):
                delimiter, broken, end = known.value[number]
                texts = [p["fragment"].decode("cp1252" if broken else "utf-8", "replace") for p in parts]
                offsets = [0]
                for t in texts:
                    offsets.append(offsets[-1] + len(t) + 1)

                def place(o: int, offsets=offsets, parts=parts) -> int:
                    i = max(k for k in range(len(parts)) if offsets[k] <= o)
                    return parts[i]["at"] + o - offsets[i]

                sink.text(number, "\n".join(texts) + end * last, chr(delimiter), place)
            yield from sink.batches(10_000)
        yield from sink.batches()

    return stitch


def read_rows(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """((file, at, cells, blank) of all rows, written once; the files' paths by number): what ``files.parse_csv`` gives of each file.

    ``at`` grows along the rows of a file: where the row's line begins, and in letters what stands before it in that line. Files in UTF-16, which a line end does not
    part, are read whole, each by one task. The driver and the tasks get 17 bytes for each split and a row for each file,
    less than the list of the same splits and files that Spark's driver keeps.
    """
    lines = lines_of(spark, path)
    states = sorted(file_states(lines).collect(), key=lambda r: r["path"])
    if len({r["file"] for r in states}) < len(states):
        raise ValueError("two paths have one hash; rename one of the files")
    paths = [r["path"] for r in states]
    each = {r["file"]: (n, DELIMITERS[r["delimiter"]], r["broken"], np.array(r["blocks"]), np.array(r["places"]), np.array(r["opens"])) for n, r in enumerate(states) if not r["utf16"]}
    known = spark.sparkContext.broadcast(each)
    parsed = written(lines.select("file", "block", "value").mapInArrow(_parser(known), PARSED), "csv")
    rows = parsed.where("fragment is null").select("file", "at", "cells", "blank")
    # A split has two fragments at most.
    along = Window.partitionBy("file").orderBy("at")
    cut = parsed.where("fragment is not null").withColumn("owner", F.last(F.when(F.col("tail"), F.col("at")), ignorenulls=True).over(along))
    cut = cut.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "fragment"))).alias("parts"))
    cut = cut.withColumn("last", F.col("owner") == F.max("owner").over(Window.partitionBy("file")))
    numbers = spark.sparkContext.broadcast({n: (DELIMITERS[r["delimiter"]], r["broken"], r["end"]) for n, r in enumerate(states)})
    rows = rows.unionByName(cut.mapInArrow(_stitcher(numbers), PARSED).select("file", "at", "cells", "blank"))
    wide = {r["path"]: n for n, r in enumerate(states) if r["utf16"]}
    if wide:
        rows = rows.unionByName(_whole(spark, wide))
    return rows, paths


def _whole(spark: SparkSession, numbers: dict[str, int]) -> DataFrame:
    """Rows of whole files, for those that are not read in splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sink = _Sink()
                for at, row in enumerate(files.parse_csv(files.decode_text(data.as_py()))):
                    sink.row(numbers[name], at, row, False)
                yield from sink.batches()

    read = spark.read.format("binaryFile").load(list(numbers)).select(F.col("_metadata.file_path").alias("p"), "content")
    return read.mapInArrow(run, PARSED).select("file", "at", "cells", "blank")


def read_table(spark: SparkSession, path: str | list[str], rid: str = "__rid", most_headers: int = 10_000) -> DataFrame:
    """All CSV files under a path as one table of strings with ordinals, by path and place.

    Columns are matched by name: those of the first file come first, then what later files have besides; what a file does
    not have is empty in its rows. Short rows are padded, longer ones widen their file's columns. Files of blanks alone
    have no rows. Files may have ``most_headers`` different headers, which the driver holds; more are an error.
    """
    rows, paths = read_rows(spark, path)
    heads = rows.groupBy("file").agg(F.min_by("cells", "at").alias("head"), F.min("at").alias("first"), F.max(F.size("cells")).alias("width"), F.min("blank").alias("_blank")).where("not _blank")
    kinds = heads.groupBy("head", "width").agg(F.min("file").alias("file")).orderBy("file").limit(most_headers + 1).collect()
    if len(kinds) > most_headers:
        raise ValueError(f"the files have more than {most_headers} different headers")
    if not kinds:
        return spark.createDataFrame([], f"{rid} long")
    own = [files.unique_names(list(k["head"]) + [""] * (k["width"] - len(k["head"]))) for k in kinds]
    names = list(dict.fromkeys(n for o in own for n in o))
    body = rows.join(heads.select("file", "first", "head", "width"), "file").where("at > first")
    if len(own) == 1:
        place = [F.lit(own[0].index(n)) for n in names]
    else:
        where = [{n: i for i, n in enumerate(o)} for o in own]
        known = spark.createDataFrame([(list(k["head"]), k["width"], [w.get(n, -1) for n in names]) for k, w in zip(kinds, where, strict=True)], "head array<string>, width int, _places array<int>")
        # As many rows as there are headers.
        body = body.join(F.broadcast(known), ["head", "width"])
        place = [F.get("_places", F.lit(i)) for i in range(len(names))]
    cell = lambda p: F.when(p >= 0, F.coalesce(F.get("cells", p), F.lit(""))).otherwise("")
    return body.select((F.col("file").cast("long") * PLACES + F.col("at")).alias(rid), *[cell(p).alias(n) for p, n in zip(place, names, strict=True)])
