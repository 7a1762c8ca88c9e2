"""Line items of scanned receipts from where words stand: columns by a header line, else by what the cells of a line are.

A receipt is an array of lines of words with boxes. Either way of reading turns a line's cells into roles; how lines become
items is the same for both. Receipts are independent and go through Arrow-sized batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, islice, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import invoices, receipts
from .layout import WORD, Span, joined_cells
from .lineage import spread

LINES = f"array<struct<text:string,top:int,bottom:int,words:array<{WORD}>>>"
# Names of columns by role, what a price and a quantity look like, distances and shares.
ROLES = {
    "item": ("item", "items", "description", "desc", "product", "particulars", "article", "name"),
    "quantity": ("qty", "quantity", "units", "unit", "nos", "no", "count", "pcs"),
    "unit_price": ("price", "rate", "unitprice", "mrp", "each", "priceeach"),
    "amount": ("amount", "total", "amt", "value", "linetotal", "netamount"),
}
PRICE = re.compile(r"[₹$€£]?\s*[\d,]+\.\d{1,2}")
COUNT = re.compile(r"\d{1,4}")
LEAST_GAP, GAP_HEIGHTS = 18, 0.9
END_GAPS, END_HEIGHTS = 3, 2
MOST_MISALIGNED = 0.34
# End of fixed values.
ROLE_OF = {name: role for role, names in ROLES.items() for name in names}
FIGURES = ("quantity", "unit_price", "amount")
Reading = dict[str, str]


def number(text: str) -> float | None:
    """As ``cells.parse_number``: currency marks, commas and accounting parentheses allowed, nothing else."""
    if text.isascii() and text.isdigit():
        return float(text)
    v = text.strip()
    if negative := len(v) > 1 and v[0] == "(" and v[-1] == ")":
        v = v[1:-1]
    v = re.sub(r"[₹$€£,\s]", "", re.sub(r"\b(?:INR|USD|EUR|GBP|Rs\.?)\s*", "", v, flags=re.I))
    if not re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", v):
        return None
    return -abs(float(v)) if negative else float(v)


class Line:
    def __init__(self, text: str, top: int, bottom: int, words: list[tuple]):
        self.text, self.top, self.bottom = text, top, bottom
        self.height = bottom - top
        self.cells = joined_cells(words, max(LEAST_GAP, int(self.height * GAP_HEIGHTS)))

    @cached_property
    def footer(self) -> bool:
        low = self.text.lower()
        return any(w in low for w in receipts.NOT_ITEMS)


#: Roles of texts up to this length are kept by a worker, as many as that.
KEPT_TEXT, MOST_ROLES = 64, 4096


def _role(text: str) -> str | None:
    return ROLE_OF.get(text.lower().strip().strip(":.-").replace(" ", ""))


_kept_role = lru_cache(MOST_ROLES)(_role)


def role(cell: Span) -> str | None:
    return _kept_role(cell.text) if len(cell.text) <= KEPT_TEXT else _role(cell.text)


def middle(cell: Span) -> int:
    return (cell.left + cell.right) // 2


def by_header(header: Line) -> Callable[[Line], Reading]:
    """Cells by the header's column that is nearest; without a name for it, the first column has the items."""
    roles = [role(c) for c in header.cells]
    if "item" not in roles and roles[0] is None:
        roles[0] = "item"
    bounds = [(middle(a) + middle(b)) // 2 for a, b in pairwise(header.cells)]

    def read(line: Line) -> Reading:
        found: dict[str, list[str]] = {}
        for c in line.cells:
            if of := roles[bisect_left(bounds, middle(c))]:
                found.setdefault(of, []).append(c.text)
        # A figure that is no number is noise: blank, never moved.
        return {of: text for of, parts in found.items() if (text := " ".join(parts)) and (of == "item" or number(text) is not None)}

    return read


def by_content(line: Line) -> Reading:
    """The last price is the amount, the one before it the unit price, the first bare count the quantity, the rest the item."""
    texts = dict(enumerate(c.text for c in line.cells))
    prices = [i for i, t in texts.items() if PRICE.fullmatch(t)]
    if not prices:
        return {"item": line.text}
    out = {"amount": texts.pop(prices[-1])}
    if prices[:-1]:
        out["unit_price"] = texts.pop(prices[-2])
    if (count := next((i for i, t in texts.items() if COUNT.fullmatch(t)), None)) is not None:
        out["quantity"] = texts.pop(count)
    if rest := " ".join(texts.values()).strip():
        out["item"] = rest
    return out


def upto_end(lines: list[Line]) -> list[Line]:
    """The lines before the first that speaks of totals, or that stands far below compared with those before it."""
    gaps: list[int] = []
    for n, line in enumerate(lines):
        if line.footer:
            return lines[:n]
        if n:
            gap = max(0, line.top - lines[n - 1].bottom)
            if len(gaps) > 1 and gap > END_GAPS * sorted(gaps)[len(gaps) // 2] and gap > END_HEIGHTS * line.height:
                return lines[:n]
            gaps.append(gap)
    return lines


def detect(lines: list[Line]) -> tuple[list[tuple[str, str, str, str]], bool, bool]:
    """(items, whether a header was found, whether the lines fit the columns)."""
    lines = [x for x in lines if x.cells]
    named = [len({role(c) for c in x.cells} - {None}) for x in lines]
    if header := max(named, default=0) >= 2:
        at = named.index(max(named))
        read, body = by_header(lines[at]), lines[at + 1 :]
    else:
        at = next((n for n, x in enumerate(lines) if not x.footer and any(PRICE.fullmatch(c.text) for c in x.cells)), len(lines))
        read, body = by_content, lines[at:]
    items: list[Reading] = []
    judged = odd = 0
    for line in upto_end(body):
        got = read(line)
        wrapped = not any(f in got for f in FIGURES)
        judged += header or not wrapped
        if wrapped:
            # An item's name that goes on.
            if items and "item" in got:
                items[-1]["item"] = f"{items[-1].get('item', '')} {got['item']}".strip()
            continue
        odd += "item" not in got
        if "item" in got or (header and "amount" in got):
            items.append(got)
    return [tuple(x.get(k, "") for k in ("item", *FIGURES)) for x in items], bool(header), odd <= MOST_MISALIGNED * judged


def lists(column: pa.ListArray, rows: Iterator) -> Iterator[list]:
    """``rows``, one for each value of all lists, cut as the lists of ``column`` are; null lists are empty."""
    return (list(islice(rows, n or 0)) for n in column.value_lengths().to_pylist())


def scanned(lines: pa.ListArray) -> Iterator[list[Line]]:
    """The lines of each scan, made when they are asked for, from columns: a scan as nested rows takes longer to make than to read."""
    text, top, bottom, words = lines.flatten().flatten()
    values = lambda x: x.to_pylist() if x.null_count and pa.types.is_integer(x.type) else x.to_numpy(zero_copy_only=False).tolist()
    columns = lambda arrays: zip(*map(values, arrays), strict=True)
    boxes = lists(words, ((t or "", *box) for t, *box in columns(words.flatten().flatten())))
    return lists(lines, (Line(t or "", *box, held) for (t, *box), held in zip(columns((text, top, bottom)), boxes, strict=True)))


def seen_items(found: list[list[tuple]]) -> pa.ListArray:
    """Items by scan as a column of arrays of structs."""
    names, columns = ("description", *FIGURES), zip(*[x for items in found for x in items], strict=True)
    arrays = [pa.array(c, pa.string()) for c in columns] or [pa.array([], pa.string())] * len(names)
    offsets = pa.array(accumulate((len(items) for items in found), initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, names))


def extract(scans: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str = "lines") -> DataFrame:
    """One row for each scan: doc_id, fields, items, subtotal, tax, total, header_found, aligned, items_review, totals_review.

    Fields come from the text; items from the lines' words or, where these have none, from the text. Then gaps are filled
    and sums are checked; items whose lines do not fit the columns are to be reviewed. Null texts and lines are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(lines) for lines in scanned(batch.column("lines"))]
            header_found, aligned = (pa.array([x[i] for x in found], pa.bool_()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), seen_items([x[0] for x in found]), header_found, aligned], ["doc_id", "text", "seen", "header_found", "aligned"])

    chosen = scans.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text", f"cast(`{lines}` as {LINES}) as lines")
    seen = spread(chosen).mapInArrow(run, f"doc_id long, text string, seen array<{invoices.ITEM}>, header_found boolean, aligned boolean")
    read = receipts.parsed_columns(seen).withColumn("items", F.when(F.size("seen") > 0, F.col("seen")).otherwise(F.col("items")))
    read = read.select("doc_id", "fields", "items", "subtotal", "tax", "total", "header_found", "aligned")
    return invoices.checked(invoices.fill_gaps(read)).withColumn("items_review", F.col("items_review") | ~F.col("aligned"))
