"""The table cleaning pipeline: detection, cells, calculated columns, missing values, rows, duplicates, links.

A table is a DataFrame of strings with the ordinal of each row in ``__rid``. Options are resolved on the driver, so each
column gets only the expressions that its type needs, and cleaned columns stay one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells
from . import dedupe
from .lineage import cut, written

RID = "__rid"
SAMPLE, SHARE = 50, 0.8


def dense_ordinals(ordered: DataFrame, out: str = RID) -> DataFrame:
    """Places from 0 on along the order of a sorted DataFrame: places in its partitions plus what lies before them.

    Only the partitions' sizes go through one task, and they are what is broadcast: a row for each partition.
    """
    placed = cut(ordered.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__m"), 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return placed.join(F.broadcast(before), part == F.col("__p")).withColumn(out, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__b")


@dataclass(frozen=True)
class Rule:
    """What one column asks for."""

    skip: bool = False
    case: str | None = None
    fill: str | None = None
    type: str | None = None
    action: str | None = None  # FLAG, BLANK or REMOVE_ROW for invalid cells
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Replace:
    find: str
    to: str = ""
    regex: bool = False
    ignore_case: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Calculated:
    target: str
    a: str
    op: str
    b: str
    overwrite: bool = True
    decimals: int = 2


@dataclass(frozen=True)
class Options:
    trim: bool = True
    collapse: bool = True
    strip: bool = False
    case: str = "NONE"
    normalise: bool = True
    month_first: bool = False
    spelling: str = "YES_NO"
    action: str = "FLAG"
    missing: str = "NONE"  # NONE, FILL, FLAG or REMOVE_ROW
    fill: str | None = None
    required: tuple[str, ...] = ()
    drop_empty: bool = True
    exact: bool = True
    normalised: bool = False
    similar: bool = False
    threshold: float = 0.92
    keys: tuple[str, ...] = ()
    replaces: tuple[Replace, ...] = ()
    calculated: tuple[Calculated, ...] = ()
    rules: dict[str, Rule] = field(default_factory=dict)


def body(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def with_ordinals(df: DataFrame, *order: str) -> DataFrame:
    """Strings with ordinals: ranks in a given order, computed by ranges and not in one task, else the order of the files."""
    strings = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns], *([F.struct(*order).alias("_o")] if order else []))
    if not order:
        return strings.withColumn(RID, F.monotonically_increasing_id())
    return strings.orderBy("_o").withColumn(RID, F.monotonically_increasing_id()).drop("_o")


def detect(df: DataFrame) -> dict[str, str]:
    """The type of each column by its first 50 values: the largest share of matches, 0.8 at least, the earlier on ties."""
    names = body(df)
    if not names:
        return {}
    votes = {}
    # One job; a task gives 50 values of a column at most.
    for i, c in enumerate(names):
        v = cells.ws_trim(F.col(f"`{c}`"))
        votes[f"v{i}"] = F.when(v != "", F.struct(F.col(RID), v.alias("v")))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("x")) for k, v in votes.items()])).alias("r")).where("r.x is not null").select("r.c", f"r.x.{RID}", "r.x.v")
    first = Window.partitionBy("c").orderBy(RID)
    sample = long.withColumn("n", F.row_number().over(first)).where(f"n <= {SAMPLE}")
    shares = sample.groupBy("c").agg(*[F.avg(cells.full("v", p).cast("double")).alias(t) for t, p in cells.TYPES.items()]).collect()
    out = dict.fromkeys(names, "TEXT")
    for r in shares:
        best = max(cells.TYPES, key=lambda t: (r[t], -list(cells.TYPES).index(t)))
        if r[best] >= SHARE:
            out[names[int(r["c"][1:])]] = best
    return out


def numeric_range(name: str, rule: Rule | None = None) -> tuple[float | None, float | None]:
    """Bounds of a numeric column by its rule, else by its name; the first that fits."""
    if rule and (rule.low is not None or rule.high is not None):
        return rule.low, rule.high
    name = name.lower()
    # Fixed values.
    table = ((("age",), 0.0, 120.0), (("salary", "income", "wage", "price", "amount", "cost", "fee", "revenue"), 0.0, None), (("percent", "%"), 0.0, 100.0), (("quantity", "qty", "count", "stock"), 0.0, None))
    return next(((lo, hi) for words, lo, hi in table if any(w in name for w in words)), (None, None))


def _text(name: str, kind: str, o: Options) -> tuple[Column, Column, Column]:
    """(text of a cell: replaced, stripped, trimmed, collapsed, and in the case asked for; replacements; letters stripped)."""
    rule = o.rules.get(name) or Rule()
    v, replaced, stripped = F.col(f"`{name}`"), F.lit(0), F.lit(0)
    if rule.skip:
        return v, replaced, stripped
    for r in o.replaces:
        if r.column is None or r.column == name:
            before, v = v, cells.replace_all(v, r.find, r.to, r.regex, r.ignore_case)
            replaced = replaced + F.coalesce((v != before).cast("int"), F.lit(0))
    if o.strip:
        before, v = v, cells.strip_unwanted(v)
        stripped = F.coalesce(F.length(before) - F.length(v), F.lit(0))
    if o.trim:
        v = cells.ws_trim(v)
    if o.collapse:
        v = cells.collapse(v)
    return (cells.change_case(v, rule.case or o.case) if kind == "TEXT" else v), replaced, stripped


def _normal(v: Column, name: str, kind: str, o: Options) -> Column | None:
    """The normal form of a text by its type, null for an invalid one; None for types without a normal form."""
    if not o.normalise or (o.rules.get(name) or Rule()).skip:
        return None
    if kind == "NUMBER":
        return F.when(_inside(v.try_cast("double"), name, o), v)
    made = {"EMAIL": cells.normal_email, "PHONE": cells.normal_phone, "DATE": lambda x: cells.normal_date(x, o.month_first), "CURRENCY": cells.normal_currency, "BOOLEAN": lambda x: cells.normal_boolean(x, o.spelling)}
    return made[kind](v) if kind in made else None


# Why a cell was changed, and what is counted for columns of a type: cells changed, cells found invalid.
CHANGED = {"EMAIL": "email normalized", "PHONE": "phone normalized to 10 digits", "DATE": "date standardized to YYYY-MM-DD", "CURRENCY": "currency cleaned to numeric", "BOOLEAN": "boolean normalized"}
BLANKED = {"EMAIL": "invalid email blanked", "PHONE": "invalid phone blanked", "DATE": "unparseable date blanked"}
SYMBOLS = {"ADD": "+", "SUBTRACT": "−", "MULTIPLY": "×", "DIVIDE": "÷"}
COUNTED = {"PHONE": "phones_normalized", "DATE": "dates_standardized", "CURRENCY": "currency_cells_cleaned", "BOOLEAN": "booleans_normalized"}
COUNTED_INVALID = {"EMAIL": "invalid_emails", "PHONE": "invalid_phones", "DATE": "dates_unparseable", "CURRENCY": "invalid_numeric_values", "NUMBER": "invalid_numeric_values"}
# End of fixed values.
CHANGE = "struct<column:string,before:string,after:string,reason:string>"


def _inside(n: Column, name: str, o: Options) -> Column:
    """Whether a number is in the range of its column; true where there is none."""
    lo, hi = numeric_range(name, o.rules.get(name))
    return F.coalesce((n >= lo) if lo is not None else F.lit(True), F.lit(True)) & F.coalesce((n <= hi) if hi is not None else F.lit(True), F.lit(True))


def _staged(df: DataFrame, o: Options, kinds: dict[str, str], log: bool, counted: tuple[Observation, list[Column]] | None = None) -> DataFrame:
    """The rows of ``df`` with cleaned cells, written once: ``__bad`` cells, whether the row is to ``__drop`` and why, and
    with ``log`` also its ``__log`` of changes and ``__count`` of what was done."""
    names = body(df)
    skipped = {c for c in names if c in o.rules and o.rules[c].skip}
    # Three projections, so that a text and its normal form are each computed once.
    texts = {i: _text(c, kinds[c], o) for i, c in enumerate(names)}
    tally = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0))
    counts = [tally([t[1] for t in texts.values()]).alias("__replaced"), tally([t[2] for t in texts.values()]).alias("__stripped")] if log else []
    out = df.select(RID, *[F.col(f"`{c}`") for c in names], *[t[0].alias(f"__t{i}") for i, t in texts.items()], *counts)
    normal = {i: n for i, c in enumerate(names) if (n := _normal(F.col(f"__t{i}"), c, kinds[c], o)) is not None}
    out = out.select("*", *[n.alias(f"__n{i}") for i, n in normal.items()])
    bad = {i: ~cells.blank(f"__t{i}") & F.col(f"__n{i}").isNull() for i in normal}
    # Money is held against its column's range once it is a number; it keeps its normal form.
    beyond = {i: F.coalesce(~_inside(F.col(f"__n{i}").try_cast("double"), names[i], o), F.lit(False)) for i in normal if kinds[names[i]] == "CURRENCY" and numeric_range(names[i], o.rules.get(names[i])) != (None, None)}
    action = {i: (o.rules.get(names[i]) or Rule()).action or o.action for i in normal}
    reason = lambda i: "out of range" if kinds[names[i]] == "NUMBER" else f"invalid {kinds[names[i]].lower()}"
    cell = lambda i, value, kind, why: F.struct(F.lit(names[i]).alias("column"), F.col(value).alias("value"), F.lit(kind).alias("expected"), F.lit(why).alias("reason"))
    found_bad = [F.when(b, cell(i, f"__t{i}", kinds[names[i]], reason(i))) for i, b in bad.items()] + [F.when(b, cell(i, f"__n{i}", "NUMBER", "out of range")) for i, b in beyond.items()]
    reasons = F.filter(F.array(*found_bad), lambda x: x.isNotNull()) if found_bad else F.array().cast("array<struct<column:string,value:string,expected:string,reason:string>>")
    dropping = reduce(lambda a, b: a | b, [b for found in (bad, beyond) for i, b in found.items() if action[i] == "REMOVE_ROW"], F.lit(False))
    blanked = {i for i in normal if action[i] == "BLANK" and kinds[names[i]] in BLANKED}

    def value(i: int) -> Column:
        text = F.col(f"__t{i}")
        if i not in normal:
            return text
        return F.when(bad[i], F.lit("") if i in blanked else text).otherwise(F.coalesce(F.col(f"__n{i}"), text))

    change = lambda c, before, after, why: F.struct(F.lit(c).alias("column"), before.alias("before"), after.alias("after"), F.lit(why).alias("reason"))
    made = []
    for i in normal if log else ():
        kind, text = kinds[names[i]], F.col(f"__t{i}")
        if kind in CHANGED:
            made.append(F.when(~bad[i] & (F.col(f"__n{i}") != text), change(names[i], text, F.col(f"__n{i}"), CHANGED[kind])))
        if i in blanked:
            made.append(F.when(bad[i], change(names[i], text, F.lit(""), BLANKED[kind])))
    some = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast(f"array<{CHANGE}>")
    logged = [some(made).alias("__log"), "__replaced", "__stripped"] if log else []
    out = out.select(RID, *[value(i).alias(c) for i, c in enumerate(names)], reasons.alias("__bad"), dropping.alias("__drop"), *logged)
    for calc in o.calculated:
        result = cells.format_number(cells.calculate(cells.parse_number(f"`{calc.a}`"), calc.op, cells.parse_number(f"`{calc.b}`")), calc.decimals)
        result = F.when(result != "", result)
        target = F.col(f"`{calc.target}`")
        new = F.coalesce(result, target) if calc.overwrite else F.when(cells.blank(target), F.coalesce(result, target)).otherwise(target)
        if log:
            entry = F.when(~F.coalesce(new.eqNullSafe(target), F.lit(True)), change(calc.target, F.coalesce(target, F.lit("")), new, f"calculated: {calc.a} {SYMBOLS[calc.op]} {calc.b}"))
            out = out.withColumns({"__log": F.concat("__log", some([entry])), calc.target: new})
        else:
            out = out.withColumn(calc.target, new)
    empty = {c: cells.blank(f"`{c}`") for c in names if c not in skipped}
    fills = {c: fill for c in empty if (fill := o.rules[c].fill if c in o.rules and o.rules[c].fill is not None else o.fill)} if o.missing == "FILL" else {}
    if log:
        out = out.withColumns({"__missing": tally([e.cast("int") for e in empty.values()]), "__filled": tally([empty[c].cast("int") for c in fills])})
    gaps = F.lit(False)
    if o.missing == "REMOVE_ROW":
        gaps = reduce(lambda a, b: a | b, [cells.blank(f"`{c}`") for c in (o.required or names)], F.lit(False))
    out = out.withColumns({"__gap": gaps, **{c: F.when(empty[c], fill).otherwise(F.col(f"`{c}`")) for c, fill in fills.items()}})
    # Written once: filters on cleaned cells would else be pushed below the cleaning and repeat it, as would each use below.
    return cut(out) if counted is None else written(out.observe(counted[0], *counted[1]), "cleaned")


def _kinds(df: DataFrame, o: Options, types: dict[str, str] | None) -> dict[str, str]:
    found = detect(df) if types is None else types
    return {c: (o.rules[c].type if c in o.rules and o.rules[c].type else "TEXT" if c in o.rules and o.rules[c].skip else found.get(c, "TEXT")) for c in body(df)}


def _filled(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~cells.blank(f"`{c}`") for c in names], F.lit(False))


def _not_empty(staged: DataFrame, names: list[str]) -> DataFrame:
    return staged.where(_filled(names))


def _thinned(rows: DataFrame, o: Options, names: list[str]) -> list[DataFrame]:
    """The rows after each kind of duplicates went: exact, normalised, similar."""
    keys, out = list(o.keys) or names, [rows]
    out.append(dedupe.keep_first(out[-1], keys, RID) if o.exact else out[-1])
    out.append(dedupe.keep_first(out[-1], keys, RID, normalised=True) if o.normalised else out[-1])
    out.append(dedupe.drop_similar(out[-1], keys, RID, o.threshold) if o.similar else out[-1])
    return out[1:]


def _invalid(staged: DataFrame, out: DataFrame, kinds: dict[str, str]) -> DataFrame:
    invalid = staged.select(RID, F.explode("__bad").alias("b")).select(RID, "b.*")
    links = [c for c in kinds if kinds[c] == "URL"]
    if links:
        broken = out.select(RID, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in links])).alias("l")).select(RID, "l.*")
        broken = broken.where(~cells.blank("value") & ~cells.full(cells.ws_trim("value"), cells.URL))
        invalid = invalid.unionByName(broken.select(RID, "column", "value", F.lit("URL").alias("expected"), F.lit("invalid url").alias("reason")))
    return invalid


def clean(df: DataFrame, o: Options = Options(), types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, its invalid cells as (__rid, column, value, expected, reason)).

    Filling comes before empty rows go, blanked cells count as missing, and links are only reported.
    """
    names, kinds = body(df), _kinds(df, o, types)
    staged = _staged(df, o, kinds, log=False)
    rows = _not_empty(staged, names) if o.drop_empty else staged
    out = _thinned(rows.where(~(F.col("__drop") | F.col("__gap"))).select(RID, *names), o, names)[-1]
    return out, _invalid(staged, out, kinds)


def report(df: DataFrame, o: Options = Options(), types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of counters of what ``clean`` does with ``df``; its changes as (__rid, column, before, after, reason)).

    Counters are sums over the rows, observed while the cleaned rows are written; only duplicates are counted afterwards. All
    changes are given; whoever shows them takes as many as there is room for. A table without rows has zeros.
    """
    names, kinds = body(df), _kinds(df, o, types)
    seen = Observation()

    def counters() -> list[Column]:
        kind_of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.lit(None).cast("map<string,string>")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        changed = lambda kind: total(F.size(F.filter("__log", lambda x: x["reason"] == CHANGED[kind])))
        invalid = lambda which: total(F.size(F.filter("__bad", lambda x: kind_of[x["column"]].isin(which))))
        there = _filled(names) if o.drop_empty else F.lit(True)
        sums = {
            "rows_in": F.count(F.lit(1)),
            "unwanted_chars_removed": total("__stripped"),
            "replacements_made": total("__replaced"),
            "calculated_cells_filled": total(F.size(F.filter("__log", lambda x: x["reason"].startswith("calculated: ")))),
            **{name: changed(kind) for kind, name in COUNTED.items()},
            **{name: invalid([k for k, n in COUNTED_INVALID.items() if n == name]) for name in dict.fromkeys(COUNTED_INVALID.values())},
            "missing_values_found": total("__missing"),
            "missing_values_filled": total("__filled"),
            "empty_rows_removed": F.count_if(~there),
            "rows_removed_for_invalid_values": F.count_if(there & F.col("__drop")),
            "rows_removed_for_missing_values": F.count_if(there & F.col("__gap") & ~F.col("__drop")),
        }
        return [c.cast("long").alias(name) for name, c in sums.items()]

    staged = _staged(df, o, kinds, log=True, counted=(seen, counters()))
    counts = seen.get
    rows = _not_empty(staged, names) if o.drop_empty else staged
    kept = rows.where(~(F.col("__drop") | F.col("__gap"))).select(RID, *names)
    keys = [F.col(f"`{c}`") for c in (o.keys or names)]
    plain = [F.lower(cells.ws_trim(F.coalesce(k, F.lit("")))) for k in keys]
    # Rows that stay are as many as there are keys, but for similar ones, which must be found.
    different = lambda of: kept.select(*[k.alias(f"k{i}") for i, k in enumerate(of)]).distinct().count()
    left = counts["rows_in"] - sum(counts[k] for k in ("empty_rows_removed", "rows_removed_for_invalid_values", "rows_removed_for_missing_values"))
    exact = different(keys) if o.exact else left
    similar = _thinned(kept, o, names)[-1].count() if o.similar else different(plain) if o.normalised else exact
    counts |= {"missing_values_flagged": counts["missing_values_found"] if o.missing == "FLAG" else 0}
    counts |= {"exact_duplicates_removed": left - exact, "fuzzy_duplicates_removed": exact - similar, "duplicates_removed": left - similar, "rows_out": similar}
    counted = df.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in counts.items()])
    return counted, staged.select(RID, F.explode("__log").alias("l")).select(RID, "l.*")


def table_quality(df: DataFrame) -> DataFrame:
    """0 to 100 by filled cells and distinct rows; 40 for a table without rows."""
    names = body(df)
    filled = reduce(lambda a, b: a + b, [F.when(cells.blank(f"`{c}`"), 0).otherwise(1) for c in names])
    n = F.count("*")
    score = F.sum(filled) / (n * len(names)) * 50 + 35 + F.count_distinct(F.concat_ws("|", *[F.col(f"`{c}`") for c in names])) / n * 15
    return df.agg(F.when(n == 0, 40).otherwise(F.floor(F.least(F.lit(100.0), score))).cast("int").alias("score"))
