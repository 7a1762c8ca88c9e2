"""Mergeable quantile summaries by simultaneous bisection multiselect.

A summary of a group's batch is a list of cut points, each with the exact number of rows below it and up to it. Cut values
are found without sorting rows: all ranks of all batches are searched at once, each pass counts the rows up to the
midpoints of every interval that is still open, and the intervals shrink around the values whose counts reach the ranks.
Summaries are merged by sums of bounds: at any value a batch's count lies between that of its cut point before and that of
its cut point after, and what a value's bounds are in the whole is the sum over batches.

A batch keeps the values at 100 even ranks and its extremes, and 20 values at even ranks among its different ones, or all
values if it has 121 rows or fewer. So a batch's uncertainty at a value is a hundredth of its rows, the sum of all batches'
is a hundredth of the group, and the cut point with the least worst case is within half of that.

Rows are kept as pieces, rows with arrays of different values and their counts: at most about PIECE each, so that a hot
group is many pieces in many tasks. In a pass pieces stay where they are and only the probes are dealt to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_by, small, written

BATCHES = 16
#: Answers are given for i of QUANTILES, cut ranks are j of CUTS, a multiple of it.
QUANTILES = 20
CUTS = 100
#: Different values that a summary keeps at least, where there are as many.
VALUES = 20
#: A batch with so many rows or fewer keeps every value.
COMPLETE = CUTS + 1 + VALUES
WHOLE = -1
#: Different values in a piece, on average at most.
PIECE = 4_096
#: Halvings of an interval in one pass, by counts at 2 to this power less one midpoints.
HALVINGS = 5
#: Bits of the map that tells keys whose batches are searched: 1 MB at most. Keys that share a bit are searched too, with the same result.
FILTER_BITS = 1 << 23
WORD = 32_768

POINTS = pa.list_(pa.struct([("batch", pa.int32()), ("x", pa.int64()), ("lt", pa.int64()), ("le", pa.int64())]))
ANSWERS = "key string, batch int, i int, n long, target long, points long, answer long, exact_x long, n_below long, n_upto long, low long, high long"
STATE = "key string, owner int, by_rows int, ranks array<long>, lo array<long>, hi array<long>, probes array<long>"


def batch_of(ident: Column) -> Column:
    return (F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % BATCHES).cast("int")


def scaled(money: Column, batch: Column) -> Column:
    return F.floor(100 * money + 0.5) + 1000 * batch.cast("long")


def _usable(key: str, money: str) -> Column:
    return F.col(key).isNotNull() & (F.abs(F.col(money)) < float("inf"))  # NaN is above infinity


def value_rows(clicks: DataFrame) -> DataFrame:
    """(key, batch, x, n) of clicks: one row for each click_id, of rows that repeat it but differ the one with the least hash; null ids count as one."""
    h = F.xxhash64("client_id", "value", "ts", "arrived_at")
    once = clicks.groupBy("click_id").agg(F.min_by("client_id", h).alias("client_id"), F.min_by("value", h).alias("value"))
    batch = batch_of(F.col("click_id"))
    return once.where(_usable("client_id", "value")).select(F.concat(F.lit("value:"), F.col("client_id").cast("string")).alias("key"), batch.alias("batch"), scaled(F.col("value"), batch).alias("x"), F.lit(1).cast("long").alias("n"))


def price_rows(sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """(key, batch, x, n) of sale lines with their item, by brand: lines are counted by item and batch before they meet their item, so a hot item is 16 rows."""
    counted = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("n"))
    known = items.where(_usable("brand", "price")).select("item_id", "brand", "price")
    rows = counted.join(known, "item_id").select(F.concat(F.lit("price:"), F.col("brand").cast("string")).alias("key"), "batch", scaled(F.col("price"), F.col("batch")).alias("x"), "n")
    return rows.groupBy("key", "batch", "x").agg(F.sum("n").alias("n"))


def searched(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_open``: whether their key has a batch of over COMPLETE rows, told by a map of bits of fixed size."""
    slot = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    large = rows.groupBy("key", "batch").agg(F.sum("n").alias("n")).where(F.col("n") > COMPLETE).select(slot.alias("slot")).distinct()
    bits = large.groupBy(F.expr(f"slot div {WORD}").alias("_word")).agg(F.bitmap_construct_agg(F.expr(f"slot % {WORD}")).alias("_bits"))
    marked = rows.withColumn("_slot", slot).withColumn("_word", F.expr(f"_slot div {WORD}"))
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast((_slot % {WORD}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("getbit", byte, F.expr("cast(_slot % 8 as int)")) == 1
    # 256 words of 4 KB at most: the bound of this broadcast.
    return marked.join(F.broadcast(cut(bits)), "_word", "left").withColumn("_open", F.coalesce(hit, F.lit(False))).drop("_slot", "_word", "_bits")


def pieces_of(rows: DataFrame) -> DataFrame:
    """(key, batch, chunk, xs, ns): the different values of each batch and their counts, in pieces dealt by the values' hash, checkpointed by piece."""
    rows = written(rows.groupBy("key", "batch", "x").agg(F.sum("n").alias("n")), "values")
    large = small(rows.groupBy("key", "batch").agg(F.count("*").alias("_values")).where(F.col("_values") > PIECE))
    chunks = F.coalesce(F.ceil(F.col("_values") / PIECE), F.lit(1))
    dealt = rows.join(large, ["key", "batch"], "left").withColumn("chunk", F.pmod(F.xxhash64("x"), chunks).cast("int"))
    arrays = lambda d: d.groupBy("key", "batch", "chunk").agg(F.collect_list(F.struct("x", "n")).alias("r")).select("key", "batch", "chunk", F.col("r.x").alias("xs"), F.col("r.n").alias("ns"))
    return cut_by(dealt, "key", "batch", "chunk", then=arrays)


def _midpoints(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The midpoints of HALVINGS halvings of each interval, in order: a row for each interval."""
    steps, width = np.arange(1, 1 << HALVINGS), (hi - lo)[:, None]
    return lo[:, None] + (width >> HALVINGS) * steps + ((width & ((1 << HALVINGS) - 1)) * steps >> HALVINGS)


def _probes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    wide = hi > lo
    return np.unique(_midpoints(lo[wide], hi[wide]))


def _states(keys, rows) -> pa.RecordBatch:
    by, ranks, lo, hi, probes = zip(*rows, strict=True) if rows else ([],) * 5
    lists = [pa.array(x, pa.list_(pa.int64())) for x in (ranks, lo, hi, probes)]
    return pa.record_batch([*keys, pa.array(by, pa.int32()), *lists], ["key", "owner", "by_rows", "ranks", "lo", "hi", "probes"])


def opened(batches):
    """States (key, owner, by_rows, ranks, lo, hi) with their first probes."""
    for b in batches:
        rows = []
        for by, ranks, lo, hi in zip(*(b.column(c).to_pylist() for c in ("by_rows", "ranks", "lo", "hi")), strict=True):
            rows.append((by, ranks, lo, hi, _probes(np.array(lo, np.int64), np.array(hi, np.int64))))
        yield _states([b.column("key"), b.column("owner")], rows)


def halved(batches):
    """States and what was counted at their probes, as states with smaller intervals and the next probes."""
    for b in batches:
        rows = []
        for at in range(b.num_rows):
            one = lambda c: b.column(c)[at].values.to_numpy(zero_copy_only=False)
            by, ranks, lo, hi, probes = b.column("by_rows")[at].as_py(), *(one(c) for c in ("ranks", "lo", "hi", "probes"))
            got = b.column("got")[at].values
            order = np.argsort(got.field("pos").to_numpy(zero_copy_only=False))
            counts = np.stack([got.field(c).to_numpy(zero_copy_only=False)[order] for c in ("rows", "vals")])
            wide = np.flatnonzero(hi > lo)
            lo, hi, mids = lo.copy(), hi.copy(), _midpoints(lo[wide], hi[wide])
            # Ranks among rows come first, then those among different values.
            reached = counts[(wide >= by).astype(int)[:, None], np.searchsorted(probes, mids)] >= ranks[wide][:, None]
            first = np.where(reached.any(axis=1), reached.argmax(axis=1), mids.shape[1])
            each = np.arange(len(wide))
            above = np.where(first > 0, mids[each, np.maximum(first - 1, 0)] + 1, lo[wide])
            hi[wide] = np.where(first < mids.shape[1], mids[each, np.minimum(first, mids.shape[1] - 1)], hi[wide])
            lo[wide] = above
            rows.append((by, ranks, lo, hi, _probes(lo, hi)))
        yield _states([b.column("key"), b.column("owner")], rows)


def tallied(batches):
    """Rows of pieces with the probes of their owner, as the rows and the different values up to each probe, summed within the task."""
    held: dict = {}

    def out():
        keys, sums = list(held), list(held.values())
        columns = [pa.array([k for k, _ in keys], pa.string()), pa.array([o for _, o in keys], pa.int32())]
        return pa.record_batch([*columns, *(pa.array([s[i] for s in sums], pa.list_(pa.int64())) for i in (0, 1))], ["key", "owner", "rows", "vals"])

    for b in batches:
        names = zip(b.column("key").to_pylist(), b.column("owner").to_pylist(), strict=True)
        for at, name in enumerate(names):
            probes, xs, ns = (b.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("probes", "xs", "ns"))
            place = np.searchsorted(probes, xs)
            # Sums of counts are whole numbers below 2 to the 53.
            sums = np.stack([np.bincount(place, ns, len(probes) + 1), np.bincount(place, minlength=len(probes) + 1)])[:, :-1].cumsum(axis=1).astype(np.int64)
            held[name] = held[name] + sums if name in held else sums
        if len(held) > 256:
            yield out()
            held.clear()
    if held:
        yield out()


def counts(pieces: DataFrame, owners: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, owner, got): at each probe (key, owner, probes) the rows and different values up to it, as an array of (pos, rows, vals).

    ``owners``: key, batch, chunk of each piece and the owner whose probes it answers. A probe row is repeated for each of
    its pieces, which are much larger than it.
    """
    dealt = owners.join(probes.select("key", "owner", "probes"), ["key", "owner"])
    met = pieces.join(dealt.hint("shuffle_hash"), ["key", "batch", "chunk"]).select("key", "owner", "probes", "xs", "ns")
    # Each task has summed an owner's pieces to one row of arrays, so dealing these is all that its sums need.
    parts = met.mapInArrow(tallied, "key string, owner int, rows array<long>, vals array<long>").repartition("key", "owner")
    each = parts.select("key", "owner", F.posexplode(F.arrays_zip("rows", "vals")).alias("pos", "c"))
    sums = each.groupBy("key", "owner", "pos").agg(F.sum("c.rows").alias("rows"), F.sum("c.vals").alias("vals"))
    return sums.groupBy("key", "owner").agg(F.collect_list(F.struct("pos", "rows", "vals")).alias("got"))


def multiselect(pieces: DataFrame, owners: DataFrame, states: DataFrame) -> DataFrame:
    """States (key, owner, by_rows, ranks, lo, hi) with lo = hi = the smallest value up to which there are as many rows as the rank.

    The first ``by_rows`` ranks count rows, the others different values; lo and hi must enclose what is sought. Each pass
    is one count over the pieces of all owners that have an open interval.
    """
    state = cut(states.mapInArrow(opened, STATE))
    while state.agg(F.max(F.size("probes"))).first()[0]:
        still = state.where("size(probes) > 0")
        moved = still.join(counts(pieces, owners, still), ["key", "owner"]).mapInArrow(halved, STATE)
        state = cut(moved.unionAll(state.where("size(probes) = 0")))
    return state


def batch_summaries(pieces: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, batch, points): the cut points of each batch with the rows below and up to each."""
    sizes = pieces.select("key", "batch", F.expr("aggregate(ns, 0L, (a, n) -> a + n)").alias("n"), F.size("xs").cast("long").alias("d"), F.array_min("xs").alias("lo"), F.array_max("xs").alias("hi"))
    sizes = sizes.groupBy("key", "batch").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    even = lambda n, k, of: F.expr(f"transform(sequence({n}L, {k}L), j -> greatest(1L, (j * {of} + {k} - 1) div {k}))")
    few = F.col("n") <= COMPLETE
    ranks = F.when(few, F.sequence(F.lit(1).cast("long"), F.col("d"))).otherwise(F.concat(even(0, CUTS, "n"), even(1, VALUES, "d")))
    states = sizes.select("key", F.col("batch").alias("owner"), F.when(few, 0).otherwise(CUTS + 1).alias("by_rows"), ranks.alias("ranks"), "lo", "hi")
    states = states.select("key", "owner", "by_rows", "ranks", *[F.expr(f"array_repeat({c}, size(ranks))").alias(c) for c in ("lo", "hi")])
    found = multiselect(pieces, owners, states)
    around = found.select("key", "owner", F.array_distinct("lo").alias("cuts"))
    around = around.select("key", "owner", "cuts", F.expr("array_sort(array_distinct(flatten(transform(cuts, c -> array(c - 1, c)))))").alias("probes"))
    got = around.join(counts(pieces, owners, around), ["key", "owner"]).select("key", F.col("owner").alias("batch"), "cuts", up_to().alias("up"))
    points = F.expr("transform(cuts, c -> struct(batch, c as x, element_at(up, c - 1) as lt, element_at(up, c) as le))")
    return got.select("key", "batch", points.alias("points"))


def up_to() -> Column:
    """Of probes and got: a map from each probe to the rows up to it."""
    return F.expr("map_from_arrays(probes, transform(array_sort(got), g -> g.rows))")


def _flat(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: the row of each entry, and the fields."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    of = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
    return of, [f.to_numpy(zero_copy_only=False) for f in held.flatten().flatten()]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _points(of, batch, x, n):
    """All values of each batch with the rows below and up to each: a summary that leaves nothing out."""
    order = np.lexsort((x, batch, of))
    of, batch, x, n = of[order], batch[order], x[order], n[order]
    first = np.flatnonzero(_starts(of, batch, x))
    of, batch, x, n = of[first], batch[first], x[first], np.add.reduceat(n, first) if len(first) else n
    le = n.cumsum()
    before = np.maximum.accumulate(np.where(_starts(of, batch), le - n, 0)) if len(le) else le
    return of, batch, x, le - n - before, le - before


def _targets(n: int) -> np.ndarray:
    return -(-np.arange(1, QUANTILES) * n // QUANTILES)


def answered(complete: bool):
    """Of each key's batch summaries, the answers of every batch and of the whole with QUANTILES rows or more.

    Input: key and entries; these are (batch, x, n) if ``complete``, all values of all batches, else points (batch, x, lt,
    le). A batch's target ranks are among its cut ranks, so its answers are exact. The whole's answer is the cut point whose
    bounds have the least worst case, of several the smallest; its exact columns are null unless all values are known.
    """

    def answer(batches):
        for b in batches:
            of, fields = _flat(b.column("entries"))
            if complete:
                of, batch, x, lt, le = _points(of, *fields)
            else:
                order = np.lexsort((fields[1], fields[0], of))
                of, (batch, x, lt, le) = of[order], (f[order] for f in fields)
            if not len(of):
                continue
            new = _starts(of, batch)
            start, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(of))
            rows = []
            i = np.arange(1, QUANTILES)
            for s, e in zip(start, end, strict=True):
                if (n := le[e - 1]) >= QUANTILES:
                    t = _targets(int(n))
                    at = s + np.searchsorted(le[s:e], t)
                    rows.append((np.full(len(i), of[s]), np.full(len(i), batch[s]), i, np.full(len(i), n), t, np.full(len(i), e - s), x[at], x[at], lt[at], le[at], x[at], x[at]))
            # By how much each cut point raises the sums of the lower bounds, from it on, and of the upper bounds, after it.
            last = np.append(new[1:], True)
            lower, upper = le - np.where(new, 0, np.append(0, le[:-1])), np.where(last, le, np.append(lt[1:], 0)) - lt
            order = np.lexsort((x, of))
            of2, x2, lower, upper = of[order], x[order], lower[order].cumsum(), upper[order]
            upper = upper.cumsum() - upper
            first = np.flatnonzero(_starts(of2, x2))
            final = np.append(first[1:], len(of2)) - 1
            of2, x2, lower, upper = of2[first], x2[first], lower[final], upper[first]
            edge = np.flatnonzero(_starts(of2))
            for s, e in zip(edge, np.append(edge[1:], len(of2)), strict=True):
                lo, hi = lower[s:e] - (lower[s - 1] if s else 0), upper[s:e] - upper[s]
                if (n := lo[-1]) < QUANTILES:
                    continue
                t = _targets(int(n))
                q = np.minimum(np.searchsorted(lo + hi + 1, 2 * t), e - s - 1)
                p = np.maximum(q - 1, 0)
                at = s + np.where((p < q) & (t - lo[p] <= np.maximum(hi[q] + 1 - t, t - lo[q])), p, q)
                low, high = s + np.searchsorted(hi, t) - 1, s + np.searchsorted(lo, t)
                known = (x2[high], hi[at - s], lo[at - s]) if complete else (None, None, None)
                rows.append((np.full(len(i), of2[s]), np.full(len(i), WHOLE), i, np.full(len(i), n), t, np.full(len(i), e - s), x2[at], *known, x2[low], x2[high]))
            if not rows:
                continue
            joined = [np.concatenate([[None] * len(i) if r[k] is None else r[k] for r in rows]) for k in range(12)]
            keys = b.column("key").take(pa.array(joined[0], pa.int64()))
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 9]
            yield pa.record_batch([keys, *(pa.array(c, kind) for c, kind in zip(joined[1:], kinds, strict=True))], ["key", "batch", "i", "n", "target", "points", "answer", "exact_x", "n_below", "n_upto", "low", "high"])

    return answer


def quantiles(rows: DataFrame) -> DataFrame:
    """Answers for each summary of ``rows`` (key, batch, x, n): ANSWERS, with the whole of a key as batch -1.

    Keys whose batches all keep every value are answered from those; the others are searched. In the whole of a searched
    key the exact values and counts beside the answers come from counting passes over the rows, the answers from the
    batches' summaries alone.
    """
    rows = searched(written(rows, "rows"))
    few = rows.where("not _open").groupBy("key").agg(F.collect_list(F.struct("batch", "x", "n")).alias("entries"))
    complete = few.mapInArrow(answered(True), ANSWERS)

    pieces = pieces_of(rows.where("_open").select("key", "batch", "x", "n"))
    index = cut(pieces.select("key", "batch", "chunk"))
    summaries = batch_summaries(pieces, index.withColumn("owner", F.col("batch")))
    # A key's summaries are BATCHES times COMPLETE points at most.
    joined = summaries.groupBy("key").agg(F.flatten(F.collect_list("points")).alias("entries"))
    merged = cut(joined.mapInArrow(answered(False), ANSWERS))

    whole = index.withColumn("owner", F.lit(WHOLE))
    asked = merged.where(F.col("batch") == WHOLE).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "target", "low", "high", "answer"))).alias("a"))
    asked = cut(asked.select("key", F.lit(WHOLE).alias("owner"), "a"))
    states = asked.select("key", "owner", F.lit(QUANTILES).alias("by_rows"), F.col("a.target").alias("ranks"), F.col("a.low").alias("lo"), F.col("a.high").alias("hi"))
    exact = multiselect(pieces, whole, states).select("key", F.col("lo").alias("exact"))
    around = asked.select("key", "owner", "a", F.expr("array_sort(array_distinct(flatten(transform(a, r -> array(r.answer - 1, r.answer)))))").alias("probes"))
    at = around.join(counts(pieces, whole, around), ["key", "owner"]).select("key", "a", up_to().alias("up"))
    known = at.join(exact, "key").select("key", "up", F.posexplode(F.arrays_zip("a", "exact")).alias("pos", "r"))
    known = known.select("key", F.lit(WHOLE).alias("batch"), F.col("r.a.i").alias("i"), F.col("r.exact").alias("_x"), F.expr("element_at(up, r.a.answer - 1)").alias("_below"), F.expr("element_at(up, r.a.answer)").alias("_upto"))
    checked = merged.join(known, ["key", "batch", "i"], "left").withColumns({c: F.coalesce(c, k) for c, k in (("exact_x", "_x"), ("n_below", "_below"), ("n_upto", "_upto"))})
    return complete.unionByName(checked.drop("_x", "_below", "_upto"))


def report(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within: for every summary of 20 rows or more.

    Stream ``value``: one row for each click, grouped by client; stream ``price``: sale lines with the price of their item,
    by brand (an item listed twice counts twice). Rows without group, item or money, or with money that is not a finite
    number, are left out; null ids are the empty string in the batch's CRC. Ties share a value's ranks. Empty tables give
    an empty one; other columns are left alone.
    """
    found = quantiles(value_rows(clicks).unionByName(price_rows(sale_lines, items)))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    named = found.select(F.substring_index("key", ":", 1).alias("stream"), F.expr("substr(key, instr(key, ':') + 1)").alias("grp"), "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", error.alias("rank_error"))
    return named.withColumn("within", 1000 * F.col("rank_error") <= 10 * F.col("n"))


SQL = f"""
with recursive bits as (select range::bigint as k, range::bigint as c, 0 as s from range(256)
  union all select k, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, s + 1 from bits where s < 8),
tab as (select k, c from bits where s = 8),
click as materialized (select distinct on (click_id) click_id, client_id, value from clicks),
line as materialized (select vendor_id, brand, price from sale_lines join items using (item_id) where brand is not null and isfinite(price)),
ids as (select distinct click_id::varchar as id from click union select distinct vendor_id::varchar from line),
fold as (select coalesce(id, '') as id, 4294967295 as c, 0 as p from ids
  union all select id, xor(fold.c >> 8, tab.c), p + 1 from fold join tab on tab.k = xor(fold.c, ascii(substr(id, p + 1, 1))) & 255 where p < length(id)),
crc as materialized (select id, (xor(c, 4294967295) % {BATCHES})::integer as batch from fold where p = length(id)),
r as (select 'value' as stream, client_id::varchar as grp, batch, value as money from click join crc on id = coalesce(click_id::varchar, '') where client_id is not null and isfinite(value)
  union all select 'price', brand, batch, price from line join crc on id = coalesce(vendor_id::varchar, '')),
v as materialized (select stream, grp, batch, floor(100 * money + 0.5)::bigint + 1000 * batch as x, count(*) as c from r group by all),
b as materialized (select *, (le - c)::bigint as lt from (select stream, grp, batch, x, c,
    (sum(c) over w)::bigint as le, count(*) over w as dr, (sum(c) over g)::bigint as n, count(*) over g as d from v
    window w as (partition by stream, grp, batch order by x), g as (partition by stream, grp, batch))),
p as materialized (select * from b where n <= {COMPLETE} or lt = 0 or {CUTS} * le // n > {CUTS} * lt // n or {VALUES} * dr // d > {VALUES} * (dr - 1) // d),
e as (select stream, grp, batch, x, le, lt, le - lag(le, 1, 0) over w as up_lo, coalesce(lead(lt) over w, n) - lt as up_hi from p window w as (partition by stream, grp, batch order by x)),
u as (select stream, grp, x, sum(up_lo) as up_lo, sum(up_hi) as up_hi from e group by all),
m as materialized (select stream, grp, x, (sum(up_lo) over w)::bigint as lo, (coalesce(sum(up_hi) over (partition by stream, grp order by x rows between unbounded preceding and 1 preceding), 0))::bigint as hi,
    (sum(up_lo) over (partition by stream, grp))::bigint as n, count(*) over (partition by stream, grp) as points from u window w as (partition by stream, grp order by x)),
i as (select range::integer as i from range(1, {QUANTILES})),
wt as (select stream, grp, i, n, points, (i * n + {QUANTILES} - 1) // {QUANTILES} as target from (select distinct stream, grp, n, points from m) cross join i where n >= {QUANTILES}),
wa as (select wt.*, arg_min(x, (greatest(hi + 1 - target, target - lo), x)) as answer from wt join m using (stream, grp, n, points) group by all),
a as (select stream, grp, -1 as batch, i, n, target, points, answer from wa
  union all select stream, grp, batch, i, n, target, points, (select min(x) from p where p.stream = s.stream and p.grp = s.grp and p.batch = s.batch and p.le >= s.target)
    from (select stream, grp, batch, i, n, (i * n + {QUANTILES} - 1) // {QUANTILES} as target, points from (select stream, grp, batch, n, count(*) as points from p group by all) cross join i where n >= {QUANTILES}) s),
f as (select stream, grp, batch, x, le, lt from b
  union all select stream, grp, -1, x, le, le - c from (select stream, grp, x, c, (sum(c) over (partition by stream, grp order by x))::bigint as le from (select stream, grp, x, sum(c)::bigint as c from v group by all))),
o as (select a.*, (select min(x) from f where f.stream = a.stream and f.grp = a.grp and f.batch = a.batch and f.le >= a.target) as exact_x, lt::bigint as n_below, le::bigint as n_upto
  from a join f on f.stream = a.stream and f.grp = a.grp and f.batch = a.batch and f.x = a.answer)
select stream, grp, batch::integer as batch, i, n::bigint as n, target::bigint as target, exact_x::bigint as exact_x, points::bigint as points, answer::bigint as answer, n_below, n_upto,
  greatest(0, n_below + 1 - target, target - n_upto)::bigint as rank_error, 1000 * greatest(0, n_below + 1 - target, target - n_upto) <= 10 * n as within from o
"""
