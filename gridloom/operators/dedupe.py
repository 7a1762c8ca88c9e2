"""Duplicate rows: exact, normalised and similar ones; the first by ordinal stays."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import ws_trim
from .lineage import cut


def keep_first(df: DataFrame, keys: list[str], rid: str, normalised: bool = False) -> DataFrame:
    """Of rows with equal keys the one with the smallest ordinal.

    The smallest ordinal of each key is an aggregate with partial sums, so a key that many rows share is a row for each
    task before the shuffle; rows are then taken by ordinal.
    """
    key = F.struct(*[(F.lower(ws_trim(F.coalesce(F.col(k), F.lit("")))) if normalised else F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)])
    first = df.groupBy(F.xxhash64(key), key).agg(F.min(rid).alias(rid)).select(rid)
    return df.join(first, rid, "left_semi")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` joined by sorting and merging: Spark takes a table that was exploded for as small as before, and would send it whole to everyone."""
    return df.hint("merge")


#: Parts of a key beyond those that edits can touch, so that its most frequent parts need not be looked up.
SPARE = 2


def _floor(c: Column) -> Column:
    return F.floor(c + 1e-9).cast("int")


def _edits(longer: Column, threshold: float) -> Column:
    """Edits that two similar keys may be apart, by the length of the longer one."""
    return _floor((1.0 - threshold) * longer)


def _class(m: Column, threshold: float) -> Column:
    """Number of a key's length among classes of lengths, two of which are as wide as what the threshold lets lengths differ."""
    return F.floor(2 * F.log(m.cast("double")) / -math.log(threshold)).cast("int") if threshold < 1 else m


def _parts(c: Column, threshold: float) -> tuple[Column, Column, Column]:
    """(number, spare ones, size) of the parts of keys of a class: enough for the class's longest, small enough for its shortest."""
    bound = lambda k: F.exp(k * (-math.log(threshold) / 2)) if threshold < 1 else k
    low, high = F.ceil(bound(c)) - 1, F.floor(bound(c + 1)) + 1
    touched = _edits(_floor(high / threshold), threshold) + 1
    spare = F.when(low >= 4 * (touched + SPARE), SPARE).otherwise(0)
    return (touched + spare).cast("int"), spare, F.greatest(F.lit(1), F.floor(low / (touched + spare))).cast("int")


def _posts(some: DataFrame, threshold: float) -> DataFrame:
    """(rid, n, d, i, h): each key's parts as the shorter of two similar ones, by the hash of class, number and letters."""
    count, _, size = _parts(F.col("c"), threshold)
    cut_up = some.withColumn("c", _class(F.col("n"), threshold)).withColumns({"size": size, "i": F.explode(F.sequence(F.lit(0), F.least(count, F.col("n")) - 1))})
    h = F.xxhash64("c", "i", F.substring("key", F.col("i") * F.col("size") + 1, F.col("size")))
    return cut_up.select("rid", "n", _edits(_floor(F.col("n") / threshold), threshold).alias("d"), "i", h.alias("h"))


def _offers(some: DataFrame, threshold: float) -> DataFrame:
    """(other, other_n, h): where a part of a shorter similar key can stand in each key, by the same hash, once each.

    Part i is looked for up to i places from where it stands in the shorter key, and so that what follows it is at most
    as far apart as the edits that are left, for the lengths of one class at once: in all about half the square of the
    edits for each of three classes.
    """
    lengths = F.sequence(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), F.col("n"))
    classes = some.withColumn("lengths", lengths).withColumn("c", F.explode(F.array_distinct(F.transform("lengths", lambda m: _class(m, threshold)))))
    own = F.filter("lengths", lambda m: _class(m, threshold) == F.col("c"))
    count, spare, size = _parts(F.col("c"), threshold)
    classes = classes.withColumn("own", own).withColumns({"count": count, "spare": spare, "size": size, "d": _edits(F.col("n"), threshold), "least": F.col("n") - F.array_max("own"), "most": F.col("n") - F.array_min("own")})
    each = classes.withColumn("i", F.explode(F.expr("sequence(0, least(count, n) - 1)")))
    each = each.withColumns({"low": F.expr("greatest(-i, least - (d - i + spare), -i * size)"), "high": F.expr("least(i, most + d - i + spare, n - (i + 1) * size)")}).where("low <= high")
    places = F.transform(F.sequence("low", "high"), lambda s: F.xxhash64("c", "i", F.substring("key", F.col("i") * F.col("size") + s + 1, F.col("size"))))
    return each.select(F.col("rid").alias("other"), F.col("n").alias("other_n"), F.explode(F.array_distinct(places)).alias("h"))


def _pairs(keyed: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: ordinals of rows whose keys are similar.

    A key that is at most d edits from a longer one is cut into parts, of which any d + 1 are taken, here the rarest. Take
    the first of them, in order, before whose end there are no more edits than parts before it: it is untouched, has as
    many edits before it as parts, and all others behind it. So the longer key holds it near its own place: ``_offers``
    lists the places. Postings have ordinals, lengths and hashes; keys are joined to the pairs that met, and compared.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("the threshold must lie above 0.5, so that a key has more letters than edits")
    some = keyed.where("key <> ''").select("rid", "key", F.length("key").alias("n"))
    offers = cut(_offers(some, threshold))
    often = offers.groupBy("h").agg(F.count("*").alias("often"))
    # A key has as many rows as parts here.
    rarest = Window.partitionBy("rid").orderBy("often", "i")
    wanted = _posts(some, threshold).join(shuffled(often), "h").withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= F.col("d") + 1)
    apart = F.col("other_n") - F.col("n")
    met = wanted.select("rid", "n", "h").join(shuffled(offers), "h").where((apart <= _edits(F.col("other_n"), threshold)) & ((apart > 0) | ((apart == 0) & (F.col("rid") < F.col("other")))))
    met = met.select("rid", "other").distinct()
    met = met.join(shuffled(some.select("rid", "key")), "rid").join(shuffled(some.select(F.col("rid").alias("other"), F.col("key").alias("other_key"), F.col("n").alias("other_n"))), "other")
    # Beyond the edits allowed a pair is too far apart: the distance is then -1 and was not worked out to its end.
    met = met.withColumn("d", _edits(F.col("other_n"), threshold)).withColumn("edits", F.expr("levenshtein(key, other_key, d)"))
    near = met.where((F.col("edits") >= 0) & (1.0 - F.col("edits") / F.col("other_n") >= threshold))
    return near.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b"))


def drop_similar(df: DataFrame, keys: list[str], rid: str, threshold: float = 0.92) -> DataFrame:
    """Drop a row if its key is similar to the key of an earlier row that stays.

    Rows are decided in rounds: one stays when all its earlier neighbours are dropped, one goes when an earlier
    neighbour stays; the earliest open row can always be decided, so rounds go on until no pair is open, however long a
    chain is. Equal keys are brought together first.
    """
    key = reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.lower(ws_trim(F.coalesce(F.col(k), F.lit("")))) for k in keys])
    keyed = df.select(F.col(rid).alias("rid"), key.alias("key"))
    distinct = cut(keyed.groupBy("key").agg(F.min("rid").alias("rid")).select("rid", "key"))
    pairs = cut(_pairs(distinct, threshold))
    dropped, rounds = None, 0
    open_ = pairs
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("r")).distinct()
        stays = open_.select(F.col("a").alias("r")).distinct().join(shuffled(waiting), "r", "left_anti")
        goes = cut(open_.join(shuffled(stays), F.col("a") == F.col("r"), "left_semi").select(F.col("b").alias("r")).distinct())
        rounds += 1
        dropped = goes if dropped is None else dropped.unionAll(goes)
        if rounds % 50 == 0:  # else the plan grows with the rounds
            dropped = cut(dropped)
        gone = goes.unionAll(stays)
        open_ = cut(open_.join(shuffled(gone.select(F.col("r").alias("a"))), "a", "left_anti").join(shuffled(goes.select(F.col("r").alias("b"))), "b", "left_anti").select("a", "b"))
    firsts = distinct if dropped is None else distinct.join(shuffled(dropped), F.col("rid") == F.col("r"), "left_anti")
    return df.join(shuffled(firsts.select(F.col("rid").alias(rid))), rid, "left_semi")
