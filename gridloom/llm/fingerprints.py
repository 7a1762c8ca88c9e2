"""Document fingerprints: a wide digest of the canonical text, with byte comparison inside equal buckets.

The canonical text is NFKC, case folded, NFKC again, with each run of white space as one space and none at the ends. Its
digest is two XXH64 values with different seeds. Rows of equal digest are grouped by digest and canonical bytes; should
two different texts share a digest, that digest is lengthened by their SHA-512, so equal fingerprints mean equal canonical
texts. Everything here is DataFrame expressions: Unicode forms come from ICU, which Spark itself ships, by ``java_method``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions, whole

#: Bits of the filter that keeps rows of single buckets out of the byte comparison: 1 MB at most, however many rows.
FILTER_BITS = 1 << 23
WORD = 32768


def canonical(text: Column) -> Column:
    """Canonical form of a text; null gives null."""
    java = lambda cls, method, c: F.call_function("java_method", F.lit(cls), F.lit(method), c, F.lit(True))
    nfkc = lambda c: java("com.ibm.icu.text.Normalizer", "compose", c)
    folded = nfkc(java("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """32 lowercase hex digits: two lanes of XXH64, seeded by the hashes of 1 and 2."""
    lane = lambda k: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(k), canon))), 16, "0")
    return F.concat(lane(1), lane(2))


def collided(docs: DataFrame, text: Column, digests: DataFrame | None = None) -> DataFrame:
    """Digests that two different canonical texts share, one row each (as good as always none).

    Only rows whose digest may occur twice go into the comparison: a bitmap of fixed size names those digests. Copies are
    brought together before the shuffle, so that a very large group of copies is one row for each task. ``digests``: the
    column ``digest`` of all rows, where it was worked out before.
    """
    canon = docs.select(canonical(text).alias("canon")).withColumn("digest", digest(F.col("canon")))
    slot = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("slot")
    twice = (canon if digests is None else digests).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(slot)
    bitmap = twice.groupBy(F.expr(f"slot div {WORD}").alias("word")).agg(F.bitmap_construct_agg(F.expr(f"slot % {WORD}")).alias("bits"))
    marked = canon.withColumn("slot", slot).withColumn("word", F.expr(f"slot div {WORD}"))
    byte = F.expr(f"cast(conv(hex(substring(bits, cast((slot % {WORD}) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("getbit", byte, F.expr("cast(slot % 8 as int)")) == 1
    # 256 words of 4 KB at most: the bound of this broadcast.
    several = marked.join(F.broadcast(bitmap), "word").where(hit)
    distinct = several.groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    return distinct.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out`` (replaced if there).

    Null text counts as empty; empty and blank texts share one fingerprint. Equal texts have equal fingerprints, and so
    have texts that differ in Unicode form, case or white space only. Repeated rows stay. Empty tables give empty ones.
    """
    canon = canonical(whole(text))
    bad = cut(collided(docs, whole(text))).select(F.col("digest").alias("_bad"))
    marked = docs.withColumn(out, digest(canon))
    return marked.join(bad, F.col(out) == F.col("_bad"), "left").withColumn(out, resolved(F.col(out), F.col("_bad"), canon)).drop("_bad")


def resolved(short: Column, bad: Column, canon: Column) -> Column:
    return F.when(bad.isNull(), short).otherwise(F.concat(short, F.lit("-"), F.sha2(canon, 512)))


def with_next(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: the value in the next row by descending ``order``, after the last the first.

    Rows are dealt to ranges of ``order``; each range also gets a copy of the first row of the range after it, so no
    window crosses a range and no task sees more than one. Ties come in the order of the carried columns' hash; rows
    without an id come last, in that order too, and have ranges of it.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []), reverse=True)
    hops = max(1, len(cuts)).bit_length() + 1
    # Binary search: how many cuts lie at or above the id, so that larger ids have smaller range numbers.
    array = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bounds = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(array, mid(s)) >= F.col(order), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    # Hashes are spread evenly over all 64-bit numbers.
    hashed = F.least(F.lit(ranges - 1), F.floor((F.col("_tie").cast("double") / float(1 << 64) + 0.5) * ranges).cast("int"))
    number = F.when(F.col(order).isNull(), F.lit(len(cuts) + 1) + hashed).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(hops)), bounds, step, lambda s: s["lo"]))
    numbered = docs.withColumn("_tie", F.xxhash64(*carried)).withColumn("_range", number)
    # One row for each range, of which there are at most 8 for each shuffle partition.
    found = numbered.groupBy("_range").agg(F.max(order).alias("top"), F.min("_tie").alias("tie")).collect()
    heads = {r["_range"]: r["tie"] if r["top"] is None else r["top"] for r in found}
    there = sorted(heads)
    if not there:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    before = {r: there[i - 1] for i, r in enumerate(there)}
    goes = F.create_map(*[F.lit(x) for r in there for x in (r, before[r])])
    # The first row of a range by its id, in ranges of rows without one by its hash.
    tops = F.create_map(*[x for r in there for x in (F.lit(r), F.lit(heads[r]).cast("long"))])
    guest = F.coalesce(F.col(order).cast("long"), F.col("_tie")) == F.element_at(tops, F.col("_range"))
    seats = F.when(guest, F.array(F.struct(F.col("_range").alias("seat"), F.lit(False).alias("guest")), F.struct(F.element_at(goes, F.col("_range")).alias("seat"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("_range").alias("seat"), F.lit(False).alias("guest")))
    )
    seated = numbered.withColumn("_s", F.explode(seats)).select("*", "_s.seat", "_s.guest").drop("_s", "_range")
    along = Window.partitionBy("seat").orderBy("guest", F.col(order).desc_nulls_last(), "_tie")
    led = seated.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in carried])
    return led.where("not guest").drop("seat", "guest", "_tie")


def edit_pairs(docs: DataFrame) -> DataFrame:
    """For each document the fingerprints of its text and of its edited text, and whether they and the next one's agree.

    Edited: the last third of the code points (rounded down) replaced by as many from the start of the next document by
    descending doc_id. A likeness is 1.0 for equal fingerprints and else 0.0, as the digest is an exact one.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as
    empty; rows without an id come after all others, repeated rows next to each other; other columns are left alone.

    Equal digests of documents are compared byte by byte; those of edited texts, which are nowhere stored, with all others
    of that digest by their SHA-512.
    """
    base = docs.select(F.col("doc_id"), whole().alias("text")).withColumn("canon", canonical(F.col("text")))
    base = base.select("doc_id", "text", digest(F.col("canon")).alias("digest"), F.sha2("canon", 512).alias("sha"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    pairs = with_next(base, "doc_id", ["text", "digest", "sha"]).withColumn("edited", edited).withColumn("canon", canonical(F.col("edited")))
    own = ["digest", "sha", "next_digest", "next_sha"]
    pairs = cut(pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *own, digest(F.col("canon")).alias("edited_digest"), F.sha2("canon", 512).alias("edited_sha")))
    both = pairs.select("digest", "sha").unionAll(pairs.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))
    # First by digest and SHA-512, with partial sums: a group of copies is a row for each task.
    parted = both.groupBy("digest", "sha").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    bad = cut(collided(docs, whole(), pairs.select("digest")).unionAll(parted).distinct())
    if bad.isEmpty():
        mark = lambda c: F.col(f"{c}digest")
    else:
        for c in ("", "next_", "edited_"):
            pairs = pairs.join(bad.select(F.col("digest").alias(f"{c}bad")), F.col(f"{c}digest") == F.col(f"{c}bad"), "left")
        mark = lambda c: F.when(F.col(f"{c}bad").isNull(), F.col(f"{c}digest")).otherwise(F.concat(f"{c}digest", F.lit("-"), f"{c}sha"))
    same = lambda a, b: (a == b).cast("double")
    return pairs.select("doc_id", "n_chars", "edited_sha256", mark("").alias("fingerprint"), mark("edited_").alias("edited_fingerprint"), same(mark(""), mark("edited_")).alias("near_edited"), same(mark(""), mark("next_")).alias("near_next"))
