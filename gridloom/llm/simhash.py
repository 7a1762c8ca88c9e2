"""SimHash near-dedup: a byte-position inverted index with count filtering over 64-bit fingerprints.

Two fingerprints that differ in at most four bits differ in at most four of their eight bytes, so at least four bytes
match at their positions. Posting lists of single positional bytes would hold 1/256 of all documents each, and tallying
along them makes a fixed share of all pairs. So the index posts each *distinct* fingerprint under the 70 sets of four
positional bytes: exactly the pairs with a tally of four or more shared positional bytes meet in one of those lists. The
tally is then counted on the pair, and pairs that reach it are verified by their differing bits.

Lists are worked on by sorted runs and give links of a spanning forest, not pairs. A list of over ``dense`` fingerprints
is not held: it goes through the same index once more with finer parts. Its members share four bytes, and of the eight
half bytes of the others two that are near enough share four or more at their positions, so it is posted under the 70 sets
of four of those. Members of such a list share 48 bits, so there are 65,536 of them at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread_join, tidy, whole

SHINGLE = 4
SEED = 42
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
SETS = list(itertools.combinations(range(8), LEAST_BYTES))
#: Fingerprints of a list that are compared at once; longer lists go through the finer index. It changes no result.
DENSE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; no words give zero. Null counts as empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    set_in, total = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, total, 1 << 16):  # bounds the unpacked bits of a very long text
        upto = min(total, at + (1 << 16))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), (ends[at + size - 1 : upto + size - 1] - 1).tolist())], dtype="<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and ``keys``, which are longs): the fingerprint of every row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *keys])
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"), *keys).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keys)))


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under each set of positional bytes: the set's number above the four bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int64)
            each = fps.view(np.uint8).reshape(-1, 8).astype(np.int64)
            keys = np.stack([sum((each[:, p] << (8 * i) for i, p in enumerate(chosen)), np.int64(n) << 32) for n, chosen in enumerate(SETS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, len(SETS)))], names=["key", "fp"])


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints of one list that are near enough."""
    each = fps.view(np.uint8).reshape(-1, 8)
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(1, len(fps)):
        tally = (each[:i] == each[i]).sum(axis=1)
        near = (tally >= LEAST_BYTES) & (np.bitwise_count(fps[:i] ^ fps[i]) <= MOST_BITS)
        for j in np.flatnonzero(near).tolist():
            if (a := find(i)) != (b := find(j)):
                root[a] = b
                out.append((int(fps[i]), int(fps[j])))
    return out


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint of a long list under each set of four half bytes of those that the list does not share; lists stay apart."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            keys, fps = (batch.column(i).slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            each = fps.view(np.uint8).reshape(-1, 8)
            rest = np.array([[p for p in range(8) if p not in s] for s in SETS])[keys >> 32]
            free = np.take_along_axis(each, rest, axis=1).astype(np.int64)
            halves = np.concatenate((free & 15, free >> 4), axis=1)
            posts = np.stack([(keys << 23) | (n << 16) | sum((halves[:, p] << (4 * i) for i, p in enumerate(chosen)), np.int64(0)) for n, chosen in enumerate(SETS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(posts.ravel()), pa.array(np.repeat(fps, len(SETS)))], names=["key", "fp"])


def _lists(dense: int):
    """Sorted posts to rows (key, a, b): links, or for a list of over ``dense`` the fingerprint a and no b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, flows = None, np.zeros(0, np.int64), False

        def close():
            return [(held_key, a, b) for a, b in _forest(held)] if not flows and len(held) > 1 else []

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            out = []
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != held_key:
                    out += close()
                    held_key, held, flows = int(keys[a]), fps[a:b], False
                else:
                    held = np.concatenate((held, fps[a:b]))
                if len(held) > dense or flows:
                    out += [(held_key, x, None) for x in held.tolist()]
                    held, flows = np.zeros(0, np.int64), True
            if out:
                yield _links(out)
        if held_key is not None and (out := close()):
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["key", "a", "b"])


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links that connect exactly what pairs of fingerprints with at most four differing bits connect."""

    def worked(posts: DataFrame, held: int) -> DataFrame:
        return cut(posts.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_lists(held), "key long, a long, b long"))

    found = worked(distinct.select("fp").mapInArrow(_posts, "key long, fp long"), dense)
    near = found.where("b is not null").select("a", "b")
    long = found.where("b is null").select("key", F.col("a").alias("fp"))
    if long.isEmpty():
        return near
    return near.unionAll(worked(long.mapInArrow(_finer, "key long, fp long"), 1 << 16).select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id.

    ``component_id`` is the smallest doc_id that can be reached over links of fingerprints which differ in at most four
    bits. Equal fingerprints are one class before anything is compared. Texts without words, null ones too, have the
    fingerprint zero and are linked like any other. Null ids reach nothing smaller and keep the class's id, or null in a
    class of null ids only. Ids are whole numbers, others raise an error. Repeated rows stay; other columns are left alone; empty tables give no rows.
    """
    fps = cut(fingerprints(docs, text, doc_id))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes, dense)).select(F.col("node").alias("fp"), "root")
    labelled = cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = spread_join(labelled, lowest, "root", "members").select("fp", "component_id", "copies")
    return spread_join(fps, named, "fp", "copies").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` of each near-duplicate class: the one with the smallest id, a row without id only if none has one.

    Of several rows with that id the one with the smallest digest of all its columns stays, and of rows alike in all
    columns (but maps, which are not compared) any one. Columns are unchanged.
    """
    compared = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(n), *[x for c in compared for x in (c.isNull(), c)]) for n, k in enumerate(("_row_a", "_row_b"))})
    rows = cut(fingerprints(keyed, text, doc_id, ("_row_a", "_row_b")))
    # Rows that are alike become one with their number; the first of a fingerprint, then of a class, is a minimum.
    alike = cut(rows.groupBy("fp", "doc_id", "_row_a", "_row_b").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row_a", "_row_b", "n")).alias("first")
    classes = cut(alike.groupBy("fp").agg(first))
    roots = components(links(classes)).select(F.col("node").alias("fp"), "root")
    best = cut(classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.*"))
    dropped = alike.join(best.select("_row_a", "_row_b"), ["_row_a", "_row_b"], "left_anti").select("_row_a", "_row_b")
    kept = keyed.join(dropped, ["_row_a", "_row_b"], "left_anti")
    again = cut(best.where("n > 1").select("_row_a", "_row_b"))
    if not again.isEmpty():
        repeated = kept.join(again, ["_row_a", "_row_b"], "left_semi").dropDuplicates(["_row_a", "_row_b"])
        kept = kept.join(again, ["_row_a", "_row_b"], "left_anti").unionByName(repeated)
    return kept.select(*[f"`{c}`" for c in docs.columns])
