"""Exact dedup by Grace hashing: partition, spill, partition again, then an open-addressing table over whole contents.

Two rounds with the same code. In the first, each task reduces its own rows to one representative for each content, so
that a group of copies that holds a third of all rows is a row for each task before anything is shuffled. In the second,
representatives meet by the hash of their content. Members then join their representative, whose id is unique.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written

#: Bytes of content that one table may hold before its bucket is spilled and partitioned again.
TABLE_BYTES = 64 << 20
FANOUT = 16
#: Depth from which a bucket is no longer split: by then all of it has one hash of 64 bits, as copies of one text have.
DEEPEST = 16


class ContentTable:
    """Open addressing with linear probing; slots hold entry numbers, and entries are compared by hash, then all bytes."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.least: list[int] = []
        self.counts: list[int] = []
        self.keys: list[list[int]] = []
        self.bytes = 0

    def put(self, h: int, content: bytes, doc_id: int, count: int, keys: list[int]) -> int:
        """Add ``count`` rows of ``content`` whose smallest id is ``doc_id``; gives the entry's number."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.counts[k] += count
                self.least[k] = min(self.least[k], doc_id)
                self.keys[k] += keys
                return k
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.least.append(doc_id)
        self.counts.append(count)
        self.keys.append(list(keys))
        self.bytes += len(content) + 250
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k

    def entries(self) -> Iterator[tuple[int, bytes, int, int, list[int]]]:
        return zip(self.hashes, self.contents, self.least, self.counts, self.keys)

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        self.slots = [-1] * size
        for k, h in enumerate(self.hashes):
            at = h & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = k


HEAD = struct.Struct("<QqqqI")


def grace(rows: Iterable[tuple[int, bytes, int, int, list[int]]], table_bytes: int = TABLE_BYTES, depth: int = 0, folder: str | None = None) -> Iterator[tuple[bytes, int, int, list[int]]]:
    """(hash, content, doc_id, count, keys) to (content, smallest doc_id, total count, all keys), one for each content.

    A table that outgrows ``table_bytes`` is written out to FANOUT files by four bits of the hash, with the rows that
    follow; each file is then worked on alone, recursively. Copies add eight bytes to a table, so a large group stays in
    memory as one entry, and different contents part at some depth. Files go when they have been read.
    """
    table = ContentTable()
    rows = iter(rows)
    for row in rows:
        table.put(*row)
        if table.bytes > table_bytes and depth < DEEPEST and len(table.contents) > 1:
            break
    else:
        for _, content, least, count, keys in table.entries():
            yield content, least, count, keys
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as own:
        names = [os.path.join(own, str(i)) for i in range(FANOUT)]
        files = [open(n, "wb") for n in names]  # noqa: SIM115
        try:
            for h, content, least, count, keys in itertools.chain(table.entries(), rows):
                # Four bits of the hash for each depth, from the top: slots go by the lowest ones.
                f = files[(h >> (60 - 4 * depth)) & (FANOUT - 1)]
                f.write(HEAD.pack(h, least, count, len(content), len(keys)))
                f.write(content)
                f.write(struct.pack(f"<{len(keys)}q", *keys))
        finally:
            for f in files:
                f.close()
        del table
        for name in names:
            yield from grace(_unspill(name), table_bytes, depth + 1, own)
            os.remove(name)


def _unspill(name: str) -> Iterator[tuple[int, bytes, int, int, list[int]]]:
    with open(name, "rb") as f:
        while head := f.read(HEAD.size):
            h, least, count, size, n = HEAD.unpack(head)
            yield h, f.read(size), least, count, list(struct.unpack(f"<{n}q", f.read(8 * n)))


def normalised(text: str | None) -> bytes:
    """Each run of white space (space, \\t to \\r) as one space; null as empty. Runs at the ends count too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = b" ".join(raw.split())
    if not out:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + out + (b" " if raw[-1:].isspace() else b"")


def _local(table_bytes: int):
    """First round: each row to the key of its content in its task; the first row of a key has the content and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table, ids, entries = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, ContentTable(), [], []

        def flush():
            first = {}
            for n, k in enumerate(entries):
                first.setdefault(k, n)
            speaks = [first[k] == n for n, k in enumerate(entries)]
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            for at in range(0, len(ids), 2000):
                now = list(zip(entries, speaks))[at : at + 2000]
                pick = lambda of: [of[k] if s else None for k, s in now]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + 2000], pa.int64()), pa.array([base + k for k, _ in now], pa.int64()), pa.array([digests[k] for k, _ in now], pa.string()),
                     pa.array(pick(table.least), pa.int64()), pa.array(pick(table.counts), pa.int64()), pa.array(pick(table.contents), pa.binary()), pa.array([x if x is None else x - (1 << 63) for x in pick(table.hashes)], pa.int64())],
                    names=["doc_id", "key", "text_sha256", "least", "n", "content", "h"],
                )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = normalised(text.as_py())
                ids.append(i)
                entries.append(table.put(xxhash.xxh3_64_intdigest(content), content, i, 1, []))
            if table.bytes > table_bytes or len(ids) > 1_000_000:
                yield from flush()
                base, table, ids, entries = base + len(table.contents), ContentTable(), [], []
        if ids:
            yield from flush()

    return run


def _merge(table_bytes: int):
    """Second round: the representatives of a bucket, each to the smallest id and the number of rows of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, least, n, content, h in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4).to_pylist()):
                    yield h + (1 << 63), content.as_py(), least, n, [key]

        found = ((key, keep, n) for _, keep, n, keys in grace(rows(), table_bytes) for key in keys)
        while part := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["key", "keep_id", "group_size"])

    return run


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. The row with
    the smallest id stays; rows that repeat its id are marked alike. Ids are whole numbers, others raise an error; a
    null id counts as the smallest long and is given back as null. Empty tables give no rows; other columns are left alone.
    """
    lowest = F.lit(-(1 << 63))
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), lowest).alias("doc_id"), whole(text).alias("text"))
    local = source.mapInArrow(_local(table_bytes), "doc_id long, key long, text_sha256 string, least long, n long, content binary, h long")
    # Written once: a second run of the first round might cut the input into other tasks and so give other keys.
    local = written(local, "exact")
    reps = local.where("content is not null").select("key", "least", "n", "content", "h")
    merged = reps.repartition("h").mapInArrow(_merge(table_bytes), "key long, keep_id long, group_size long")
    back = lambda c: F.when(F.col(c) != lowest, F.col(c)).alias(c)
    members = local.select("doc_id", "key", "text_sha256").join(merged, "key")
    return members.select(back("doc_id"), back("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
