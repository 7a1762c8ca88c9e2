"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 of the bytes, rank). A byte-level BPE maps each byte to a printable character,
so a piece is a string of such characters and a token is one too; the byte table is applied to pieces before the library
merges them, and decoding joins tokens and applies the reverse of the table. Each match of the split pattern is encoded on its own. All ways to split a token into two tokens are merges, in
the order of ranks, and a piece that is itself a token is taken whole: this gives the ids that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, tidy, whole

#: Distinct pieces that a worker remembers; beyond it the memory is emptied. It changes nothing but speed.
REMEMBERED = 100_000
#: Texts at a time, in characters: bounds what a worker holds at once (one text is never cut).
CHUNK_CHARS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_table() -> list[str]:
    """Byte to character: printable Latin-1 bytes are themselves, the others are given 256 and on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def build(ranks: dict[bytes, int]) -> str:
    """The tokenizer for single pieces, as JSON."""
    from tokenizers import Tokenizer, models

    table = byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)).to_str()


class Codec:
    """Encodes and decodes texts in a worker; built once there from what the driver broadcasts.

    ``tokens`` are the tokens' bytes by id, None for ids that are not used. Those, and ids beyond them, decode to the
    replacement character.
    """

    def __init__(self, tokenizer: str, tokens: list[bytes | None], pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer).model
        # White space as Unicode defines it, as the library of the ranks reads \s.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.table = byte_table()
        self.reverse = np.zeros(512, np.uint8)
        self.reverse[[ord(c) for c in self.table]] = np.arange(256)
        self.shown = [self.as_characters("\ufffd".encode() if t is None else t) for t in [*tokens, None]]
        self.known: dict[str, bytes] = {}

    def as_characters(self, data: bytes) -> str:
        return "".join(map(self.table.__getitem__, data))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Pieces are remembered as packed ids, which takes a sixth of the room of lists."""
        known, merge = self.known, self.model.tokenize
        split = [self.pieces(t) for t in texts]
        for p in {p for pieces in split for p in pieces if p not in known}:
            known[p] = array("i", [t.id for t in merge(self.as_characters(p.encode()))]).tobytes()
        out = [np.frombuffer(b"".join([known[p] for p in pieces]), np.int32) for pieces in split]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens: joined before any character is read, so a character split between tokens is whole."""
        last, shown = len(self.shown) - 1, self.shown
        text = "".join([shown[i] for i in np.where((ids < 0) | (ids > last), last, ids).tolist()])
        return self.reverse[np.frombuffer(text.encode("utf-16-le"), np.uint16)].tobytes()

    def offsets(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of each token in characters; a token that ends inside a character covers all of it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        begins = (data & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(begins)))
        ends = np.cumsum([len(self.shown[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        inside = ~begins[np.minimum(starts, max(0, len(data) - 1))] if len(data) else np.zeros(0, bool)
        return list(zip(np.maximum(chars[starts] - inside, 0).tolist(), chars[ends].tolist())) if len(ids) else []


def _shared(spark: SparkSession, vocabulary: str | None, pattern: str | None):
    """The vocabulary's file is read by the driver alone; its size (a few MB, some 100,000 rows) bounds the broadcast."""
    ranks = read_ranks(vocabulary or default_vocabulary())
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return spark.sparkContext.broadcast((build(ranks), tokens, pattern or default_pattern()))


def _chunks(texts: pa.Array) -> Iterator[slice]:
    start = size = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if size and size + n > CHUNK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _run(df: DataFrame, vocabulary, pattern, extra: dict[str, pa.DataType], row) -> DataFrame:
    """Add columns made by ``row(codec, ids, text)`` for each text in the last column, which is not given back."""
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    shared = _shared(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(shared, lambda made: Codec(*made))
        for batch in batches:
            for part in _chunks(batch.column(batch.num_columns - 1)):
                *kept, texts = (c.slice(part.start, part.stop - part.start) for c in batch.columns)
                texts = texts.to_pylist()
                made = list(zip(*(row(codec, i, t) for i, t in zip(codec.encode(texts), texts))))
                yield pa.RecordBatch.from_arrays(kept + [pa.array(v, k) for v, k in zip(made, extra.values())], names=[*batch.schema.names[:-1], *extra])
        tidy()

    schema = StructType([*df.schema.fields[:-1], *(StructField(n, from_arrow_type(t)) for n, t in extra.items())])
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array of int), and with ``offsets`` also ``starts`` and ``ends``.

    Null text counts as empty and has no ids. Columns of those names in ``docs`` are replaced; the others, rows and
    repeated rows stay as they are. No special tokens: their strings are ordinary text. Empty tables give empty ones.
    """
    extra = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())} | ({"starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())} if offsets else {})

    def row(codec, ids, text):
        if not offsets:
            return len(ids), ids
        spans = codec.offsets(ids)
        return len(ids), ids, [a for a, _ in spans], [b for _, b in spans]

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra], whole(text).alias("_text"))
    return _run(kept, vocabulary, pattern, extra, row)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with the decoded text.

    Bytes that are not UTF-8, ids without a token and nulls among the ids become replacement characters. Null ids give
    null. Columns named ``out`` are replaced; other columns, rows and repeated rows stay as they are.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    shared = _shared(encoded.sparkSession, vocabulary, None)
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != out], F.col(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(shared, lambda made: Codec(*made))
        for batch in batches:
            last = batch.num_columns - 1
            each = (i.values for i in batch.column(last))
            texts = [None if i is None else codec.decode(pc.fill_null(i, -1).to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for i in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string())], names=[*batch.schema.names[:last], out])
        tidy()

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField(out, StringType())]))


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def row(codec, ids, text):
        return len(ids), hashlib.sha256(str(ids.tolist())[1:-1].replace(" ", "").encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    extra = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs.select("doc_id", whole().alias("_text")), vocabulary, pattern, extra, row)


def encode_checked(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``docs``, n_tokens, ids, and ``round_trip``: whether the decoded ids are the text's bytes."""

    def row(codec, ids, text):
        return len(ids), ids, codec.decode(ids) == text.encode("utf-8", "surrogatepass")

    extra = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "round_trip": pa.bool_()}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in extra], whole().alias("_text"))
    return _run(kept, vocabulary, pattern, extra, row)
