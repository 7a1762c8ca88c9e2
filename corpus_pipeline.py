"""A corpus from raw documents to token ids: five stages, each over all that the one before it kept.

Language ID (documents whose language is not recognised go), line dedup, SimHash near-dedup (one document of each class
stays), mixing sources to target weights, byte-level BPE encoding with a decoding of the ids as a check.
"""

from __future__ import annotations

from gridloom.llm import bpe, langid, lines, mixing, simhash
from gridloom.llm.common import removed, staged, table


#: Bytes of rows that go to a Python worker together, at most, unless a row is larger: executors hold several such batches outside the heap.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Have the session's batches no larger than BATCH_BYTES; it changes no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def identify_language(spark, docs, sf_dir):
    """The documents whose language is recognised, with it as ``lang``. Null texts and those without letters go, repeated rows stay."""
    small_batches(spark)
    return langid.keep_identified(docs)


def drop_repeated_lines(spark, docs, sf_dir):
    """All documents, without the lines that too many of their source's documents have. Null texts stay null, null sources are one."""
    return lines.clean_documents(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One row of each class of near copies: the one with the smallest id. Null texts are copies of empty ones."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """A row for each use of a document in the production mix; null languages and sources are one each."""
    return mixing.mixed_documents(docs)


def encode_bytes(spark, docs, sf_dir):
    """The columns of the documents with n_tokens, ids, and whether decoding them gives the text again. Null texts have no ids."""
    small_batches(spark)
    return bpe.encode_checked(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode_bytes),
]

#: Forward passes, fingerprints and BPE are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the table documents; an empty table gives none.

    What a stage keeps is written to the shared folder and deleted when the next stage is written, so there are two copies
    at most, and in the end that which the result is read from. Columns of documents that stages do not know stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = staged(kept, name)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
