"""Batches of files as a stream: each new file is worked on once, with retries, and recorded in the job history."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cells import content_key, masked_preview, text_quality
from ..operators.history_table import HistoryTable

ATTEMPTS, FIRST_MS, LONGEST_MS = 3, 500, 8000


def backoff_ms(attempt: int, first: int = FIRST_MS, longest: int = LONGEST_MS) -> int:
    return min(longest, first * 2**attempt)


def retry_pause(attempt: Column, first: int = FIRST_MS, longest: int = LONGEST_MS) -> Column:
    """``backoff_ms`` as an expression."""
    return F.least(F.lit(float(longest)), float(first) * F.pow(F.lit(2.0), attempt.cast("double")))


def may_pass(error: Exception) -> bool:
    """Whether trying again may help: not for what is wrong in itself (values, names that are not known), nor for answers below 500 but 429."""
    status = getattr(error, "code", None) or getattr(error, "status", None)
    if isinstance(status, int):
        return status >= 500 or status == 429
    return not isinstance(error, (ValueError, TypeError, socket.gaierror, FileNotFoundError))


def with_retry(work: Callable, attempts: int = ATTEMPTS, retryable: Callable[[Exception], bool] = may_pass, sleep=time.sleep):
    """What ``work`` gives, tried again after growing pauses while its errors may pass."""
    for attempt in range(attempts):
        try:
            return work()
        except Exception as e:
            if attempt + 1 == attempts or not retryable(e):
                raise
            sleep(backoff_ms(attempt) / 1000)


def scored(texts: DataFrame, feature: str = "BATCH_TEXT") -> DataFrame:
    """(path, text) as history rows; a text that is blank counts as failed."""
    quality = text_quality("text")
    more = [F.col("retryCount")] if "retryCount" in texts.columns else []
    return texts.select(*more, F.lit(feature).alias("feature"), content_key("text").alias("inputHash"), F.col("path").alias("inputLabel"), masked_preview("text").alias("outputPreview"), quality.alias("qualityScore"), F.when(quality > 0, "SUCCESS").otherwise("FAILED").alias("status"))


RETRIED = "path string, text string, retryCount int, error string"


def retried(found: DataFrame, work: Callable[[bytes], str], attempts: int = ATTEMPTS, first_ms: int = FIRST_MS, longest_ms: int = LONGEST_MS, retryable: Callable[[Exception], bool] = may_pass) -> DataFrame:
    """(path, text, retryCount, error) of each file of a stream (path, content) that is done with: ``work`` gave its text, or it failed for good.

    A file whose error may pass is kept as state with its attempt and its due time, and is tried again in a later batch,
    when its timer is up, while other files go on; after ``attempts`` it is given up, with a blank text and the error.
    No task waits. State and timers outlive the query: a restart goes on with what was pending. Null contents count as empty.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, attempt = state.get if state.exists else (None, 0)
        for batch in rows:  # empty when a timer is up; a file that comes again while it is pending starts anew
            if len(batch):
                content, attempt = bytes(batch["content"].iloc[-1] or b""), 0
        try:
            done = (work(bytes(content)), None)
        except Exception as e:
            if attempt + 1 < attempts and retryable(e):
                state.update((content, attempt + 1))
                state.setTimeoutDuration(backoff_ms(attempt, first_ms, longest_ms))
                return
            done = ("", f"{type(e).__name__}: {e}")
        state.remove()
        yield pd.DataFrame({"path": [key[0]], "text": [done[0]], "retryCount": [attempt], "error": [done[1]]})

    return found.select("path", "content").groupBy("path").applyInPandasWithState(step, RETRIED, "content binary, attempt int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_retried(found: DataFrame, work: Callable[[bytes], str], table: HistoryTable, checkpoint: str, feature: str = "BATCH_TEXT", every: str = "1 second", **more) -> StreamingQuery:
    """``retried`` as history rows, inserted into a history by days; a batch that is run again changes nothing.

    A row's id is the hash of path and batch feature; its time is that of the batch.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        rows = scored(batch, feature).withColumns({"id": F.xxhash64("feature", "inputLabel"), "timestamp": F.unix_millis(F.current_timestamp())})
        table.insert_batch(rows, batch_id)

    return retried(found, work, **more).writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def pdf_texts(found: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) in PDF, each read again after a pause while its errors may pass; what cannot be read is blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources import pdf

        def text(data: bytes) -> str:
            try:
                return with_retry(lambda: "\n".join(pdf.page_texts(data)))
            except Exception:  # one file never fails the batch
                return ""

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [text(bytes(c)) for c in batch["content"]]})

    return found.select("path", "content").mapInPandas(run, "path string, text string")


def run_pdfs(spark: SparkSession, folder: str, history: str, checkpoint: str) -> StreamingQuery:
    """Work on the PDF files of ``folder`` that were not worked on before and append them to ``history`` (Parquet)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(folder)
    return scored(pdf_texts(found), "BATCH_PDF_TEXT").writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def run_files(spark: SparkSession, folder: str, history: str, checkpoint: str) -> StreamingQuery:
    """Work on the text files of ``folder`` that were not worked on before and append them to ``history`` (Parquet)."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return scored(files).writeStream.format("parquet").option("path", history).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by type in windows of time, for streams with a watermark as for tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
