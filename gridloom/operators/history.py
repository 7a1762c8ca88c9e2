"""Job history: a table of runs with dashboard queries and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import masked_preview

COLUMNS = "id bigint, feature string, inputHash string, inputLabel string, outputPreview string, outputPath string, qualityScore int, status string, retryCount int, durationMs bigint, timestamp bigint"


def totals(runs: DataFrame) -> DataFrame:
    """All dashboard figures in one pass; rates and means of nothing are 0 and null."""
    n, good = F.count("*"), F.count_if(F.col("status") == "SUCCESS")
    return runs.agg(n.alias("total"), good.alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.avg("qualityScore").alias("mean_quality"), F.when(n > 0, good / n * 100).otherwise(0.0).alias("success_rate"))


def by_feature(runs: DataFrame) -> DataFrame:
    return runs.groupBy("feature").agg(F.count("*").alias("runs"))


def top_feature(runs: DataFrame) -> DataFrame:
    """The feature with the most runs, of equals the first by name."""
    return by_feature(runs).orderBy(F.desc("runs"), "feature").limit(1)


def mean_duration(runs: DataFrame, feature: str) -> DataFrame:
    return runs.where(F.col("feature") == feature).agg(F.avg("durationMs").alias("mean_ms"))


def recent(runs: DataFrame, n: int = 100, feature: str | None = None) -> DataFrame:
    return (runs if feature is None else runs.where(F.col("feature") == feature)).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def batch_log(runs: DataFrame, n: int = 20, prefix: str = "BATCH_") -> DataFrame:
    """Of the newest ``n`` runs those of batch features."""
    return recent(runs, n).where(F.col("feature").startswith(prefix))


def cached(runs: DataFrame, feature: str, input_hash: str) -> DataFrame:
    """The newest successful run of a feature on an input."""
    return recent(runs.where((F.col("inputHash") == input_hash) & (F.col("status") == "SUCCESS")), 1, feature)


def newest(runs: DataFrame, keep: int) -> DataFrame:
    return runs.join(recent(runs, keep).select("id"), "id", "left_semi")


def since(runs: DataFrame, cutoff: int) -> DataFrame:
    return runs.where(F.col("timestamp") >= cutoff)


def retained(runs: DataFrame, now_ms: int, keep: int = 2000, days: int = 90) -> DataFrame:
    return since(newest(runs, keep), now_ms - days * 86_400_000)


def updated(rows: DataFrame, key: str, value, **changes) -> DataFrame:
    """Rows with some columns set where ``key`` is ``value``."""
    return rows.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def run_quality(ok: int, steps: int) -> int:
    return ok * 100 // steps if steps else 0


def recorded(runs: DataFrame) -> DataFrame:
    """Rows as the history keeps them: previews cut and masked, scores from 0 to 100."""
    return runs.withColumns({"outputPreview": masked_preview("outputPreview"), "qualityScore": F.greatest(F.lit(0), F.least(F.lit(100), F.col("qualityScore")))})


def inserted(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with ``more`` added; columns by name, those that ``more`` lacks are null."""
    return rows.unionByName(more, allowMissingColumns=True)


def deleted(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def emptied(rows: DataFrame) -> DataFrame:
    return rows.where(F.lit(False))


#: Saved workflows that are listed, that there may be, and the length of their names.
MOST_LISTED, MOST_SAVED, LONGEST_NAME = 500, 200, 80


def listed(saved: DataFrame, n: int = MOST_LISTED) -> DataFrame:
    """Saved workflows, the newest first."""
    return saved.orderBy(F.desc("createdAt"), F.desc("id")).limit(n)


def counted(saved: DataFrame) -> DataFrame:
    return saved.agg(F.count("*").alias("n"))


def by_id(saved: DataFrame, value) -> DataFrame:
    return saved.where(F.col("id") == value).limit(1)


def saved(rows: DataFrame, name: str, steps_json: str, step_count: int, now_ms: int) -> DataFrame:
    """``rows`` (id, name, stepsJson, stepCount, createdAt, lastRunAt) with one more workflow; raises when there are MOST_SAVED."""
    if rows.count() >= MOST_SAVED:
        raise ValueError("too many saved workflows: delete one first")
    new_id = (rows.agg(F.max("id")).first()[0] or 0) + 1
    title = (name.strip() or "Untitled workflow")[:LONGEST_NAME]
    return inserted(rows, rows.sparkSession.createDataFrame([(new_id, title, steps_json, step_count, now_ms)], "id long, name string, stepsJson string, stepCount int, createdAt long"))
