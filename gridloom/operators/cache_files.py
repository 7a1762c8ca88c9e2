"""Cached results that are found by reading a few pages: files clustered by input hash, with Bloom filters and page statistics.

Rows are dealt to files by ranges of the hash and sorted in them, so a hash lies between the bounds of one file, and in that
file of a page or two; hashes that are in no file are told by the row groups' Bloom filters without reading a page, but for the
filters' rate of error. Spark's own Parquet reader does the pruning; ``rows_scanned`` shows what it came to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history

#: Rows of a page and bytes of a row group, at most; the share of absent hashes for which a row group is read in vain.
PAGE_ROWS, GROUP_BYTES, FALSE_READS = 2_000, 16 << 20, 0.01


def write(runs: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write the successful runs that have a hash, clustered by it; ``files``: how many files, the shuffle's partitions if not given."""
    some = runs.where((F.col("status") == "SUCCESS") & F.col("inputHash").isNotNull())
    dealt = some.repartitionByRange(files, "inputHash") if files else some.repartitionByRange("inputHash")
    options = {
        "parquet.bloom.filter.enabled#inputHash": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.fpp#inputHash": str(FALSE_READS),
        "parquet.enable.dictionary#inputHash": "false", "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.block.size": str(GROUP_BYTES),
    }
    dealt.sortWithinPartitions("inputHash", F.desc("timestamp"), F.desc("id")).write.mode(mode).options(**options).parquet(path)


def found(spark: SparkSession, path: str, input_hash: str) -> DataFrame:
    """All cached runs on an input; the filter reaches the files' statistics, Bloom filters and pages."""
    return spark.read.parquet(path).where(F.col("inputHash") == input_hash)


def lookup(spark: SparkSession, path: str, feature: str, input_hash: str) -> DataFrame:
    """The newest cached run of a feature on an input, as ``history.cached`` finds it."""
    return history.cached(found(spark, path, input_hash), feature, input_hash)


def lookups(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The newest cached run for each (feature, inputHash) of ``wanted``, all at once; those without one give no row."""
    newest: Column = F.max_by(F.struct("*"), F.struct("timestamp", "id"))
    asked = wanted.select("feature", "inputHash").where("feature is not null and inputHash is not null").distinct()
    met = spark.read.parquet(path).join(asked, ["feature", "inputHash"], "left_semi")
    return met.groupBy("feature", "inputHash").agg(newest.alias("r")).select("r.*")


def rows_scanned(df: DataFrame) -> int:
    """Run ``df`` and tell how many rows its file scans gave on: those of the pages that could not be left out."""
    run = df.sparkSession._jvm.org.apache.spark.sql.execution.adaptive.AdaptiveSparkPlanExec
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    if plan.getClass().getName() == run._fqn:
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        inner = leaf.plan().collectLeaves().head() if "QueryStage" in leaf.getClass().getName() else leaf
        metric = inner.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total
