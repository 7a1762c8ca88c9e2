"""Materialised intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and all is on one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    ensure_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is dear for each row: a small table read by fewer tasks than run at once is dealt to as many, else as it is."""
    wanted, query = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    # A plan with an exchange has its partitions from there; counting those of a plain scan runs nothing.
    if "Exchange" in query.executedPlan().toString() or query.toRdd().getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again: worked out once, columns read as they are needed."""
    spark = df.sparkSession
    ensure_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
