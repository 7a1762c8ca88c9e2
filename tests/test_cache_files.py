"""Lookups in clustered files miss nothing and read a page or two."""

import hashlib

from pyspark.sql import functions as F

from gridloom.operators import cache_files, history


def test_lookups_read_few_rows(spark, tmp_path):
    path, n = str(tmp_path / "cache"), 60_000
    runs = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("feature"), F.md5((F.col("id") % 50_000).cast("string")).alias("inputHash"),
        F.when(F.col("id") % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (F.col("id") * 10).alias("timestamp"),
    )
    cache_files.write(runs.unionByName(runs.limit(1).withColumns({"inputHash": F.lit(None).cast("string"), "status": F.lit("SUCCESS")})), path, files=8)
    md5 = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    for k in (1, 8, 9_999, 10_001, 7, 49_998):
        want = [tuple(r) for r in history.cached(runs, "A" if k % 2 == 0 else "B", md5(k)).collect()]
        got = cache_files.lookup(spark, path, "A" if k % 2 == 0 else "B", md5(k))
        assert [tuple(r) for r in got.collect()] == want
        assert cache_files.rows_scanned(cache_files.found(spark, path, md5(k))) <= 2 * cache_files.PAGE_ROWS
    # Hashes that are nowhere: the share for which a row group is read in vain.
    vain = sum(cache_files.rows_scanned(cache_files.found(spark, path, md5(f"x{k}"))) > 0 for k in range(60))
    assert vain <= 4
    wanted = runs.where("id in (1, 2, 7, 8, 59999)").select("feature", "inputHash").unionAll(spark.createDataFrame([("A", md5("none")), (None, md5(1))], "feature string, inputHash string"))
    got = {(r.feature, r.inputHash): r.id for r in cache_files.lookups(spark, path, wanted).collect()}
    assert got == {(r.feature, r.inputHash): history.cached(runs, r.feature, r.inputHash).first().id for r in wanted.distinct().collect() if r.feature and history.cached(runs, r.feature, r.inputHash).count()}
