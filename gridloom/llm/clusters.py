"""Centroid clustering: plain Lloyd over integer vectors.

Vectors are scaled and floored to integers, so that distances, sums and means are exact and a run gives the same clusters
however rows are dealt to tasks. Each round broadcasts the centroids (``clusters`` times ``dims`` integers, whatever the
input), every task works out the squared differences to each centroid in NumPy and sums the vectors of each cluster, and
the tasks' sums meet in a groupBy of clusters times components rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Largest component, scaled, in amount: 64 squares of differences of such numbers fit into 63 bits.
LARGEST = 1 << 27
#: Places of a cluster's rows in the partial sums that are no components.
COUNT, INERTIA = -1, -2


def integers(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(ident, v) of the rows whose vector has exactly ``dims`` components, none null, NaN or infinite: v = floor(scale * x)."""
    if dims > DIMS:
        raise ValueError(f"distances are exact up to {DIMS} components")
    x = F.col(vector)
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity
    scaled = lambda c: F.lit(scale) * c.cast("double")
    fits = F.forall("_x", lambda c: F.abs(scaled(c)) < LARGEST)
    whole = F.transform("_x", lambda c: F.floor(scaled(c)).cast("int"))
    kept = df.select(F.col(ident).alias(ident), x.alias("_x")).where((F.size("_x") == dims) & F.forall("_x", finite))
    return kept.select(ident, F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a vector has a component of {LARGEST // scale} or more"))).alias("v"))


def starts(vectors: DataFrame, ident: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:ident``: fewer where there are fewer rows."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    rows = vectors.withColumn("_h", F.sha2(name, 256)).orderBy("_h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the lowest of several, and its squared distance."""
    apart = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(v)), at]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _sum(numbers: np.ndarray) -> int:
    """Sum of non-negative 63-bit integers, of any size."""
    return (int((numbers >> 31).sum()) << 31) + int((numbers & 0x7FFFFFFF).sum())


def totals(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums over each cluster's vectors by (cluster, component), their number and inertia: as many rows as there are clusters and components."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches):
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["v"])
            at, apart = nearest(v, shared.value)
            for k in np.unique(at):
                own = at == k
                found = {COUNT: int(own.sum()), INERTIA: _sum(apart[own])} | dict(enumerate(v[own].sum(axis=0).tolist()))
                for place, n in found.items():
                    sums[k, place] = sums.get((k, place), 0) + n
        yield pd.DataFrame({"cluster": [k for k, _ in sums], "place": [p for _, p in sums], "total": [Decimal(n) for n in sums.values()]})

    parts = vectors.select("v").mapInPandas(partial, "cluster int, place int, total decimal(38,0)")
    return {(r["cluster"], r["place"]): int(r["total"]) for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; without vectors it stays."""
    k, dims = centroids.shape
    return np.array([[sums[j, p] // sums[j, COUNT] for p in range(dims)] if sums.get((j, COUNT)) else centroids[j] for j in range(k)], np.int64)


def lloyd(vectors: DataFrame, ident: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds over ``integers``; no rows give none."""
    centroids = starts(vectors, ident, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, totals(vectors, centroids))
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, ident: str = "vec_id") -> DataFrame:
    """(ident, cluster, distance) of every row of ``integers``."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def place(batches):
        for batch in batches:
            if len(batch):
                at, apart = nearest(_matrix(batch["v"]), shared.value)
                yield pd.DataFrame({ident: batch[ident], "cluster": at, "distance": apart})

    return vectors.select(ident, "v").mapInPandas(place, f"`{ident}` {vectors.schema[ident].dataType.simpleString()}, cluster int, distance long")


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector of 64 finite components.

    Rows of another length, or with a null, NaN or infinite component, are left out, as are null vectors. Null ids count as
    empty strings in the hash; rows that repeat an id are vectors of their own, of equal hashes the one that comes first by its components starts. With
    fewer rows than clusters there are as many clusters; an empty table gives an empty one. A component of 131,072 or more
    raises an error, as distances would no longer fit. Other columns are left alone.
    """
    spark = embeddings.sparkSession
    vectors = written(integers(embeddings), "vectors")
    centroids = lloyd(vectors)
    sums = totals(vectors, centroids) if len(centroids) else {}
    inertia = [sums.get((k, INERTIA), 0) for k in range(len(centroids))]
    rows = [(k, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    # One row for each cluster.
    known = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned(vectors, centroids).join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, a few common table expressions for each round."""
    parts = [
        f"e as materialized (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = {dims})",
        "c as materialized (select r, vec_id, unnest(embedding) as f, generate_subscripts(embedding, 1) as p from e)",
        f"ok as (select r from c group by r having count(f) = {dims} and bool_and(isfinite(f)))",
        f"v as materialized (select r, vec_id, p, floor({scale} * f::double)::bigint as x from c semi join ok using (r))",
        f"s as (select r, row_number() over (order by sha256('{seed}:' || vec_id::varchar)) - 1 as k from (select distinct r, vec_id from v))",
        f"k0 as materialized (select k, p, x as m from s join v using (r) where k < {clusters})",
    ]
    near = f"select r, min(d * {clusters} + k) as code from (select r, k, sum((x - m) * (x - m)) as d from v join {{0}} using (p) group by r, k) group by r"
    for i in range(1, rounds + 1):
        parts += [
            f"a{i} as materialized ({near.format(f'k{i - 1}')})",
            f"m{i} as (select code % {clusters} as k, p, sum(x) as s, count(*) as n from v join a{i} using (r) group by 1, 2)",
            f"k{i} as materialized (select k, p, coalesce((s - ((s % n) + n) % n) // n, m)::bigint as m from k{i - 1} left join m{i} using (k, p))",
        ]
    parts += [
        f"a as materialized (select r, (code % {clusters})::integer as cluster, (code // {clusters})::bigint as distance from ({near.format(f'k{rounds}')}))",
        f"h as (select k, sha256(string_agg(m::varchar, ',' order by p)) as centroid_sha256 from k{rounds} group by k)",
        "i as (select cluster, sum(distance)::bigint as cluster_inertia from a group by cluster)",
    ]
    return f"""with {", ".join(parts)}
select vec_id, cluster, distance, cluster_inertia, (select sum(distance) from a)::bigint as inertia, centroid_sha256
from a join (select distinct r, vec_id from v) using (r) join i using (cluster) join h on h.k = cluster
"""
