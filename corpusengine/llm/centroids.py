"""Exact integer k-means in JVM expressions.

A vector is an array of integers. In every round the centroids are literal
arrays: ``zip_with`` and ``aggregate`` give each distance, ``array_min`` of
(distance, number) structs chooses the cluster, and one aggregate of plain
column sums (combined before its shuffle) gives the new centroids. The driver
holds the centroids alone: k x (dimensions + 1) numbers a round. No vector moves
but to the written table of integers that all rounds read; a cluster that holds
every vector costs one row per task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Components lie within this bound, so that 64 of them have distances in a long;
# beyond it (after scaling) they are cut to it.
BOUND = 1 << 27
MAX_LONG = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, dims: int) -> Column:
    """Exactly ``dims`` components, none of them null or not finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))

    return F.coalesce((F.size("_v") == dims) & ~F.exists("_v", bad), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double."""
    def whole(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-float(BOUND))), F.lit(float(BOUND))))

    return F.transform(vector, whole)


def literal(numbers: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("long") for n in numbers])


def distance(vector: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance to a literal centroid."""
    squares = F.zip_with(vector, literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda s, x: s + x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*[F.struct(distance(vector, c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hash; without an id they come
    last, and equal ids go by their components."""
    named = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256))
    top = named.orderBy(F.asc_nulls_last("_h"), "_v").limit(k).select("_h", "_v").collect()
    return [list(r["_v"]) for r in top]


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of each cluster's vectors; empty clusters stay."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("_v")[j]).alias(f"s{j}") for j in range(dims)]
    out = [list(c) for c in centroids]
    for r in assigned.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # at most k rows
        out[r["_c"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64,
                    id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "3") -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance (squared),
    cluster_inertia, inertia and centroid_sha256 (of the components of the final
    centroid in decimal, joined by commas).

    Vectors that are null, have another length or hold a null, NaN or infinite
    component go. Components beyond 2^27 after scaling are cut to it, sums of
    distances to the largest long. Repeated rows stay repeated and count as
    often; null ids are kept, and start a centroid only if there are no others.
    With fewer than k vectors there are as many centroids; an empty table gives
    an empty result. Other columns are not read, whatever their names."""
    if k < 1 or rounds < 0:
        raise ValueError("k must be at least 1 and rounds at least 0")
    scratch = Scratch(vectors.sparkSession, "centroids")
    narrow = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = scratch.write(narrow.filter(kept_vectors(narrow, dims)).select("_id", integers(F.col("_v"), scale).alias("_v")),
                         "integers")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select(F.col("_id").alias("vec_id"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(rows.select("_v", nearest(F.col("_v"), centroids)["cluster"].alias("_c")), centroids)

    final = scratch.write(rows.select(F.col("_id").alias("vec_id"), nearest(F.col("_v"), centroids).alias("_n"))
                          .select("vec_id", "_n.cluster", "_n.distance"), "assigned")
    total = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    by_cluster = [min(total.get(i, 0), MAX_LONG) for i in range(len(centroids))]
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return final.select("vec_id", "cluster", "distance", of_cluster(by_cluster).cast("long").alias("cluster_inertia"),
                        F.lit(min(sum(total.values()), MAX_LONG)).cast("long").alias("inertia"),
                        of_cluster(named).alias("centroid_sha256"))


def centroids_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3") -> str:
    """DuckDB SQL for ``cluster_vectors`` over ``embeddings``: one step per round."""
    def assign(i: int) -> str:
        return f"""d{i} AS MATERIALIZED (
  SELECT x.rid, c.k, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
  FROM long x JOIN c{i} c ON x.j = c.j GROUP BY x.rid, c.k),
a{i} AS MATERIALIZED (SELECT rid, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM d{i} GROUP BY rid)"""

    def move(i: int) -> str:
        return f"""m{i} AS (
  SELECT a.k, x.j, sum(x.v) AS s, count(*) AS n FROM long x JOIN a{i} a USING (rid) GROUP BY a.k, x.j),
c{i + 1} AS MATERIALIZED (
  SELECT c.k, c.j, CAST(CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v
  FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k AND c.j = m.j)"""

    steps = [f"{assign(i)},\n{move(i)}" for i in range(rounds)] + [assign(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
long AS MATERIALIZED (SELECT rid, unnest(generate_series(1, {dims})) AS j, unnest(v) AS v FROM kept),
start AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept WHERE vec_id IS NOT NULL
  ORDER BY k LIMIT {k}),
c0 AS MATERIALIZED (SELECT s.k, x.j, x.v FROM start s JOIN long x USING (rid)),
{(',' + chr(10)).join(steps)},
named AS (
  SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, named.centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN named USING (k)"""
