"""Integer k-means against a plain statement of the rules."""

import hashlib
import math

import pytest

from corpusengine.llm import centroids


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    c = [list(v) for _, v in sorted(named)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else x for j, x in enumerate(c)]
    found = [(i, near(v)) for i, v in kept]
    by = {}
    for _, (d, j) in found:
        by[j] = by.get(j, 0) + d
    total = sum(by.values())
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, (d, j) in found), key=repr)


def result(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(4)
    out = [(i, [rng.gauss((i % 5) * 0.3, 0.2) for _ in range(64)]) for i in range(120)]
    out += [(3, out[3][1]), (None, out[5][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [None] + [0.1] * 63),
            (204, [math.nan] + [0.1] * 63), (205, [math.inf] + [0.1] * 63), (206, [0.25] * 64), (207, [0.25] * 64)]
    return out


def test_clusters(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, _v string, _c int")
    assert result(centroids.cluster_vectors(df.repartition(3))) == brute(rows)
    assert result(centroids.cluster_vectors(df, k=3, rounds=0)) == brute(rows, 3, 0)


def test_few_none_and_huge(spark, rows):
    schema = "vec_id bigint, embedding array<double>"
    assert result(centroids.cluster_vectors(spark.createDataFrame(rows[:3], schema))) == brute(rows[:3])
    for none in ([], [(1, None), (2, [1.0])]):
        assert result(centroids.cluster_vectors(spark.createDataFrame(none, schema))) == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)] * 8, schema)
    top = 64 * (2 * centroids.BOUND) ** 2
    assert all(r.distance == 0 for r in centroids.cluster_vectors(huge).collect())
    one = centroids.cluster_vectors(huge, k=1, rounds=0).collect()
    assert {r.distance for r in one} == {0, top} and one[0].inertia == min(8 * top, centroids.MAX_LONG)


def test_plan_is_jvm_only_and_combines_before_the_shuffle(spark):
    F = centroids.F
    df = spark.range(9).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x * F.col("id")).alias("_v"))
    c = [[i] * 64 for i in range(8)]
    plan = df.select("_v", centroids.nearest(F.col("_v"), c)["cluster"].alias("_c")).groupBy("_c").agg(
        F.sum(F.col("_v")[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum" in plan
