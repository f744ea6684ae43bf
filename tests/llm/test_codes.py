"""Vector codes against plain distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusengine.llm import codes


def brute(rows, parts=16, entries=64, rounds=2, dims=64):
    kept = [(i, lab, None if len(v) != dims else [math.floor(256.0 * x) for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    full = [(i, v) for i, _, v in kept if v is not None]
    w = dims // parts
    start = [v for _, v in sorted(full, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[v[p * w:(p + 1) * w] for v in start] for p in range(parts)]

    def near(v, p):
        own = v[p * w:(p + 1) * w]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in full:
                groups.setdefault(near(v, p)[1], []).append(v[p * w:(p + 1) * w])
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e
                        for j, e in enumerate(books[p])]
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, lab, v in kept:
        found = None if v is None else [near(v, p) for p in range(parts)]
        error = None if v is None else sum(d for d, _ in found)
        out.append((i, lab, None if v is None else "".join(f"{j:02x}" for _, j in found), error))
        if error is not None:
            total[lab] = total.get(lab, 0) + error
    return sorted(((i, c, e, total.get(lab), name) for i, lab, c, e in out), key=repr)


def result(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, None if i % 7 == 0 else i % 3, [rng.gauss(0, 0.4) for _ in range(64)]) for i in range(150)]
    out += [out[4], (None, 1, out[9][2]), (300, 1, None), (301, 9, [0.5] * 32), (302, 1, [None] * 64),
            (303, 1, [math.nan] + [0.0] * 63), (304, 1, [-math.inf] + [0.0] * 63), (305, 2, [0.25] * 64), (306, None, [])]
    return out


def test_codes(spark, rows):
    schema = "vec_id bigint, label int, embedding array<double>, v string, id int"
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], schema).repartition(3)
    assert result(codes.compress_vectors(df)) == brute(rows)
    assert result(codes.compress_vectors(df, entries=5, rounds=1)) == brute(rows, entries=5, rounds=1)


def test_few_none_and_huge(spark, rows):
    schema = "vec_id bigint, label int, embedding array<double>"
    assert result(codes.compress_vectors(spark.createDataFrame(rows[:3], schema))) == brute(rows[:3])
    assert result(codes.compress_vectors(spark.createDataFrame([], schema))) == []
    only_short = codes.compress_vectors(spark.createDataFrame([(1, 2, [0.5])], schema)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in only_short] == [(1, None, None, None)]
    huge = codes.compress_vectors(spark.createDataFrame([(i, 1, [1e300 * (-1) ** i] * 64) for i in range(4)], schema))
    assert all(r.error == 0 for r in huge.collect())


def test_transform_keeps_scaled_distances():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 5, 8):
        x, y = rng.integers(-500, 500, (20, width)), rng.integers(-500, 500, (20, width))
        a, b = codes.walsh(x), codes.walsh(y)
        assert (((a - b) ** 2).sum(axis=1) == a.shape[1] * ((x - y) ** 2).sum(axis=1)).all()
    # Sequency: the number of sign changes grows by one from row to row.
    rows = codes.walsh(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(8))


def test_elimination_finds_the_lowest_nearest_entry():
    rng = np.random.default_rng(2)
    for width in (1, 3, 4, 6):
        x, e = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (40, width))
        entry, d = codes.nearest_entries(x, e)
        every = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_parameters(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<double>")
    for wrong in ({"parts": 5}, {"entries": 257}, {"rounds": -1}):
        with pytest.raises(ValueError):
            codes.compress_vectors(df, **wrong)
