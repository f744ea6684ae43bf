import numpy as np
import pytest
from pyspark.sql import functions as F

from support import SF01
from corpusengine.operators import codes as pq
from corpusengine.operators import retrieval as rt
from corpusengine.session import materialize
from corpusengine.sources.tables import read_table

SF1 = "/root/testdata/sf0.1"


def built(spark, e, **kw):
    index = pq.fit_codes(e, **kw)
    coded = materialize(pq.encode(e, index), "coded")
    return pq.measure(index, coded), coded


def answers(df):
    return sorted((r.qid, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())


def asked_of(e):
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@pytest.fixture(scope="module")
def small(spark):
    e = read_table(spark, SF01, "embeddings", "vec_id", "embedding")
    return e, *built(spark, e, rounds=2)


def test_cells_codes_and_bounds(spark, small):
    e, index, coded = small
    rows = coded.orderBy("vec_id").collect()
    assert len(rows) == e.count()
    assert len(index.top) < len(index.leaf) and index.start[-1] == len(index.leaf)
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    code = np.array([list(r.code) for r in rows])
    cut = x.reshape(len(x), index.parts, index.width)
    for j in range(index.parts):  # the nearest entry, by brute force
        d = ((cut[:, j, None, :] - index.books[j][None]) ** 2).sum(axis=2)
        np.testing.assert_allclose(d[np.arange(len(x)), code[:, j]], d.min(axis=1), atol=1e-9)
    decoded = index.books[np.arange(index.parts)[None, :], code].reshape(len(x), -1)
    gap = np.array([r.gap for r in rows])
    assert (np.abs(x @ x.T - decoded @ x.T) <= gap[:, None] + 1e-9).all()
    cell = np.array([r.cell for r in rows])
    for c in set(cell.tolist()):
        far = np.linalg.norm(x[cell == c] - index.leaf[c], axis=1).max()
        assert index.radius[c] == pytest.approx(far)


@pytest.mark.parametrize("nprobe,size", [(1, 5), (3, 40), (16, 500)])
def test_exact_is_exact_and_proven_answers_are_right(spark, small, nprobe, size):
    e, index, coded = small
    truth = answers(rt.knn(e, asked_of(e), 5, id_col="vec_id"))
    exact = pq.knn_codes(coded, asked_of(e), index, 5, nprobe, size, exact=True, id_col="vec_id")
    assert answers(exact) == truth
    rough = pq.knn_codes(coded, asked_of(e), index, 5, nprobe, size, id_col="vec_id")
    assert set(answers(rough.where("proven"))) <= set(truth)
    if size == 500:  # every row was scored
        assert rough.where("not proven").isEmpty()


@pytest.mark.parametrize("d", [SF01, SF1])
def test_recall(spark, d):
    e = read_table(spark, d, "embeddings", "vec_id", "embedding")
    index, coded = built(spark, e, rounds=3)
    nprobe, size, recall = pq.choose_probes(coded, asked_of(e), index, 5, id_col="vec_id")
    got = pq.knn_codes(coded, asked_of(e), index, 5, nprobe, size, id_col="vec_id")
    exact = rt.knn(e, asked_of(e), 5, id_col="vec_id")
    measured = rt.recall_at_k(got, exact, id_col="vec_id").first()["recall"]
    assert measured >= 0.9 and measured == pytest.approx(recall)
    assert size < e.count() / 2


def test_copies_bad_vectors_and_blocks(spark):
    """A third of the rows is one vector; null, non-finite, zero and other-width
    vectors and rows without an id; questions in several broadcast blocks."""
    from corpusengine.config import RetrievalLimits

    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0] if i % 3 == 0 else rng.normal(size=5).tolist()) for i in range(300)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5),
             (904, [0.0] * 5), (905, [1.0, 2.0]), (906, []), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    index, coded = built(spark, e, parts=3, nlist=6)
    assert {r.vec_id for r in coded.collect()} == {*range(300), 904, None}
    asked = e.where("vec_id < 40 or vec_id >= 900").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    good = asked.where(pq.valid_vector("qvec", 5))
    truth = answers(rt.knn(e.where(pq.valid_vector("embedding", 5)).where("vec_id is not null"), good, 4, id_col="vec_id"))
    kw = dict(id_col="vec_id", limits=RetrievalLimits(max_broadcast_questions=7))
    assert answers(pq.knn_codes(coded, asked, index, 4, 2, 6, exact=True, **kw)) == truth
    with pytest.raises(ValueError):
        pq.encode(coded, index)


def test_empty(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index, coded = built(spark, e)
    asked = spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>")
    assert pq.choose_probes(coded, asked, index, 3, id_col="vec_id")[2] == 1.0
    assert pq.knn_codes(coded, asked, index, 3, 1, 5, exact=True, id_col="vec_id").count() == 0
    one = spark.createDataFrame([(7, [3.0, 4.0])], "vec_id long, embedding array<double>")
    index, coded = built(spark, one)
    got = pq.knn_codes(coded, one.toDF("qid", "qvec"), index, 3, 1, 5, id_col="vec_id")
    assert answers(got) == [(7, 1, 7, 1.0)] and got.first()["proven"]


def test_blocks_count_the_shortlists(spark, small, monkeypatch):
    """A longer shortlist takes more of a task's memory, so fewer questions are asked at a time."""
    from corpusengine.config import RetrievalLimits

    e, index, coded = small
    asked, calls, made = asked_of(e), [], pq._shortlist_fn
    monkeypatch.setattr(pq, "_shortlist_fn", lambda *a: (calls.append(1), made(*a))[1])
    width = 8 * (index.dim + index.parts * index.books.shape[1])
    tight = RetrievalLimits(max_broadcast_bytes=5 * width)
    found = {}
    for size in (8, 400):
        for limits in (tight, RetrievalLimits()):
            calls.clear()
            got = answers(pq.knn_codes(coded, asked, index, 4, 4, size, id_col="vec_id", limits=limits))
            found[size, limits is tight] = len(calls), got
        assert found[size, True][1] == found[size, False][1]
    assert found[400, True][0] > found[8, True][0] > 1 == found[8, False][0]
