"""Nearest-neighbour retrieval over a vector corpus.

Plan for exact search (no cross join, no pair rows):

1. Questions are cut into blocks whose size is checked (rows and bytes) before
   they are shipped to every task as one broadcast matrix. One block is on the
   driver at a time; with several, each block's result is written before the
   next is collected and its broadcast is destroyed.
2. The corpus is scanned in place with ``mapInArrow``: each Arrow batch of
   vectors is multiplied with the question matrix (BLAS), and each task keeps
   only its exact top-k per question (ties broken by smaller id).
3. Only those k rows per question and task are shuffled; a ``row_number``
   window (planned with a partial WindowGroupLimit) picks the global top-k.

The corpus is never shuffled or broadcast. Ids may be of any ordered type (the
engine's own chunk ids are strings). Approximate search (IVF) adds a cell
column to the corpus (Spark ML KMeans, fitted on a bounded sample); a row is
multiplied only with the questions that probe its cell. With every cell probed
it equals exact search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RetrievalLimits
from ..session import scratch_path

METRICS = ("cosine", "dot", "l2")
SCORE_CELLS = 4_000_000  # scores (rows x questions) that a task computes together


def vector_mean(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """Per key, the element-wise mean vector (array<double>).

    Spark ML's Summarizer is a partial aggregate over whole vectors (no
    explode per dimension), so a hot key costs one buffer per map task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select(key, array_to_vector(F.col(vec_col)).alias("_v"))
    agg = v.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return agg.select(key, vector_to_array("_m").alias(vec_col))


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def _block_count(questions: DataFrame, limits: RetrievalLimits, qvec_col: str, q_cells_col: str | None = None) -> tuple[int, int]:
    """Number of question rows and of broadcast blocks needed. The width of a
    row is measured: its vector, and one byte per cell up to the last one probed."""
    cells = F.max(F.array_max(q_cells_col)) if q_cells_col else F.lit(-1)
    r = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("dim"), cells.alias("cell")).first()
    n = r["n"]
    if n == 0:
        return 0, 0
    per_row = 8 * max(r["dim"] or 0, 1) + (r["cell"] if r["cell"] is not None else -1) + 1 + 64
    rows_per_block = max(1, min(limits.max_broadcast_questions, limits.max_broadcast_bytes // per_row))
    return n, max(1, math.ceil(n / rows_per_block))


def _collect_block(block: DataFrame, qid_col: str, qvec_col: str, extra: list[str]) -> dict:
    """The (size-checked) question block as numpy arrays for broadcasting."""
    pdf = block.select(qid_col, qvec_col, *extra).toPandas()
    ids = pdf[qid_col].to_numpy()
    if len(pdf):
        mat = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[qvec_col]])
    else:
        mat = np.zeros((0, 0))
    out = {"ids": ids, "mat": mat}
    for c in extra:
        vals = pdf[c].to_numpy()
        if len(vals) and isinstance(vals[0], (list, np.ndarray)):
            # probed cells -> boolean matrix [cell, question]
            ncell = 1 + max((int(x) for v in vals for x in v), default=-1)
            probe = np.zeros((ncell, len(vals)), dtype=bool)
            for j, v in enumerate(vals):
                probe[np.asarray(v, dtype=np.int64), j] = True
            out[c] = probe
        else:
            out[c] = vals
    return out


def _candidates(sel: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, question) of every score within ``slack`` of a question's k-th."""
    if sel.shape[0] > k:
        kth = -np.partition(-sel, k - 1, axis=0)[k - 1]
        mask = sel >= (kth[None, :] - slack)
    else:
        mask = np.ones_like(sel, dtype=bool)
    return np.nonzero(mask & np.isfinite(sel))


def _scores(metric: str, V: np.ndarray, Q: np.ndarray, k: int, allowed: np.ndarray | None):
    """(rows, questions, exact scores) of the candidates of one matrix product."""
    dim = Q.shape[1]
    if metric == "cosine":
        # Selection in float32 (sgemm). The margin covers its rounding: the
        # error of a dot product of unit vectors is below dim * 2^-24 each way
        # (plus that of the scaling); candidates are re-scored in float64.
        vn = np.linalg.norm(V.astype(np.float32, copy=False), axis=1)
        qn = np.linalg.norm(Q, axis=1)
        unit = Q / np.where(qn == 0, 1.0, qn)[:, None]
        sel = (V.astype(np.float32, copy=False) / np.where(vn == 0, 1.0, vn)[:, None]) @ unit.astype(np.float32).T
        slack = 4 * (dim + 8) * 2.0 ** -24
    elif metric == "dot":
        sel, slack = V.astype(np.float64) @ Q.T, 1e-9
    else:
        x = V.astype(np.float64)
        sq = (x * x).sum(axis=1)[:, None] + (Q * Q).sum(axis=1)[None, :] - 2.0 * (x @ Q.T)
        sel, slack = -np.sqrt(np.maximum(sq, 0.0)), 1e-6
    if allowed is not None:
        sel = np.where(allowed, sel, -np.inf)
    r, c = _candidates(sel, k, slack)
    x = V[r].astype(np.float64)
    if metric == "l2":
        return r, c, np.sqrt(((x - Q[c]) ** 2).sum(axis=1))
    if metric == "dot":
        return r, c, (x * Q[c]).sum(axis=1)
    n = np.linalg.norm(x, axis=1)
    return r, c, (x * unit[c]).sum(axis=1) / np.where(n == 0, 1.0, n)


def _score_fn(bc, metric: str, k: int, id_col: str, vec_col: str,
              filter_col: str | None, q_filter_col: str | None,
              cell_col: str | None, q_cells_col: str | None, qid_type, id_type):
    """mapInArrow function: per-task exact top-k candidates per question."""

    def run(batches):
        blk = bc.value
        Q = blk["mat"]
        nq = len(blk["ids"])
        if nq == 0:
            return
        qf = blk.get(q_filter_col) if q_filter_col else None
        qcells = blk.get(q_cells_col) if q_cells_col else None
        held: list[pd.DataFrame] = []
        buffered = 0

        def prune():
            nonlocal held, buffered
            if held:
                df = pd.concat(held)
                df = df.sort_values(["q", "score", "id"], ascending=[True, metric == "l2", True], kind="mergesort")
                held = [df.groupby("q", sort=False).head(k)]
                buffered = len(held[0])

        for rb in batches:
            if rb.num_rows == 0:
                continue
            vec = rb.column(rb.schema.get_field_index(vec_col))
            ids_arr = rb.column(rb.schema.get_field_index(id_col))
            valid = np.asarray(vec.is_valid()) & np.asarray(ids_arr.is_valid())
            lens = np.diff(np.asarray(vec.offsets))
            dim = Q.shape[1]
            valid &= lens == dim
            if not valid.any():
                continue
            rows = np.nonzero(valid)[0]
            flat = np.asarray(vec.flatten())  # float32 for array<float>, no copy
            starts = np.asarray(vec.offsets)[:-1][rows] - np.asarray(vec.offsets)[0]
            V = flat[(starts[:, None] + np.arange(dim)[None, :])]
            ids = ids_arr.to_numpy(zero_copy_only=False)[rows]
            allowed, cf = None, None
            if qf is not None:
                cf = np.asarray(rb.column(rb.schema.get_field_index(filter_col)).to_pandas())[rows]
            # Only rows and questions that share a cell (or, without cells, the
            # filter value) are multiplied.
            if qcells is not None:
                cells = np.asarray(rb.column(rb.schema.get_field_index(cell_col)).to_pandas())[rows].astype(np.int64)
                parts = [(np.nonzero(cells == c)[0], np.nonzero(qcells[c])[0])
                         for c in np.unique(cells) if c < qcells.shape[0]]
                allowed = None if cf is None else cf[:, None] == qf[None, :]
            elif cf is not None:
                parts = [(np.nonzero(cf == v)[0], np.nonzero(qf == v)[0]) for v in pd.unique(cf)]
            else:
                parts = [(np.arange(len(rows)), np.arange(nq))]
            for own, asked in parts:
                if not len(own) or not len(asked):
                    continue
                step = max(1, SCORE_CELLS // len(asked))
                for i in range(0, len(own), step):
                    some = own[i:i + step]
                    r, c, score = _scores(metric, V[some], Q[asked], k,
                                          None if allowed is None else allowed[np.ix_(some, asked)])
                    held.append(pd.DataFrame({"q": asked[c], "id": ids[some[r]], "score": score}))
                    buffered += len(r)
                    if buffered > 8 * k * nq + 4096:
                        prune()
        prune()
        if held and len(held[0]):
            df = held[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blk["ids"][df["q"].to_numpy()], qid_type), pa.array(df["id"].to_numpy(), id_type),
                 pa.array(df["score"].to_numpy(), pa.float64())], names=["qid", "id", "score"])

    return run


def knn(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    metric: str = "cosine",
    id_col: str = "id",
    vec_col: str = "embedding",
    qid_col: str = "qid",
    qvec_col: str = "qvec",
    filter_col: str | None = None,
    q_filter_col: str | None = None,
    cell_col: str | None = None,
    q_cells_col: str | None = None,
    limits: RetrievalLimits = RetrievalLimits(),
) -> DataFrame:
    """Top-k corpus rows per question: (qid, rank, id, score).

    ``score`` is the cosine similarity / dot product (higher first) or the L2
    distance (lower first); ties go to the smaller id. ``filter_col`` =
    ``q_filter_col`` restricts a question to corpus rows with the same value
    (metadata filter). ``cell_col`` / ``q_cells_col`` restrict it to the
    probed IVF cells.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    _check_metric(metric)
    spark = corpus.sparkSession
    extra = [c for c in (q_filter_col, q_cells_col) if c]
    q = questions.select(qid_col, qvec_col, *extra)
    scan = corpus.select(id_col, vec_col, *[c for c in (filter_col, cell_col) if c])
    qid_type, id_type = q.schema[qid_col].dataType, scan.schema[id_col].dataType
    schema = T.StructType([T.StructField("qid", qid_type), T.StructField("id", id_type),
                           T.StructField("score", T.DoubleType())])
    n, nblocks = _block_count(q, limits, qvec_col, q_cells_col)
    if n == 0:
        empty = spark.createDataFrame([], schema)
        return empty.select(F.col("qid").alias(qid_col), F.lit(0).cast("long").alias("rank"),
                            F.col("id").alias(id_col), "score")
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    w = Window.partitionBy("qid").orderBy(order, F.col("id").asc())
    out_path = scratch_path(spark, "knn") if nblocks > 1 else None
    for b in range(nblocks):
        block = q if nblocks == 1 else q.where(F.pmod(F.xxhash64(qid_col), F.lit(nblocks)) == b)
        bc = spark.sparkContext.broadcast(_collect_block(block, qid_col, qvec_col, extra))
        fn = _score_fn(bc, metric, k, id_col, vec_col, filter_col, q_filter_col, cell_col, q_cells_col,
                       to_arrow_type(qid_type), to_arrow_type(id_type))
        top = scan.mapInArrow(fn, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if out_path:
            top.write.mode("append").parquet(out_path)
            bc.destroy()
    if out_path:
        top = spark.read.parquet(out_path)
    return top.select(
        F.col("qid").alias(qid_col), F.col("rank").cast("long"), F.col("id").alias(id_col), "score"
    )


# ---------------------------------------------------------------------------
# IVF: cells from Spark ML KMeans, probing the nearest cells per question.
# ---------------------------------------------------------------------------

def cell_count(n_rows: int, rows_per_cell: int = 4096, least: int = 16, most: int = 65_536) -> int:
    """Number of cells for a corpus of ``n_rows``: a cell holds some thousands
    of rows, whatever the size."""
    return max(least, min(most, math.ceil(n_rows / rows_per_cell)))


def ivf_cells(corpus: DataFrame, vec_col: str, nlist: int | None = None, seed: int = 7, max_iter: int = 5,
              sample_rows: int = 50_000, rows_per_center: int = 64):
    """Fit KMeans and return (model, corpus + 'cell').

    The centroids are fitted on a sample of about ``sample_rows`` rows, or
    ``rows_per_center`` for each cell if that is more; every row gets a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = corpus.count()
    nlist = cell_count(n) if nlist is None else nlist
    sample_rows = max(sample_rows, rows_per_center * nlist)
    feats = corpus.withColumn("_features", array_to_vector(F.col(vec_col)))
    some = feats.select("_features")
    some = some.sample(fraction=sample_rows / n, seed=seed) if n > sample_rows else some
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cell").fit(some)
    return model, model.transform(feats).drop("_features")


def probe_cells(questions: DataFrame, model, qvec_col: str, nprobe: int) -> DataFrame:
    """Add 'cells': the ``nprobe`` nearest centroids (L2) of each question.

    The centroid matrix is bounded by ``nlist`` x dim and is broadcast once;
    each Arrow batch of questions is scored against it with numpy."""
    centers = np.asarray(model.clusterCenters(), dtype=np.float64)
    bc = questions.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vs: pd.Series) -> pd.Series:
        c = bc.value
        x = np.vstack([np.asarray(v, dtype=np.float64) for v in vs]) if len(vs) else np.zeros((0, c.shape[1]))
        d = (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)  # |x|^2 is the same for every cell
        return pd.Series(np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype(np.int32).tolist())

    return questions.withColumn("cells", nearest(F.col(qvec_col)))


def choose_nprobe(cells: DataFrame, questions: DataFrame, model, k: int, target: float = 0.9, metric: str = "cosine",
                  id_col: str = "id", vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
                  cell_col: str = "cell", max_questions: int = 1000) -> tuple[int, float]:
    """(nprobe, recall): the fewest probed cells that find ``target`` of the exact
    neighbours, and the share they find.

    Measured against ``knn`` on at most ``max_questions`` questions (smallest
    hashes of the ids first); where that is a sample, its recall must exceed the
    target by two standard errors. A neighbour is found from the place of its
    cell in the question's order of cells on, so one exact pass tells the recall
    of every nprobe."""
    nlist = len(model.clusterCenters())
    total = questions.count()
    some = questions if total <= max_questions else questions.orderBy(F.xxhash64(qid_col), qid_col).limit(max_questions)
    exact = knn(cells, some, k, metric, id_col, vec_col, qid_col, qvec_col)
    at = exact.select(qid_col, id_col).join(cells.select(id_col, cell_col), id_col)
    order = probe_cells(some, model, qvec_col, nlist).select(qid_col, "cells")
    places = at.join(order, qid_col).select(qid_col, F.array_position("cells", F.col(cell_col)).alias("place"))
    pdf = places.groupBy(qid_col, "place").count().toPandas()  # at most k rows per question
    if not len(pdf):
        return nlist, 1.0
    n = pdf.groupby(qid_col)["count"].sum()
    for nprobe in range(1, nlist + 1):
        found = pdf[pdf["place"] <= nprobe].groupby(qid_col)["count"].sum().reindex(n.index, fill_value=0)
        recall = float(found.sum() / n.sum())
        error = float((found / n).std(ddof=0)) / math.sqrt(len(n)) if total > max_questions else 0.0
        if recall - 2 * error >= target:
            return nprobe, recall
    return nlist, 1.0


def recall_at_k(approx: DataFrame, exact: DataFrame, qid_col: str = "qid", id_col: str = "id") -> DataFrame:
    """One row: share of exact top-k ids that the approximate result found."""
    hit = exact.join(approx.select(qid_col, id_col), [qid_col, id_col], "left_semi").count()
    total = exact.count()
    spark: SparkSession = exact.sparkSession
    return spark.createDataFrame([(float(hit) / total if total else 1.0,)], "recall double")


def write_ivf_corpus(cells: DataFrame, path: str, cell_col: str = "cell", id_col: str = "id",
                     rows_per_file: int = 500_000) -> None:
    """Write a corpus with IVF cells partitioned by cell. A cell is dealt over
    as many tasks as its row count asks for (its share of salts), so a hot cell
    does not fall to one writer and small cells make one file."""
    sizes = cells.groupBy(cell_col).agg(F.count(F.lit(1)).alias("_n"))  # one row per cell
    parts = F.ceil(F.col("_n") / rows_per_file).cast("int")
    salted = cells.join(F.broadcast(sizes.select(cell_col, parts.alias("_parts"))), cell_col)
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.col("_parts"))
    salted.repartition(F.col(cell_col), salt).drop("_parts").write.mode("errorifexists").option(
        "maxRecordsPerFile", rows_per_file).partitionBy(cell_col).parquet(path)


def knn_ivf(corpus_path: str, questions: DataFrame, model, k: int, nprobe: int, metric: str = "cosine",
            id_col: str = "id", vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
            cell_col: str = "cell", limits: RetrievalLimits = RetrievalLimits()) -> DataFrame:
    """Approximate top-k reading only the probed cells of a cell-partitioned
    corpus (partition pruning at the scan); the probed-cell set is bounded by
    the number of cells."""
    spark = questions.sparkSession
    qs = probe_cells(questions, model, qvec_col, nprobe)
    probed = sorted(r[0] for r in qs.select(F.explode("cells").alias("c")).distinct().collect())
    corpus = spark.read.parquet(corpus_path).where(F.col(cell_col).isin(probed))
    return knn(corpus, qs, k, metric, id_col, vec_col, qid_col, qvec_col,
               cell_col=cell_col, q_cells_col="cells", limits=limits)
