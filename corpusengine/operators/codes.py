"""Cosine search over product codes with a two-level cell tree (V4).

1. **Tree.** About sqrt(n) top cells, each with children in proportion to its
   share of the sample. A row is compared with the top centres and then with the
   children of one of them, not with every cell.
2. **Codes.** A vector is cut into ``parts`` sub-vectors; each has a codebook of
   at most 256 entries, so a row's code is one byte per part, a binary column.
   ``gap`` is the distance between the unit vector and its decoded form, ``far``
   that to the centre of its cell.
3. **Shortlist.** A question's products with all entries are a small table; the
   estimate of a row is one look-up per part. Only codes are scanned (``code``,
   ``gap``), only in the probed cells, and each task keeps its best rows.
4. **Re-rank.** The vectors of the shortlist are read from the same cells and
   scored exactly.

The estimate errs by at most ``gap``, and a row of a cell that was not probed
scores at most q.centre + radius. So the largest score that a row beyond the
shortlist can have is known: where the k-th exact score is above it the answer is
*proven* exact. ``exact=True`` asks the other questions again with ``knn``.

Centres and codebooks are fitted by Lloyd rounds on a sample of distinct vectors
(documented bounds below); every task adds up its own rows and one row per entry
and task is shuffled. All rows are encoded.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RetrievalLimits
from ..session import materialize, scratch_path
from .retrieval import cell_count, knn

ENTRIES = 256  # of a codebook: a code is one byte
MAX_CHILDREN = 512  # of a top cell
MAX_CENTER_BYTES = 64 * 1024 * 1024  # of all cell centres; they are broadcast
# Rounding of float64 sums of unit vectors, far above its true size.
SLACK = 1e-9
TABLE_CELLS = 1_000_000  # estimates computed together
ROW_BYTES = 300  # of a shortlist's row in a task: twice the list is held, and sorted by copying


@dataclass
class CodeIndex:
    """The fitted part of the index; bounded by its parameters, not by the rows."""

    dim: int
    width: int  # of a sub-vector; the last is padded with zeros
    top: np.ndarray  # (top cells, dim)
    leaf: np.ndarray  # (cells, dim)
    start: np.ndarray  # children of top t: start[t] .. start[t + 1]
    books: np.ndarray  # (parts, entries, width)
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the cells; -1: no rows

    @property
    def parts(self) -> int:
        return len(self.books)


def valid_vector(col: str, dim: int | None = None) -> F.Column:
    """Neither null nor with a null, NaN or infinite component, of length ``dim``."""
    v = F.col(col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & (F.size(v) > 0) & (F.size(v) == dim if dim is not None else F.lit(True))
    return F.coalesce(fine, F.lit(False))


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"rename these columns first: {sorted(taken)}")


def _unit(column: pa.Array) -> np.ndarray:
    """The unit vectors of a list column of one width (the zero vector stays)."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    big = np.abs(x).max(axis=1, initial=0.0)[:, None]
    x = x / np.where(big == 0, 1.0, big)
    n = np.linalg.norm(x, axis=1)[:, None]
    return x / np.where(n == 0, 1.0, n)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1)[None, :] - 2.0 * (x @ centers.T), axis=1)


def _leaves(x: np.ndarray, top: np.ndarray, leaf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The cell of every row: nearest top centre, then nearest of its children."""
    at = _nearest(x, top)
    out = np.zeros(len(x), np.int64)
    for t in np.unique(at).tolist():
        rows = np.flatnonzero(at == t)
        out[rows] = start[t] + _nearest(x[rows], leaf[start[t]:start[t + 1]])
    return out


def _cut(x: np.ndarray, parts: int, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    cut = _cut(x, len(books), books.shape[2])
    return np.stack([_nearest(cut[:, j], books[j]) for j in range(len(books))], axis=1)


def _refine(sample: DataFrame, vec_col: str, centers: np.ndarray, rounds: int,
            place: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Lloyd rounds. ``place(x, centers)`` gives the entries that a row belongs
    to (rows, p) and the vectors that count there (rows, p, width)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    for _ in range(rounds):
        bc = sample.sparkSession.sparkContext.broadcast(centers)

        def run(batches):
            now = bc.value
            sums, n = np.zeros_like(now), np.zeros(len(now))
            for b in batches:
                if b.num_rows:
                    entry, v = place(_unit(b.column(0)), now)
                    np.add.at(sums, entry.ravel(), v.reshape(-1, now.shape[1]))
                    n += np.bincount(entry.ravel(), minlength=len(now))
            some = np.flatnonzero(n)
            if len(some):
                means = (sums[some] / n[some][:, None]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]),
                                                  pa.array(means, pa.list_(pa.float64()))], names=["entry", "n", "mean"])

        sums = sample.select(vec_col).mapInArrow(run, "entry bigint, n double, mean array<double>")
        means = (sums.withColumn("v", array_to_vector("mean")).groupBy("entry")
                 .agg(Summarizer.mean(F.col("v"), F.col("n")).alias("m")).select("entry", vector_to_array("m").alias("m")))
        centers = centers.copy()
        for r in means.toLocalIterator():
            centers[r["entry"]] = r["m"]
        bc.destroy()
    return centers


def _vectors(rows: DataFrame) -> np.ndarray:
    return _unit(rows.toArrow().column(0).combine_chunks())


def fit_codes(corpus: DataFrame, vec_col: str = "embedding", parts: int = 16, nlist: int | None = None,
              sample_rows: int = 50_000, rows_per_center: int = 64, rounds: int = 5, seed: int = 7) -> CodeIndex:
    """Fit cells and codebooks on about ``sample_rows`` rows, or ``rows_per_center``
    for each cell if that is more. Exact copies count once, so a hot vector takes
    one place. The width is that of the widest valid vector; rows of another
    width, and null or non-finite ones, are not indexed (``knn`` does not find
    them either)."""
    spark = corpus.sparkSession
    rows = corpus.where(valid_vector(vec_col)).select(F.col(vec_col).alias("v"))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return CodeIndex(0, 1, np.zeros((1, 0)), np.zeros((1, 0)), np.array([0, 1]), np.zeros((1, 1, 1)), np.full(1, -1.0))
    nlist = min(cell_count(n) if nlist is None else nlist, max(1, MAX_CENTER_BYTES // (8 * dim)))
    sample_rows = max(sample_rows, rows_per_center * nlist)
    some = rows.where(F.size("v") == dim)
    some = some.sample(fraction=sample_rows / n, seed=seed) if n > sample_rows else some
    some = materialize(some.distinct().withColumn("h", F.xxhash64("v", F.lit(seed))), "codes-sample")

    def first(k: int) -> np.ndarray:
        return _vectors(some.orderBy("h", "v").limit(k).select("v"))

    parts = max(1, min(parts, dim))
    width = math.ceil(dim / parts)
    parts = math.ceil(dim / width)
    heads = first(max(ENTRIES, math.isqrt(nlist - 1) + 1))
    top = _refine(some, "v", heads[:math.isqrt(nlist - 1) + 1], rounds, lambda x, c: (_nearest(x, c)[:, None], x[:, None, :]))

    # Children of a top cell: by its share of the sample, at first the rows of least hash.
    bc = spark.sparkContext.broadcast(top)

    @F.arrow_udf(T.IntegerType())
    def top_of(v: pa.Array) -> pa.Array:
        return pa.array(_nearest(_unit(v), bc.value), pa.int32())

    placed = materialize(some.withColumn("t", top_of("v")), "codes-top")
    sizes = dict(placed.groupBy("t").count().toLocalIterator())  # one row per top cell
    total = sum(sizes.values())
    wanted = [min(MAX_CHILDREN, max(1, round(nlist * sizes.get(t, 0) / total))) for t in range(len(top))]
    limit = spark.createDataFrame(list(enumerate(wanted)), "t int, wanted int")
    w = Window.partitionBy("t").orderBy("h", "v")
    chosen = (placed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MAX_CHILDREN)
              .join(F.broadcast(limit), "t").where("r <= wanted"))
    seeds: dict[int, list] = {}
    for r in chosen.select("t", "v").orderBy("t", "r").toLocalIterator():
        seeds.setdefault(r["t"], []).append(r["v"])
    groups = [_unit(pa.array(seeds[t], pa.list_(pa.float64()))) if t in seeds else top[t:t + 1] for t in range(len(top))]
    start = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    leaf = _refine(some, "v", np.concatenate(groups), rounds,
                   lambda x, c: (_leaves(x, top, c, start)[:, None], x[:, None, :]))

    # One table of all codebooks: entry e of part j is row j * entries + e.
    init = _cut(heads[:ENTRIES], parts, width).transpose(1, 0, 2)
    entries = init.shape[1]

    def place(x, c):
        books = c.reshape(parts, entries, width)
        return _codes(x, books) + np.arange(parts)[None, :] * entries, _cut(x, parts, width)

    books = _refine(some, "v", init.reshape(-1, width), rounds, place).reshape(parts, entries, width)
    return CodeIndex(dim, width, top, leaf, start, books)


def encode(corpus: DataFrame, index: CodeIndex, vec_col: str = "embedding") -> DataFrame:
    """The rows of valid vectors, all their columns and ``cell``, ``code``, ``gap``
    and ``far``; a table with columns of these names (or ``_c``) is refused."""
    _free(corpus, "cell", "code", "gap", "far", "_c")
    bc = corpus.sparkSession.sparkContext.broadcast(index)
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()),
                         T.StructField("gap", T.DoubleType()), T.StructField("far", T.DoubleType())])

    @F.arrow_udf(kind)
    def coded(v: pa.Array) -> pa.Array:
        ix = bc.value
        if not len(v):
            return pa.StructArray.from_arrays([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.float64(), pa.float64())],
                                              names=["cell", "code", "gap", "far"])
        x = _unit(v)
        cell, code = _leaves(x, ix.top, ix.leaf, ix.start), _codes(x, ix.books)
        decoded = ix.books[np.arange(ix.parts)[None, :], code].reshape(len(x), -1)[:, :ix.dim]
        raw = code.astype(np.uint8)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()),
             pa.array(np.linalg.norm(x - decoded, axis=1)), pa.array(np.linalg.norm(x - ix.leaf[cell], axis=1))],
            names=["cell", "code", "gap", "far"])

    rows = corpus.where(valid_vector(vec_col, index.dim)).withColumn("_c", coded(vec_col))
    return rows.select(*corpus.columns, "_c.cell", "_c.code", "_c.gap", "_c.far")


def measure(index: CodeIndex, coded: DataFrame) -> CodeIndex:
    """The index with the radius of every cell (one number per cell)."""
    index.radius = np.full(len(index.leaf), -1.0)
    for r in coded.groupBy("cell").agg(F.max("far").alias("far")).toLocalIterator():
        index.radius[r["cell"]] = r["far"]
    return index


def probes(questions: DataFrame, index: CodeIndex, nprobe: int, qvec_col: str = "qvec") -> DataFrame:
    """``cells``: the ``nprobe`` nearest non-empty cells, nearest first;
    ``beyond``: the most that a row of any other cell can score. A table with
    columns of these names (or ``_p``) is refused."""
    _free(questions, "cells", "beyond", "_p")
    bc = questions.sparkSession.sparkContext.broadcast(index)
    kind = T.StructType([T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("beyond", T.DoubleType())])

    @F.arrow_udf(kind)
    def nearest(v: pa.Array) -> pa.Array:
        ix = bc.value
        held = np.flatnonzero(ix.radius >= 0)
        cells, beyond = [], []
        if len(v) and len(held):
            c = ix.leaf[held]
            for x in _unit(v):
                dot = c @ x
                order = np.argsort((c * c).sum(axis=1) - 2.0 * dot, kind="stable")
                rest = order[nprobe:]
                cells.append(held[order[:nprobe]].tolist())
                beyond.append(float((dot + ix.radius[held])[rest].max(initial=-np.inf)))
        else:
            cells, beyond = [[] for _ in range(len(v))], [-np.inf] * len(v)
        return pa.StructArray.from_arrays([pa.array(cells, pa.list_(pa.int32())), pa.array(beyond, pa.float64())],
                                          names=["cells", "beyond"])

    rows = questions.where(valid_vector(qvec_col, index.dim)).withColumn("_p", nearest(qvec_col))
    return rows.select(*questions.columns, "_p.cells", "_p.beyond")


def _shortlist_fn(bc, size: int, id_type, qid_type):
    """mapInArrow over (id, cell, code, gap): each task's best ``size`` rows of
    every question by estimate (ties: smaller id), and as a row without an id the
    most that any other row of the task can score."""

    def run(batches):
        blk = bc.value
        ix, qs, probed = blk["index"], blk["mat"], blk["probed"]
        nq = len(qs)
        cut = _cut(qs, ix.parts, ix.width)
        table = np.einsum("qpw,pew->peq", cut, ix.books)  # (parts, entries, questions)
        most = np.full(nq, -np.inf)
        held, rows = [], 0

        def prune():
            nonlocal held, rows
            if not held:
                return
            cols = [np.concatenate([h[i] for h in held]) for i in range(5)]  # question, estimate, most, cell, id
            order = np.lexsort((cols[4], -cols[1], cols[0]))
            cols = [c[order] for c in cols]
            new = np.r_[True, cols[0][1:] != cols[0][:-1]]
            at = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            np.maximum.at(most, cols[0][at >= size], cols[2][at >= size])
            held, rows = [tuple(c[at < size] for c in cols)], int((at < size).sum())

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            cells = b.column(1).to_numpy(zero_copy_only=False)
            gap = b.column(3).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            for c in np.unique(cells).tolist():
                asked = np.asarray(probed.get(c, ()), np.int64)
                own = np.flatnonzero(cells == c)
                step = max(1, TABLE_CELLS // max(1, len(asked)))
                for i in range(0, len(own) if len(asked) else 0, step):
                    r = own[i:i + step]
                    est = np.zeros((len(r), len(asked)))
                    for j in range(ix.parts):
                        est += table[j][code[r, j]][:, asked]
                    top = est + gap[r][:, None]
                    keep = np.ones(est.shape, bool)
                    if len(r) > size:  # ties with the last one stay until the ids decide
                        keep = est >= -np.partition(-est, size - 1, axis=0)[size - 1][None, :]
                        np.maximum.at(most, asked, np.where(keep, -np.inf, top).max(axis=0))
                    x, y = np.nonzero(keep)
                    held.append((asked[y], est[x, y], top[x, y], np.full(len(x), c), ids[r][x]))
                    rows += len(x)
                    if rows > 2 * size * nq + 65_536:
                        prune()
        prune()
        some = np.flatnonzero(np.isfinite(most))
        q, est, top, cell, ids = held[0] if held else (np.zeros(0, np.int64),) * 5
        none = [None] * len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blk["ids"][np.r_[q, some].astype(np.int64)], qid_type), pa.array(ids.tolist() + none, id_type),
             pa.array(cell.tolist() + none, pa.int32()), pa.array(np.r_[est, np.full(len(some), -np.inf)], pa.float64()),
             pa.array(np.r_[top, most[some]], pa.float64())], names=["qid", "id", "cell", "est", "most"])

    return run


def knn_codes(coded: DataFrame, questions: DataFrame, index: CodeIndex, k: int, nprobe: int, shortlist: int,
              exact: bool = False, id_col: str = "id", vec_col: str = "embedding", qid_col: str = "qid",
              qvec_col: str = "qvec", limits: RetrievalLimits = RetrievalLimits()) -> DataFrame:
    """Top-k by cosine: (qid, rank, id, score, proven); ties go to the smaller id.

    ``coded`` is the stored output of ``encode`` (best partitioned by ``cell``,
    ``retrieval.write_ivf_corpus``); ``index`` must have its radii (``measure``).
    ``shortlist`` rows a question are scored exactly. ``proven`` says that no other
    row can belong to the answer; with ``exact`` all others are asked again with
    ``knn``, so the result is that of exact search. Questions whose vector is null,
    non-finite or of another width have no rows; question ids must be unique and
    not null. Rows without an id are not found."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = coded.sparkSession
    shortlist = max(shortlist, k)
    asked = probes(questions.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("qvec")), index, nprobe)
    asked = materialize(asked, "codes-asked")
    table = coded.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "cell", "code", "gap")
    qid_type, id_type = asked.schema["qid"].dataType, table.schema["id"].dataType
    kind = T.StructType([T.StructField("qid", qid_type), T.StructField("id", id_type), T.StructField("cell", T.IntegerType()),
                         T.StructField("est", T.DoubleType()), T.StructField("most", T.DoubleType())])
    # Of a question in a task: its vector, its table and its shortlist.
    width = 8 * (index.dim + index.parts * index.books.shape[1]) + 16 * nprobe + 64 + ROW_BYTES * shortlist
    per_block = max(1, min(limits.max_broadcast_questions, limits.max_broadcast_bytes // width))
    blocks = max(1, math.ceil(asked.count() / per_block))
    path = scratch_path(spark, "codes-shortlist")
    w = Window.partitionBy("qid").orderBy(F.col("est").desc(), F.col("id").asc_nulls_last())
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        probed: dict[int, list[int]] = {}
        for i, cells in enumerate(part["cells"]):
            for c in cells:
                probed.setdefault(int(c), []).append(i)
        mat = _unit(pa.array(part["qvec"].tolist(), pa.list_(pa.float64()))) if len(part) else np.zeros((0, index.dim))
        bc = spark.sparkContext.broadcast({"index": index, "ids": part["qid"].to_numpy(), "mat": mat, "probed": probed})
        scan = table.where(F.col("cell").isin(sorted(probed)))  # partition filter
        near = scan.mapInArrow(_shortlist_fn(bc, shortlist, to_arrow_type(id_type), to_arrow_type(qid_type)), kind)
        near = near.withColumn("r", F.row_number().over(w)).withColumn(
            "listed", F.col("id").isNotNull() & (F.col("r") <= shortlist))
        near = near.drop("r", "est")
        near.write.mode("append").parquet(path)
        bc.destroy()
    near = spark.read.schema(near.schema).parquet(path)
    listed = near.where("listed").select("qid", "id", "cell")

    # Vectors of the shortlist, from the cells it names.
    vectors = coded.select(F.col(id_col).alias("id"), "cell", F.col(vec_col).alias("v"))
    scored = vectors.join(listed, ["cell", "id"]).join(asked.select("qid", "qvec"), "qid")
    scored = scored.select("qid", "id", _cosine(F.col("v"), F.col("qvec")).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    top = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    top = materialize(top, "codes-top-k")
    rest = near.where("not listed").groupBy("qid").agg(F.max("most").alias("most"))
    last = top.groupBy("qid").agg(F.max("rank").alias("found"), F.min("score").alias("least"))
    never = F.lit(float("-inf"))
    bound = (asked.select("qid", "beyond").join(rest, "qid", "left").join(last, "qid", "left")
             .withColumn("bound", F.greatest(F.col("beyond"), F.coalesce("most", never))))
    proven = bound.select("qid", F.coalesce(
        (F.col("bound") == never) | ((F.col("found") >= k) & (F.col("least") > F.col("bound") + SLACK)), F.lit(False)).alias("proven"))
    proven = materialize(proven, "codes-proven")
    out = top.join(proven, "qid")
    if exact:
        open_ = asked.join(proven.where("not proven").select("qid"), "qid", "left_semi").select("qid", "qvec")
        again = knn(coded.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), open_, k,
                    "cosine", "id", "v", "qid", "qvec", limits=limits)
        again = again.select("qid", "id", "score", "rank", F.lit(False).alias("proven"))
        out = out.where("proven").select("qid", "id", "score", "rank", "proven").union(again)
    return out.select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), "score", "proven")


def _cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine similarity of two arrays; 0 where one is the zero vector."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def choose_probes(coded: DataFrame, questions: DataFrame, index: CodeIndex, k: int, target: float = 0.9,
                  id_col: str = "id", vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
                  max_questions: int = 1000) -> tuple[int, int, float]:
    """(nprobe, shortlist, recall): the fewest cells that hold more than ``target``
    of the exact neighbours (half-way to 1), then the shortest list, doubled from
    4 k on, that finds ``target`` of them. Measured against ``knn`` on at most
    ``max_questions`` questions (least hashes of the ids)."""
    total = questions.count()
    some = questions if total <= max_questions else questions.orderBy(F.xxhash64(qid_col), qid_col).limit(max_questions)
    some = materialize(some.select(qid_col, qvec_col).where(valid_vector(qvec_col, index.dim)), "codes-measured")
    truth = materialize(knn(coded, some, k, "cosine", id_col, vec_col, qid_col, qvec_col), "codes-truth")
    cells = int((index.radius >= 0).sum())
    order = probes(some, index, max(1, cells), qvec_col).select(qid_col, "cells")
    at = truth.select(qid_col, id_col).join(coded.select(id_col, "cell"), id_col).join(order, qid_col)
    places = dict(at.groupBy(F.array_position("cells", F.col("cell")).alias("place")).count().toLocalIterator())
    found, all_found = 0, sum(places.values())
    if not all_found:
        return max(1, cells), 4 * k, 1.0
    nprobe = 0
    while nprobe < cells and found < all_found * (1 + target) / 2:
        nprobe += 1
        found += places.get(nprobe, 0)
    most = coded.count()
    size = 4 * k
    while True:
        got = knn_codes(coded, some, index, k, nprobe, size, False, id_col, vec_col, qid_col, qvec_col)
        recall = truth.join(got.select(qid_col, id_col), [qid_col, id_col], "left_semi").count() / all_found
        if recall >= target or (size >= most and nprobe >= cells):
            return nprobe, size, recall
        size, nprobe = (2 * size, nprobe) if size < most else (size, min(cells, 2 * nprobe))
