"""Vector code compression with integer Walsh-Hadamard elimination.

A vector is cut into equal parts, and every part position has a codebook of
integer entries. The nearest entry is found in the Walsh-Hadamard domain: parts
and entries are padded with zeros to a power of two, p, and transformed by
additions alone. The transform multiplies every squared distance by p exactly,
so sums of squared coefficient differences, added in sequency order, are lower
bounds of p times the distance, and the last one is p times the distance
itself. An entry is given up as soon as its sum exceeds the best complete one.
All numbers are integers; nothing is rounded.

The codebooks are the driver's whole state (parts x entries x part width
numbers). A round is one map pass that keeps sums per part position and entry
in the task and one aggregate of at most parts x entries rows per task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Vectors compared at a time (times entries, one sum each).
BLOCK = 2_048
MAX_LONG = (1 << 63) - 1


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of the rows, in sequency order. Rows are
    padded with zeros to a power of two."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(x), width), np.int64)
    out[:, :x.shape[1]] = x
    half = 1
    while half < width:
        pairs = out.reshape(len(x), width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return out[:, sequency(width)]


def sequency(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    i, j = np.arange(width)[:, None], np.arange(width)[None, :]
    sign = np.bitwise_count(i & j) & 1
    return np.argsort((sign[:, 1:] != sign[:, :-1]).sum(axis=1), kind="stable")


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry; ties go to the
    lower entry."""
    have, ours = walsh(entries), walsh(x)
    width, n = have.shape[1], len(x)
    sums = (ours[:, :1] - have[None, :, 0]) ** 2
    # The entry that starts best bounds the rest.
    guess = sums.argmin(axis=1)
    best = ((ours - have[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    left = sums[row, entry]
    for j in range(1, width):
        left = left + (ours[row, j] - have[entry, j]) ** 2
        alive = left <= best[row]
        row, entry, left = row[alive], entry[alive], left[alive]
    order = np.lexsort((entry, left, row))
    first = order[np.searchsorted(row[order], np.arange(n))]
    return entry[first], left[first] // width


def _bound(dims: int, width: int) -> int:
    """Components of this size keep all sums below 2^62."""
    padded = 1 << max(width - 1, 0).bit_length()
    return math.isqrt((1 << 60) // max(dims, padded * padded))


def coded_vectors(column: pa.Array, dims: int, scale: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers of the rows that can be coded; the numbers of those rows, and of
    the finite rows of another length."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy()
    flat = pc.cast(column.flatten(), pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    finite = np.isfinite(flat)
    fine = (size >= 0) & (np.bincount(owner[~finite], minlength=len(size)) == 0)
    coded = fine & (size == dims)
    values = flat[coded[owner]].reshape(-1, dims)
    whole = np.floor(np.clip(values * scale, -bound, bound)).astype(np.int64)
    return whole, np.flatnonzero(coded), np.flatnonzero(fine & ~coded)


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) per row and part position."""
    parts, _, width = books.shape
    entry, d = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for at in range(0, len(x), BLOCK):
        for p in range(parts):
            own = x[at:at + BLOCK, p * width:(p + 1) * width]
            entry[at:at + BLOCK, p], d[at:at + BLOCK, p] = nearest_entries(own, books[p])
    return entry, d


def first_books(vectors: DataFrame, entries: int, parts: int, dims: int, scale: int, bound: int) -> np.ndarray:
    """Codebooks from the vectors with the smallest ids (null ids last; equal
    ids by their components)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x, rows, _ = coded_vectors(b.column(2), dims, scale, bound)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))],
                                             names=["id", "x"])

    kind = dict(vectors.dtypes)["id"]
    top = (vectors.mapInArrow(run, f"id {kind}, x array<bigint>").orderBy(F.asc_nulls_last("id"), "x")
           .limit(entries).select("id", "x").collect())
    found = np.array([r["x"] for r in top], np.int64).reshape(len(top), parts, dims // parts)
    return found.transpose(1, 0, 2)


def next_books(vectors: DataFrame, books: np.ndarray, dims: int, scale: int, bound: int) -> np.ndarray:
    """Floor of the mean of the parts assigned to each entry; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width), np.int64)
        n = np.zeros(parts * entries, np.int64)
        for b in batches:
            x, _, _ = coded_vectors(b.column(2), dims, scale, bound)
            cell = (_assigned(x, books)[0] + np.arange(parts) * entries).ravel()
            np.add.at(sums, cell, x.reshape(-1, width))
            n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            names=["cell", "n", "s"])

    partial = vectors.mapInArrow(run, "cell bigint, n bigint, s array<bigint>")
    total = partial.groupBy("cell").agg(F.sum("n").alias("n"), *[
        F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
    out = books.copy()
    for r in total.collect():  # at most parts x entries rows
        out[r["cell"] // entries, r["cell"] % entries] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
                     dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label") -> DataFrame:
    """One row per vector that is kept: vec_id, code (two hex digits per part),
    error (squared distance to the coded vector), label_error (error summed over
    the rows of the label; nulls are one label), codebooks_sha256 (of all final
    entries' components in decimal, by part, entry and place).

    Vectors that are null or hold a null, NaN or infinite component go. Vectors
    of another length than ``dims`` stay, with null code and error, and take no
    part in the codebooks. Components are cut to a bound (2^27 at 64 dimensions)
    that keeps every sum in a long, label sums to the largest long. Repeated rows
    stay repeated and count as often. With fewer vectors than ``entries`` the
    codebooks are smaller; an empty table gives an empty result. Other columns
    are not read, whatever their names. ``vectors`` is read once per round and
    twice more."""
    if dims % parts or not 1 <= entries <= 256 or rounds < 0:
        raise ValueError("dims must be a multiple of parts, entries 1 to 256, rounds at least 0")
    scratch = Scratch(vectors.sparkSession, "codes")
    bound = _bound(dims, dims // parts)
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                            F.col(vector_col).cast("array<double>").alias("v"))
    books = first_books(narrow, entries, parts, dims, scale, bound)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_books(narrow, books, dims, scale, bound)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x, coded, other = coded_vectors(b.column(2), dims, scale, bound)
            entry, d = _assigned(x, books) if len(x) else (np.empty((0, parts), np.int64),) * 2
            code = ["".join(r) for r in digits[entry].tolist()] + [None] * len(other)
            error = [int(e) for e in d.sum(axis=1)] + [None] * len(other)
            rows = pa.array(np.concatenate([coded, other]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(code, pa.string()),
                                              pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(narrow.dtypes)
    rows = scratch.write(narrow.mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error bigint"),
                         "codes")
    total = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(
        F.col("label").alias("_label"), F.when(F.col("s") > MAX_LONG, F.lit(MAX_LONG)).otherwise(F.col("s").cast("long")).alias("label_error"))
    named = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(total, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(named).alias("codebooks_sha256"))


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dims: int = 64) -> str:
    """DuckDB SQL for ``compress_vectors`` over ``embeddings``: plain distances."""
    width = dims // parts

    def assign(i: int) -> str:
        return f"""d{i} AS MATERIALIZED (
  SELECT x.rid, x.p, c.e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
  FROM long x JOIN b{i} c ON x.p = c.p AND x.j = c.j GROUP BY x.rid, x.p, c.e),
a{i} AS MATERIALIZED (SELECT rid, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM d{i} GROUP BY rid, p)"""

    def move(i: int) -> str:
        return f"""m{i} AS (
  SELECT a.p, a.e, x.j, sum(x.v) AS s, count(*) AS n FROM long x JOIN a{i} a ON x.rid = a.rid AND x.p = a.p
  GROUP BY a.p, a.e, x.j),
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, CAST(CASE WHEN m.n IS NULL THEN b.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v
  FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""

    steps = [f"{assign(i)},\n{move(i)}" for i in range(rounds)] + [assign(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
flat AS (SELECT rid, unnest(generate_series(0, {dims - 1})) AS i, unnest(v) AS v FROM kept WHERE len(v) = {dims}),
long AS MATERIALIZED (SELECT rid, i // {width} AS p, i % {width} AS j, v FROM flat),
start AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept WHERE len(v) = {dims} ORDER BY e LIMIT {entries}),
b0 AS MATERIALIZED (SELECT x.p, s.e, x.j, x.v FROM start s JOIN long x USING (rid)),
{(',' + chr(10)).join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
named AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds})
SELECT kept.vec_id, c.code, c.error,
  CAST(sum(c.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, named.codebooks_sha256
FROM kept LEFT JOIN coded c USING (rid) CROSS JOIN named"""
