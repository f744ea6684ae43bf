"""Chunking of long texts and deterministic chunk ids.

``chunk_fixed`` is native (sequence + substring, no Python). ``chunk_recursive``
follows the separator-descending contract (blank line, newline, space,
character) and runs as an Arrow-batched pandas UDF; only the per-text split is
Python, partitioning and the explode stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")

CHUNK_SPAN = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
)


def fixed_chunk_count(length: Column, size: int, overlap: int) -> Column:
    """Number of fixed windows of ``size`` stepping ``size - overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    return (
        F.when(length.isNull() | (length <= 0), F.lit(0))
        .when(length <= size, F.lit(1))
        .otherwise(F.ceil((length - F.lit(overlap)) / F.lit(step)).cast("int"))
    )


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<string> of fixed windows; every window but the last is ``size`` long
    and consecutive windows share ``overlap`` characters."""
    step = size - overlap
    n = fixed_chunk_count(F.length(text), size, overlap)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, size))


def chunk_fixed(
    df: DataFrame,
    text_col: str,
    size: int,
    overlap: int,
    ix_col: str = "chunk_ix",
    chunk_col: str = "chunk",
) -> DataFrame:
    """One row per fixed window, with a 0-based index; other columns kept."""
    keep = [c for c in df.columns if c != text_col]
    arr = fixed_chunks(F.col(text_col), size, overlap)
    return df.select(*keep, F.posexplode(arr).alias(ix_col, chunk_col))


def chunk_id(*parts: Column) -> Column:
    """Deterministic id: sha1 hex of the parts joined by '__'."""
    return F.sha1(F.concat_ws("__", *[p.cast("string") for p in parts]))


# ---------------------------------------------------------------------------
# Recursive splitting (Python helper used inside an Arrow batch).
# ---------------------------------------------------------------------------

def _pieces(text: str, start: int, end: int, sep: str) -> list[tuple[int, int]]:
    """Split text[start:end] at non-overlapping occurrences of sep, keeping the
    separator at the start of the following piece; empty pieces dropped."""
    if sep == "":
        return [(k, k + 1) for k in range(start, end)]
    out = []
    cut = start
    pos = text.find(sep, start, end)
    while pos != -1:
        if pos > cut:
            out.append((cut, pos))
        cut = pos
        nxt = text.find(sep, pos + len(sep), end)
        pos = nxt
    if end > cut:
        out.append((cut, end))
    return out


def _strip_span(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return s, e


def _merge(text, spans, size, overlap, out, length):
    current: list[tuple[int, int]] = []
    total = 0
    for s, e in spans:
        n = length(text[s:e])
        if total + n > size and current:
            cs, ce = _strip_span(text, current[0][0], current[-1][1])
            if ce > cs:
                out.append((cs, ce))
            while current and (total > overlap or total + n > size):
                ps, pe = current.pop(0)
                total -= length(text[ps:pe])
        current.append((s, e))
        total += n
    if current:
        cs, ce = _strip_span(text, current[0][0], current[-1][1])
        if ce > cs:
            out.append((cs, ce))


def _split(text, start, end, seps, size, overlap, out, length):
    chosen, rest = seps[-1], ()
    for i, sep in enumerate(seps):
        if sep == "":
            chosen, rest = "", ()
            break
        if text.find(sep, start, end) != -1:
            chosen, rest = sep, tuple(seps[i + 1:])
            break
    good: list[tuple[int, int]] = []
    for s, e in _pieces(text, start, end, chosen):
        if length(text[s:e]) < size:
            good.append((s, e))
            continue
        if good:
            _merge(text, good, size, overlap, out, length)
            good = []
        if rest:
            _split(text, s, e, rest, size, overlap, out, length)
        else:
            out.append((s, e))
    if good:
        _merge(text, good, size, overlap, out, length)


def recursive_spans(
    text: str | None,
    size: int,
    overlap: int,
    separators: tuple[str, ...] = DEFAULT_SEPARATORS,
    length: Callable[[str], int] = len,
) -> list[tuple[int, int]]:
    """Character spans [start, end) of the recursive chunks of ``text``."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    _split(text, 0, len(text), tuple(separators), size, overlap, out, length)
    return out


def recursive_span_array(
    text: Column,
    size: int,
    overlap: int,
    separators: tuple[str, ...] = DEFAULT_SEPARATORS,
    length: Callable[[str], int] = len,
) -> Column:
    """array<struct<start,end>> of recursive chunks (0-based offsets). Only
    offsets come back from Python; the texts are cut in the JVM."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    seps = tuple(separators)

    @F.pandas_udf(CHUNK_SPAN)
    def _spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in recursive_spans(t, size, overlap, seps, length)]
                          for t in texts])

    return _spans(text)


def chunk_recursive(
    df: DataFrame,
    text_col: str,
    size: int,
    overlap: int,
    ix_col: str = "chunk_ix",
    chunk_col: str = "chunk",
    with_offsets: bool = False,
    separators: tuple[str, ...] = DEFAULT_SEPARATORS,
    length: Callable[[str], int] = len,
) -> DataFrame:
    """One row per recursive chunk with 0-based index; other columns kept.
    ``length`` measures pieces and chunks (X3; characters by default)."""
    keep = [c for c in df.columns if c != text_col]
    spans = recursive_span_array(F.col(text_col), size, overlap, separators, length)
    cut = F.transform(spans, lambda x: F.struct(
        F.substring(F.col(text_col), x["start"] + 1, x["end"] - x["start"]).alias("chunk"), x["start"].alias("start"),
        x["end"].alias("end")))
    out = df.select(*keep, F.posexplode(cut).alias(ix_col, "_c"))
    cols = [*keep, ix_col, F.col("_c.chunk").alias(chunk_col)]
    if with_offsets:
        cols += [F.col("_c.start").alias("chunk_start"), F.col("_c.end").alias("chunk_end")]
    return out.select(*cols)
