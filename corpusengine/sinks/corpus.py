"""Corpus table writes: idempotent upsert by id.

A stored corpus is one plain Parquet table, partitioned by the caller's columns
and by ``load``, the label of the batch that wrote the rows (a day's date):

    corpus/fiscalYear=2024/load=2024-12-23/part-...

A batch overwrites only its own partitions (dynamic partition overwrite), so a
day costs a day and a batch that is sent again replaces itself. Readers take one
scan and keep, per replace key, the rows of the greatest label that has it.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD = "load"
# Rows of one file (the batch size of A11 only counts batches).
ROWS_PER_FILE = 1_000_000


def dedupe_last(incoming: DataFrame, key: str, order_col: str) -> DataFrame:
    """Last-wins de-duplication on ``key`` (highest ``order_col``), as a
    grouped max_by so a repeated key is reduced before the shuffle."""
    others = [c for c in incoming.columns if c != key]
    packed = incoming.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return packed.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: str = "chunk_id",
    order_col: str = "version",
    replace_by: list[str] | None = None,
) -> DataFrame:
    """New table after upserting ``incoming`` into ``existing``.

    merge (default): rows of ``existing`` whose key is re-sent are replaced.
    ``replace_by``: every existing row sharing those columns with an incoming
    row is dropped first (a re-ingested filing with fewer chunks leaves no
    stale tail ids). The anti join is planned by Catalyst/AQE (broadcast of
    the incoming keys when they are small, shuffle otherwise)."""
    new = dedupe_last(incoming, key, order_col)
    if replace_by:
        keys = new.select(*replace_by).distinct()
        kept = existing.join(keys, replace_by, "left_anti")
    else:
        kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def batch_count(n_rows: int, batch_size: int) -> int:
    """Number of write batches; empty input -> 0."""
    return 0 if n_rows == 0 else math.ceil(n_rows / batch_size)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _has_data(spark: SparkSession, path: str) -> bool:
    """Whether a written folder holds data (a partitioned write of no rows
    leaves only its marker)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return any(not f.getPath().getName().startswith(("_", ".")) for f in found)


def write_load(df: DataFrame, path: str, load: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as the rows of one load: its partitions replace those of an
    earlier run of the same load, all others are left alone."""
    (df.withColumn(LOAD, F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*(partition_by or []), LOAD).parquet(path))


def read_loads(spark: SparkSession, path: str, where=None) -> DataFrame | None:
    """All rows of all loads in one scan, ``load`` as a string; None if there are
    none. ``where`` may restrict partitions."""
    if not path_exists(spark, path) or not _has_data(spark, path):
        return None
    rows = spark.read.option("mergeSchema", True).parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.withColumn(LOAD, F.col(LOAD).cast("string"))


def upsert_corpus(incoming: DataFrame, corpus_dir: str, load: str, key: str = "chunk_id", order_col: str = "version",
                  partition_by: list[str] | None = None) -> None:
    """Store the last-wins rows of ``incoming`` as ``load``. Labels are compared
    as text, the greater is the later (ISO dates are)."""
    write_load(dedupe_last(incoming, key, order_col).select(*incoming.columns), corpus_dir, load, partition_by)


def read_corpus(spark: SparkSession, corpus_dir: str, replace_by: list[str] | None = None, key: str = "chunk_id",
                where=None) -> DataFrame | None:
    """Current view of a stored corpus, or None if nothing was stored.

    ``replace_by`` (default: the key): the columns whose latest load counts; a
    re-sent filing with fewer chunks leaves no stale tail. The latest load of a
    key is a grouped max (combined before its shuffle). ``where`` restricts both
    sides to partitions before the view is made."""
    rows = read_loads(spark, corpus_dir, where)
    if rows is None:
        return None
    keys = replace_by or [key]
    latest = rows.groupBy(*keys).agg(F.max(LOAD).alias(LOAD))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*keys, LOAD)]
    return rows.alias("r").join(latest.alias("l"), on, "left_semi").drop(LOAD)
