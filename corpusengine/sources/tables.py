"""Readers for the Parquet tables the engine works on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows carry CPU-heavy payloads (long texts, vectors).
HEAVY_TABLES = frozenset({"documents", "pages", "embeddings"})
HEAVY_COLUMNS = frozenset({"text", "html", "embedding"})


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


# Largest scan (bytes of files) that is spread; see spread_partitions.
MAX_SPREAD_BYTES = 256 * 1024 * 1024


def spread_partitions(df: DataFrame) -> DataFrame:
    """Spread a small, under-split scan over the available cores.

    A Parquet file with one row group is read by one task; for CPU-heavy rows
    (regex text work, vector scoring) that task would do all the work. Only
    scans of at most ``MAX_SPREAD_BYTES`` are redistributed, so the exchange
    is bounded whatever the cluster; larger inputs are split by the session's
    ``spark.sql.files.maxPartitionBytes`` and never shuffled here."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > MAX_SPREAD_BYTES:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()  # planning only for a plain scan
    return df.repartition(want) if have < want else df


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str,
               spread: bool | None = None) -> DataFrame:
    """Parquet scan of one table; naming columns keeps ReadSchema narrow.
    Small under-split scans of heavy columns are spread over the cores."""
    df = spark.read.parquet(table_path(base_dir, name))
    df = df.select(*columns) if columns else df
    if spread is None:
        spread = name in HEAVY_TABLES and (not columns or not HEAVY_COLUMNS.isdisjoint(columns))
    return spread_partitions(df) if spread else df
