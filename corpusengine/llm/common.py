"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A whole input table; naming columns keeps the Parquet schema narrow."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


class Scratch:
    """Written tables below the shared checkpoint folder.

    Cutting lineage with a Parquet table (not a local checkpoint) survives a
    lost executor, is compressed, and reads back only the columns asked for.
    One folder per operator call; a table that is no longer needed is dropped.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = os.path.join(ensure_checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path is None:
            return
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sheltered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed by place (in0, in1, ...), so that no name of
    the caller's meets an internal one."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The sheltered name of a column of ``df``."""
    return f"in{df.columns.index(column)}"


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in order and under their names, of a table that
    was made from the sheltered ``like``."""
    return df.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(like.columns)])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (null stays null).

    ``lower`` is exact and cheap on texts of ASCII characters alone; only
    other texts pay for ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def same_row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart without a row number: rows that agree in
    all of them have the same id and the same text, hence the same result."""
    t = F.coalesce(text, F.lit(""))
    return [doc_id.alias("_id"), F.xxhash64(t).alias("_h1"), F.hash(t, F.length(t)).alias("_h2"),
            text.isNull().alias("_nul")]
