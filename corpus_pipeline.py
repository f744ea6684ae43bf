"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. A runner may write each result as Parquet and hand
the re-read table to the next stage; ``run`` does exactly that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusengine.llm import decontam, packing, quality_kn, queries, secrets, simhash
from corpusengine.llm.common import Scratch, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is too high go."""
    return quality_kn.keep_ordinary(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked in place; all documents stay."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into training sequences."""
    return packing.pack(docs, queries.packing_tokenizer())


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact),
    ("best_fit_packing", pack),
]

# Model training and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = done
    return docs
