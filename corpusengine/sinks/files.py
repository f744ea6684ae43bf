"""Artifact and manifest sinks (K1, K2, F20, F21) and upload corpora (K4, K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ARTIFACT_MARKER
from ..functions.filings import artifact_name
from ..sources.files import read_seen_accessions
from .corpus import path_exists


def artifact_text(company: Column, cik: Column, form: Column, filing_date: Column, accession: Column,
                  url: Column, risk_text: Column) -> Column:
    """three header lines, a blank line, the marker, a blank line, text."""
    return F.concat(
        company, F.lit(" (CIK "), cik, F.lit(") | "), form, F.lit("\nFiling Date: "), filing_date,
        F.lit(" | Accession: "), accession, F.lit("\nURL: "), url,
        F.lit("\n\n" + ARTIFACT_MARKER + "\n\n"), risk_text,
    )


def artifact_frame(df: DataFrame, text_col: str = "section") -> DataFrame:
    """K1 as columns: artifact_name (file-safe) and artifact_text."""
    c = F.col
    return df.select(
        "*",
        artifact_name(c("filingDate"), c("cik"), c("company"), c("form"), c("accessionNumber")).alias("artifact_name"),
        artifact_text(c("company"), c("cik"), c("form"), c("filingDate"), c("accessionNumber"), c("url"),
                      c(text_col)).alias("artifact_text"),
    )


def write_artifacts(df: DataFrame, path: str) -> None:
    """Artifacts as a Parquet table partitioned by filing year. Names already
    written (in the same years) are passed over, so a run that is repeated after
    a failure adds nothing twice."""
    spark = df.sparkSession
    new = df.select(F.substring("filingDate", 1, 4).alias("filingYear"), "filingDate", "artifact_name", "artifact_text")
    new = new.dropDuplicates(["filingYear", "artifact_name"])
    if path_exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).select("filingYear", "artifact_name")
        new = new.join(old, ["filingYear", "artifact_name"], "left_anti")
    new.repartition("filingYear", F.pmod(F.xxhash64("artifact_name"), F.lit(8))).write.mode("append").partitionBy(
        "filingYear").parquet(path)


def manifest_json(df: DataFrame) -> Column:
    """one JSON line per row (non-ASCII kept)."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def append_manifest(manifest: DataFrame, path: str) -> None:
    """K2: append manifest rows as JSON lines, but for accessions that the
    manifest holds already."""
    spark = manifest.sparkSession
    if path_exists(spark, path):
        manifest = manifest.join(read_seen_accessions(spark, path), "accessionNumber", "left_anti").select(*manifest.columns)
    manifest.write.mode("append").json(path)


def append_run(df: DataFrame, path: str, run_date: str) -> None:
    """K6: keep a run's table (records, skips) under its date."""
    df.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def upload_corpus(chunks: DataFrame, corpus_label: str = "upload") -> DataFrame:
    """K4: tag the chunks of an uploaded document as a separate corpus."""
    return chunks.withColumn("corpus", F.lit(corpus_label))


def clear_upload(corpus: DataFrame, corpus_label: str = "upload") -> DataFrame:
    """K5: drop the uploaded corpus."""
    return corpus.where(F.col("corpus") != corpus_label)
