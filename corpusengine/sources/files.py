"""Readers for landed files (S1, S2, S4-S10) and their column-level parsers.

Inputs are files landed by an external fetcher (the engine does no HTTP).
Every reader uses an explicit schema; whole-file formats are read with
``wholetext`` so each file is one row, and the file name comes from the
``_metadata`` column.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ARTIFACT_MARKER, DAILY_FORMS, SECTION_NAME
from ..functions.filings import cik10
from ..functions.text import strip_ws
from ..operators.filings import INDEX_FIELDS, filter_forms, parse_master_index

COMPANY_LIST = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("cik_str", T.LongType()), T.StructField("ticker", T.StringType()),
                  T.StructField("title", T.StringType())]),
)
RECENT = T.StructType([T.StructField(f, T.ArrayType(T.StringType()))
                       for f in ("form", "accessionNumber", "primaryDocument", "filingDate")])
SUBMISSIONS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("filings", T.StructType([T.StructField("recent", RECENT)])),
])
SUBMISSIONS_ROW = T.StructType([T.StructField("cik", T.StringType()), *SUBMISSIONS.fields])
FILING_INDEX = T.StructType([
    T.StructField("directory", T.StructType([
        T.StructField("item", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))
    ]))
])
MANIFEST = T.StructType([
    T.StructField("cik", T.StringType()), T.StructField("company", T.StringType()),
    T.StructField("form", T.StringType()), T.StructField("filingDate", T.StringType()),
    T.StructField("accessionNumber", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("primary", T.StringType()), T.StructField("section", T.StringType()),
    T.StructField("chunks", T.LongType()), T.StructField("embedding_model", T.StringType()),
])

# Fixed value: artifact file-name pattern date__cik__company__form__acc.txt
ARTIFACT_NAME_RE = r"^(\d{4}-\d{2}-\d{2})__(\d+)__(.+?)__(10-K(?:[/-]A)?)__([^/\\]+)\.txt$"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``, whatever folders (loads) hold it."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )


# --- S1 ----------------------------------------------------------------------

def parse_company_list(text: Column) -> Column:
    """array<string> of company ids from a JSON object keyed by ordinal."""
    m = F.from_json(text, COMPANY_LIST)
    return F.transform(F.map_values(m), lambda v: v["cik_str"].cast("string"))


def read_company_list(spark: SparkSession, path: str) -> DataFrame:
    return _whole_files(spark, path).select(F.explode(parse_company_list(F.col("text"))).alias("cik"))


# --- S2 / S3 -------------------------------------------------------------------

def cik_from_submissions_name(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"CIK0*([0-9]+)\.json$", 1)


def submissions_file_name(cik: Column) -> Column:
    return F.concat(F.lit("CIK"), cik10(cik), F.lit(".json"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """cik (from the file name), name, filings — one row per company file."""
    files = _whole_files(spark, path)
    j = F.from_json(F.col("text"), SUBMISSIONS)
    return files.select(cik_from_submissions_name(F.col("file_name")).alias("cik"), j["name"].alias("name"),
                        j["filings"].alias("filings"))


# --- S4 ----------------------------------------------------------------------

def parse_filing_index(text: Column) -> Column:
    """array<string> of item names of a filing directory listing."""
    j = F.from_json(text, FILING_INDEX)
    return F.transform(F.coalesce(j["directory"]["item"], F.array()), lambda it: it["name"])


def read_filing_index(spark: SparkSession, path: str, key_re: str = r"([^/]+)/index\.json$") -> DataFrame:
    """(key, pos, name) per listed item; key from the file path."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), key_re, 1).alias("key"), F.col("value").alias("text")
    )
    return files.select("key", F.posexplode(parse_filing_index(F.col("text"))).alias("pos", "name"))


# --- S5 ----------------------------------------------------------------------

def read_filing_html(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, html): one row per landed document below ``path``."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("html")
    )


# --- S6 / S7 -----------------------------------------------------------------

def daily_index_path(landing_dir: str, d) -> str:
    q = (d.month - 1) // 3 + 1
    return os.path.join(landing_dir, str(d.year), f"QTR{q}", f"master.{d.strftime('%Y%m%d')}.idx")


def read_daily_index(spark: SparkSession, landing_dir: str, d, forms=DAILY_FORMS) -> DataFrame:
    """Rows of the daily index of date ``d`` with the wanted forms; a missing
    file gives an empty DataFrame with the same schema (weekend, holiday)."""
    path = daily_index_path(landing_dir, d)
    schema = "file_date string, line_no bigint, " + ", ".join(f"{c} string" for c in INDEX_FIELDS)
    raw = _read_text_or_none(spark, path, wholetext=True)
    if raw is None:
        return spark.createDataFrame([], schema)
    files = raw.select(F.lit(d.isoformat()).alias("file_date"), F.col("value").alias("text"))
    return filter_forms(parse_master_index(files), forms)


def _read_text_or_none(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame | None:
    """spark.read.text, or None when the path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=wholetext)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


# --- S8 ----------------------------------------------------------------------

def parse_manifest_line(line: Column) -> Column:
    """Struct of manifest fields; bad or non-object lines give null fields."""
    return F.from_json(line, MANIFEST)


def read_seen_accessions(spark: SparkSession, path: str) -> DataFrame:
    """A3: distinct non-blank accessions of a JSON-lines manifest; a missing
    manifest is an empty set."""
    lines = _read_text_or_none(spark, path)
    if lines is None:
        return spark.createDataFrame([], "accessionNumber string")
    acc = parse_manifest_line(F.col("value"))["accessionNumber"]
    return lines.select(acc.alias("accessionNumber")).where(
        F.col("accessionNumber").isNotNull() & (F.col("accessionNumber") != "")
    ).distinct()


# --- S9 ----------------------------------------------------------------------

def parse_artifact(name: Column, text: Column) -> Column:
    """Struct(cik, company, form, filingDate, accessionNumber, section,
    fiscalYear, body) or null when the name does not match."""
    ok = name.rlike(ARTIFACT_NAME_RE)
    parts = F.split(text, "\\Q" + ARTIFACT_MARKER + "\\E", 2)
    body = F.when(F.size(parts) > 1, strip_ws(F.get(parts, 1))).otherwise(text)
    g = lambda i: F.regexp_extract(name, ARTIFACT_NAME_RE, i)
    return F.when(
        ok,
        F.struct(
            g(2).alias("cik"), g(3).alias("company"), g(4).alias("form"), g(1).alias("filingDate"),
            g(5).alias("accessionNumber"), F.lit(SECTION_NAME).alias("section"),
            F.substring(g(1), 1, 4).cast("int").alias("fiscalYear"), body.alias("body"),
        ),
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    files = _whole_files(spark, path)
    parsed = files.select(parse_artifact(F.col("file_name"), F.col("text")).alias("a")).where("a IS NOT NULL")
    return parsed.select("a.*")


# --- S10 ---------------------------------------------------------------------

def open_corpus(spark: SparkSession, corpus_dir: str, replace_by: list[str] | None = None) -> DataFrame | None:
    """The current view of a corpus table (see sinks.corpus), None if empty."""
    from ..sinks.corpus import read_corpus

    return read_corpus(spark, corpus_dir, replace_by)
