"""Daily incremental run (T1-T4, J1, J2, W3, P13, A6, A8) over landed files.

Layout under ``landing_dir`` (written by an external fetcher, by date, so a
day's run opens the files of its day alone):
    daily-index/YYYY/QTRq/master.YYYYMMDD.idx
    submissions/YYYYMMDD/CIK##########.json   (companies of that day)
    filings/YYYYMMDD/<accessionNumber>/<document or index.json>
State under ``state_dir`` (shared storage):
    manifest/ (JSON lines)   artifacts/, records/, skips/ (Parquet)
    corpus/   (partitioned by fiscalYear and day; see sinks.corpus)
    counts/   (one row per day: chunks written; the totals are its sum)

The whole day is one plan: index rows -> first matching submission -> seen
check -> main document -> ingest -> corpus, artifacts, manifest. Nothing
is looped per filing on the driver; only one-row summaries are collected.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IngestConfig
from ..operators import filings as fo
from ..session import materialize
from ..sinks import corpus as sc
from ..sinks import files as sf
from ..sources import files as src
from . import ingest as ing


CORPUS_PARTITION = "fiscalYear"


CORPUS_KEY = ["cik", "accessionNumber"]


def _paths(landing_dir: str, state_dir: str, d: dt.date) -> dict[str, str]:
    day = d.strftime("%Y%m%d")
    return {
        "daily": os.path.join(landing_dir, "daily-index"),
        "subs": os.path.join(landing_dir, "submissions", day),
        "html": os.path.join(landing_dir, "filings", day),
        **{n: os.path.join(state_dir, n) for n in ("manifest", "corpus", "counts", "artifacts", "records", "skips")},
    }


def landed_html(spark: SparkSession, html_dir: str) -> DataFrame:
    """(accessionNumber, primary, html) from <accession>/<document> anywhere below
    ``html_dir`` (the committed writer puts a load's folder in between)."""
    if not sc.path_exists(spark, html_dir):
        return spark.createDataFrame([], "accessionNumber string, primary string, html string")
    raw = src.read_filing_html(spark, html_dir)
    out = raw.select(
        F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("accessionNumber"),
        F.regexp_extract("file_path", r"/([^/]+)$", 1).alias("primary"),
        "html",
    )
    return out.where(F.col("primary") != "index.json")


def landed_listings(spark: SparkSession, html_dir: str) -> DataFrame:
    """(accessionNumber, pos, name) of the landed directory listings."""
    none = spark.createDataFrame([], "accessionNumber string, pos int, name string")
    if not sc.path_exists(spark, html_dir):
        return none
    files = spark.read.option("pathGlobFilter", "index.json").option("recursiveFileLookup", True)
    text = files.text(html_dir, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/index\.json$", 1).alias("accessionNumber"),
        F.col("value").alias("text"))
    return text.select("accessionNumber", F.posexplode(src.parse_filing_index(F.col("text"))).alias("pos", "name"))


def date_in_corpus(spark: SparkSession, corpus_dir: str, d: dt.date) -> bool:
    """Is there any corpus row filed on ``d`` (either format)? Only
    the partition of its fiscal year is read."""
    corpus = sc.read_corpus(spark, corpus_dir, CORPUS_KEY, where=F.col(CORPUS_PARTITION) == d.year)
    if corpus is None:
        return False
    hit = corpus.where(F.col("filingDate").isin(d.strftime("%Y-%m-%d"), d.strftime("%Y%m%d")))
    return not hit.limit(1).isEmpty()


def run_daily(
    spark: SparkSession,
    landing_dir: str,
    state_dir: str,
    target_date: dt.date | None = None,
    cfg: IngestConfig = IngestConfig(),
    embed: Callable[[DataFrame, str], DataFrame] | None = None,
    embedding_model: str | None = None,
    chunker: str = "recursive",
) -> dict:
    """Ingest one day; returns the A6 summary as a dict. ``embedding_model``
    names what ``embed`` does, for the manifest."""
    d = target_date or (dt.date.today() - dt.timedelta(days=1))
    p = _paths(landing_dir, state_dir, d)
    rows = src.read_daily_index(spark, p["daily"], d)
    found = rows.count()
    if found == 0:
        return {"date": d.isoformat(), "found": 0, "status": "no_index_rows",
                "already_in_corpus": date_in_corpus(spark, p["corpus"], d)}

    subs = src.read_submissions(spark, p["subs"]) if sc.path_exists(spark, p["subs"]) else spark.createDataFrame(
        [], src.SUBMISSIONS_ROW)
    seen = src.read_seen_accessions(spark, p["manifest"])
    matched = fo.match_first_submission(rows, fo.flatten_submissions(subs))
    # Written once: the fetch list, the status and the skips read it.
    prepared = materialize(fo.prepare_daily(matched, seen).withColumn("input_pos", F.col("line_no")), "prepared")
    provided = prepared.where(F.col("status") == "provided").select(
        "input_pos", "cik", "accessionNumber", "primaryDocument",
        F.col("date_filed").alias("filingDate"), "form", "company",
    )
    missed = prepared.where(F.col("status") == "skip").select("cik", "reason")
    counts = prepared.groupBy().agg(
        F.sum(F.when(F.col("status") == "provided", 1).otherwise(0)).alias("prepared"),
        F.sum(F.when(F.col("status") == "skip", 1).otherwise(0)).alias("missed"),
        F.count(F.when(F.col("reason") == "already_seen", 1)).alias("seen"),
    ).first()
    if not counts["prepared"]:
        sf.append_run(missed, p["skips"], d.isoformat())
        return {"date": d.isoformat(), "found": found, "prepared": 0, "missed": counts["missed"],
                "status": "nothing_new"}

    batch = ing.ingest_batch(provided, landed_html(spark, p["html"]), seen, cfg,
                             listings=landed_listings(spark, p["html"]), chunker=chunker)
    # Written once: chunks, artifacts, records and the manifest read them.
    parsed = materialize(batch.parsed, "parsed")
    status = materialize(batch.status, "status")
    chunks = ing.corpus_chunks(parsed, cfg, chunker=chunker)
    if embed is not None:
        chunks = embed(chunks, "chunk")
    chunks = chunks.withColumn("version", F.lit(int(dt.datetime.now().timestamp() * 1000)))
    sf.write_artifacts(sf.artifact_frame(parsed.where(F.col("section").isNotNull())), p["artifacts"])
    # A later run of the day finds the earlier one's filings seen, so its rows are
    # a load of their own; a run that died before the manifest is replaced.
    load = f"{d.isoformat()}-{counts['seen']:09d}"
    sc.upsert_corpus(chunks, p["corpus"], load, key="chunk_id", order_col="version", partition_by=[CORPUS_PARTITION])
    sf.append_run(ing.records(status), p["records"], d.isoformat())
    sf.append_run(missed.unionByName(ing.skips(status)), p["skips"], d.isoformat())
    sf.append_manifest(ing.manifest_rows(status, embedding_model), p["manifest"])
    summ = ing.summary(status).first().asDict()
    # The sum of the loads' counts: the corpus itself is not read.
    sc.write_load(ing.summary(status).select(F.col("total_chunks").cast("long")), p["counts"], load)
    total = sc.read_loads(spark, p["counts"]).agg(F.sum("total_chunks")).first()[0] or 0
    return {"date": d.isoformat(), "found": found, "prepared": counts["prepared"], "missed": counts["missed"],
            "processed": summ["processed"], "skipped": summ["skipped"], "total_chunks": summ["total_chunks"],
            "total_vectors": total, "status": "ingested"}
