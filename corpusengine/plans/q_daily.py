"""Query: the daily run itself, over files landed from the driver tables (T1-T4,
S2, S5, S6, K1-K3, S10, A4, A6, A8)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from ..config import REASON_ALREADY_SEEN, REASON_NOT_IN_SUBMISSIONS
from ..functions.filings import parse_filing_date
from ..session import scratch_path
from ..sinks import corpus as sc
from ..sources import files as src
from ..sources.landed import write_landed
from ..sources.tables import read_table
from . import derived as dv
from .daily import CORPUS_KEY, run_daily
from .q_filings import urgent_manifest
from .q_ingest import daily_sql
from .registry import CFG, register

BUSIEST_SQL = """(SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE day(o_orderdate) <> 13
                  GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1)"""
NUMBERS = ("found", "prepared", "missed", "processed", "skipped", "total_chunks", "total_vectors", "corpus_rows")


def land_day(spark, d, day: dt.date, landing: str, state: str) -> None:
    """What a fetcher leaves for one day: the index, the submissions of the
    companies in it and the day's documents; and the manifest of earlier runs."""
    tag = day.strftime("%Y%m%d")
    index = dv.index_files(spark, d).where(F.col("file_date") == day.isoformat())
    index.select("text").write.text(src.daily_index_path(os.path.join(landing, "daily-index"), day))
    orders = read_table(spark, d, "orders", "o_custkey", "o_orderdate").where(F.col("o_orderdate").cast("date") == F.lit(day))
    ciks = orders.select(F.col("o_custkey").cast("string").alias("cik")).distinct()
    subs = dv.submissions(spark, d).join(ciks, "cik", "left_semi")
    write_landed(subs.select(src.submissions_file_name(F.col("cik")).alias("name"),
                             F.to_json(F.struct("name", "filings")).alias("text")),
                 os.path.join(landing, "submissions", tag))
    filed = dv.submission_rows(spark, d).where(parse_filing_date(F.col("filingDate")) == F.lit(day))
    # The day's filings first: only their documents become pages.
    filed = filed.select("accessionNumber", "primaryDocument", F.floor(F.col("k") / 15).cast("long").alias("doc_id"))
    pages = filed.join(read_table(spark, d, "documents", "doc_id", "text"), "doc_id")
    write_landed(pages.select(F.concat_ws("/", "accessionNumber", "primaryDocument").alias("name"),
                              dv.filing_html(F.col("doc_id"), F.col("text")).alias("text")),
                 os.path.join(landing, "filings", tag))
    urgent_manifest(spark, d).write.json(os.path.join(state, "manifest"))


def _daily_run_sql() -> str:
    skip = f"('{REASON_NOT_IN_SUBMISSIONS}', '{REASON_ALREADY_SEEN}')"
    cast = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in NUMBERS)
    return f"""
    WITH day AS ({daily_sql()}),
    st AS (SELECT *, reason IS NULL OR reason NOT IN {skip} AS provided FROM day WHERE file_date = {BUSIEST_SQL}),
    again AS (SELECT * FROM st WHERE provided AND accessionNumber NOT IN (SELECT accessionNumber FROM st WHERE reason IS NULL)),
    one AS (SELECT count(*) AS found, coalesce(sum(CAST(provided AS INT)), 0) AS prepared,
                   coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END), 0) AS ok, coalesce(sum(chunks), 0) AS chunks,
                   (SELECT count(*) FROM again) AS left_over FROM st),
    runs AS (
      SELECT 1 AS run, {BUSIEST_SQL} AS date, found, prepared, found - prepared AS missed, ok AS processed,
             prepared - ok AS skipped, chunks AS total_chunks, chunks AS total_vectors, chunks AS corpus_rows FROM one
      UNION ALL
      SELECT 2, {BUSIEST_SQL}, found, left_over, found - left_over, CASE WHEN left_over > 0 THEN 0 END,
             CASE WHEN left_over > 0 THEN left_over END, CASE WHEN left_over > 0 THEN 0 END,
             CASE WHEN left_over > 0 THEN chunks END, chunks FROM one
      UNION ALL
      SELECT 3, (SELECT strftime(max(CAST(o_orderdate AS DATE)) + 2, '%Y-%m-%d') FROM orders), 0, NULL, NULL, NULL, NULL,
             NULL, NULL, chunks FROM one)
    SELECT run, date, CASE WHEN run = 3 THEN 'no_index_rows' WHEN prepared > 0 THEN 'ingested' ELSE 'nothing_new' END AS status,
           {cast} FROM runs"""


@register("daily_run", _daily_run_sql())
def q_daily_run(spark, d):
    """The busiest order date is landed and run, run again, and a day
    without an index is run. One row per run: its summary and the rows of the
    stored corpus after it (one day's run is the feature)."""
    dates = read_table(spark, d, "orders", "o_orderdate").select(F.col("o_orderdate").cast("date").alias("d"))
    day = dates.where(F.dayofmonth("d") != 13).groupBy("d").count().orderBy(F.desc("count"), "d").first().d
    empty = dates.agg(F.max("d")).first()[0] + dt.timedelta(days=2)
    base = scratch_path(spark, "daily-run")
    landing, state = os.path.join(base, "landing"), os.path.join(base, "state")
    land_day(spark, d, day, landing, state)
    rows = []
    for n, date in enumerate((day, day, empty), 1):
        got = run_daily(spark, landing, state, date, CFG, chunker="fixed")
        corpus = sc.read_corpus(spark, os.path.join(state, "corpus"), CORPUS_KEY)
        got["corpus_rows"] = 0 if corpus is None else corpus.count()
        rows.append((n, got["date"], got["status"], *[got.get(k) for k in NUMBERS]))
    return spark.createDataFrame(rows, "run int, date string, status string, " + ", ".join(f"{k} bigint" for k in NUMBERS))
