"""Queries: filing lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAILY_FORMS, HISTORICAL_FORMS, MASTER_INDEX_HEADER
from ..functions.filings import archive_base, cik10, daily_index_url, fiscal_year
from ..functions.text import safe_name
from ..operators import filings as fo
from ..sources.tables import read_table
from . import derived as dv
from .registry import CFG, register
from .sqlfrag import sql_master_index_rows, sql_parse_date, sql_strip

IDX_ROWS_SQL = sql_master_index_rows(dv.sql_index_files(), MASTER_INDEX_HEADER)
FILE_ROW_KEY = ("file_date", "file_part", "line_no")


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def index_rows(spark, d):
    return fo.parse_master_index(dv.index_files(spark, d))


@register(
    "master_index_parse",
    f"SELECT file_date, file_part, line_no, cik, company, form, date_filed, filename FROM {IDX_ROWS_SQL}",
)
def q_master_index_parse(spark, d):
    return index_rows(spark, d).select(
        "file_date", "file_part", "line_no", "cik", "company", "form", "date_filed", "filename"
    )


@register(
    "form_filter",
    f"""SELECT file_date, file_part, line_no, cik, form, form IN {_in(HISTORICAL_FORMS)} AS historical
        FROM {IDX_ROWS_SQL} WHERE form IN {_in(DAILY_FORMS)}""",
)
def q_form_filter(spark, d):
    rows = fo.filter_forms(index_rows(spark, d), DAILY_FORMS)
    return rows.select(
        "file_date", "file_part", "line_no", "cik", "form",
        F.col("form").isin(list(HISTORICAL_FORMS)).alias("historical"),
    )


SUB_FLAT_SQL = f"""(SELECT s.cik, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS name,
        row_number() OVER (PARTITION BY s.cik ORDER BY k) - 1 AS pos,
        form, accessionNumber, primaryDocument, filingDate
      FROM {dv.sql_submission_rows()} s JOIN customer ON s.cik = CAST(c_custkey AS VARCHAR))"""


def flat_submissions(spark, d):
    return fo.flatten_submissions(dv.submissions(spark, d))


@register(
    "submissions_flatten",
    f"SELECT cik, name, pos, form, accessionNumber, primaryDocument, filingDate FROM {SUB_FLAT_SQL}",
)
def q_submissions_flatten(spark, d):
    return flat_submissions(spark, d)


@register(
    "top_n_per_company",
    f"""SELECT cik, rank, form, accessionNumber, filingDate FROM (
          SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filingDate DESC, pos) AS rank
          FROM {SUB_FLAT_SQL} WHERE form IN {_in(HISTORICAL_FORMS)})
        WHERE rank <= {CFG.top_n_per_cik}""",
)
def q_top_n_per_company(spark, d):
    top = fo.top_n_filings(flat_submissions(spark, d), n=CFG.top_n_per_cik)
    return top.select("cik", "rank", "form", "accessionNumber", "filingDate")


def urgent_manifest(spark, d):
    """Manifest of already-ingested filings: the urgent orders' accessions."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.format_string(
            "%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100, F.col("o_orderkey")
        ).alias("accessionNumber")
    )


URGENT_SQL = """(SELECT printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accessionNumber
    FROM orders WHERE o_orderpriority = '1-URGENT')"""


DAILY_MATCH_SQL = f"""
    WITH idx AS (SELECT * FROM {IDX_ROWS_SQL} WHERE form IN {_in(DAILY_FORMS)}),
    subs AS (SELECT cik, form, {sql_parse_date('filingDate')} AS sd, pos, accessionNumber, primaryDocument FROM {SUB_FLAT_SQL}),
    j AS (SELECT idx.*, subs.pos, subs.accessionNumber, subs.primaryDocument
          FROM idx LEFT JOIN subs ON idx.cik = subs.cik AND idx.form = subs.form
               AND {sql_parse_date('idx.date_filed')} = subs.sd
          QUALIFY row_number() OVER (PARTITION BY idx.file_date, idx.file_part, idx.line_no
                                     ORDER BY subs.pos NULLS LAST) = 1)
    SELECT file_date, file_part, line_no, cik, company, form, date_filed, accessionNumber, primaryDocument,
           CASE WHEN accessionNumber IS NULL THEN 'not_found_in_submissions_recent'
                WHEN accessionNumber IN (SELECT accessionNumber FROM {URGENT_SQL}) THEN 'already_seen' END AS reason
    FROM j
    """


@register(
    "daily_match_first",
    f"""SELECT file_date, file_part, line_no, cik, form, date_filed, accessionNumber, primaryDocument, reason
        FROM ({DAILY_MATCH_SQL})""",
)
def q_daily_match_first(spark, d):
    idx = fo.filter_forms(index_rows(spark, d), DAILY_FORMS)
    matched = fo.match_first_submission(idx, flat_submissions(spark, d))
    prepared = fo.prepare_daily(matched, fo.seen_accessions(urgent_manifest(spark, d)), row_key=FILE_ROW_KEY)
    return prepared.select(
        "file_date", "file_part", "line_no", "cik", "form", "date_filed", "accessionNumber", "primaryDocument", "reason"
    )


# Filings made from documents; the labels table plays the manifest.
DOC_META_SQL = dv.sql_doc_filing_meta("d.doc_id")
LABEL_ACC_SQL = dv.sql_doc_filing_meta("l.doc_id")["accessionNumber"]


def doc_filing_list(spark, d):
    docs = read_table(spark, d, "documents", "doc_id")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    return docs.select("doc_id", meta["cik"].alias("cik"), meta["accessionNumber"].alias("accessionNumber"))


def labels_manifest(spark, d):
    lab = read_table(spark, d, "labels", "doc_id")
    return lab.select(dv.doc_filing_meta(F.col("doc_id"))["accessionNumber"].alias("accessionNumber"))


@register(
    "seen_anti_join",
    f"""SELECT doc_id, {DOC_META_SQL['accessionNumber']} AS accessionNumber FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE {LABEL_ACC_SQL} = {DOC_META_SQL['accessionNumber']})""",
)
def q_seen_anti_join(spark, d):
    seen = fo.seen_accessions(labels_manifest(spark, d))
    return fo.drop_seen(doc_filing_list(spark, d), seen).select("doc_id", "accessionNumber")


@register(
    "seen_skips",
    f"""SELECT doc_id, {DOC_META_SQL['cik']} AS cik, 'already_ingested:' || {DOC_META_SQL['accessionNumber']} AS reason
        FROM documents d
        WHERE EXISTS (SELECT 1 FROM labels l WHERE {LABEL_ACC_SQL} = {DOC_META_SQL['accessionNumber']})""",
)
def q_seen_skips(spark, d):
    seen = fo.seen_accessions(labels_manifest(spark, d))
    return fo.seen_skips(doc_filing_list(spark, d), seen).select("doc_id", "cik", "reason")


@register(
    "first_occurrence",
    f"""
    SELECT doc_id, acc AS accessionNumber,
           CASE WHEN doc_id = first_pos THEN first_reason
                WHEN first_reason IS NULL THEN 'already_ingested:' || acc ELSE first_reason END AS reason
    FROM (SELECT doc_id, acc, min(doc_id) OVER (PARTITION BY acc) AS first_pos,
                 first_value(r) OVER (PARTITION BY acc ORDER BY doc_id) AS first_reason
          FROM (SELECT doc_id, md5(text) AS acc,
                       CASE WHEN length(text) < {CFG.min_item1a_chars} THEN md5(text) || ':no_item_1a' END AS r
                FROM documents))
    """,
)
def q_first_occurrence(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.md5("text").alias("accessionNumber"), F.length("text").alias("n")
    )
    outcome = F.when(
        F.col("n") < CFG.min_item1a_chars, F.concat(F.col("accessionNumber"), F.lit(":no_item_1a"))
    )
    st = fo.first_occurrence_status(docs, outcome, key="accessionNumber", order_col="doc_id")
    return st.select("doc_id", "accessionNumber", "reason")


def submission_names(spark, d):
    """Company names as the submissions source gives them (blank, blank-only
    or missing for some)."""
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    name = (
        F.when(F.col("c_custkey") % 10 == 0, F.lit(""))
        .when(F.col("c_custkey") % 10 == 3, F.lit("   "))
        .when(F.col("c_custkey") % 10 == 7, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    )
    return c.select(F.col("c_custkey").cast("string").alias("cik"), name.alias("name"))


SUB_NAMES_SQL = """(SELECT CAST(c_custkey AS VARCHAR) AS cik,
    CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 3 THEN '   '
         WHEN c_custkey % 10 = 7 THEN NULL ELSE ' ' || c_name || ' ' END AS name FROM customer)"""


@register(
    "company_default",
    f"""
    SELECT f.doc_id, f.cik,
           CASE WHEN f.company IS NULL OR f.company = '' THEN
                {sql_strip("COALESCE(NULLIF(n.name, ''), 'CIK ' || f.cik)")} ELSE f.company END AS company
    FROM (SELECT doc_id, {DOC_META_SQL['cik']} AS cik, {DOC_META_SQL['company']} AS company FROM documents d) f
    LEFT JOIN {SUB_NAMES_SQL} n ON f.cik = n.cik
    """,
)
def q_company_default(spark, d):
    docs = read_table(spark, d, "documents", "doc_id")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    f = docs.select("doc_id", meta["cik"].alias("cik"), meta["company"].alias("company"))
    return fo.fill_company(f, submission_names(spark, d)).select("doc_id", "cik", "company")


# Directory listings made from pages: a filing is a host and a block of 100
# page ids (bounded listings at any scale), one item per page.
ITEM_SUFFIXES = ("_10-K.htm", "-10k.HTML", ".xml", "ex21.htm", "10k.htm", "_10K.txt")


def page_items(spark, d):
    p = read_table(spark, d, "pages", "page_id", "url")
    filing = F.concat(F.regexp_extract("url", r"://([^/:?#]+)", 1), F.lit("#"),
                      F.floor(F.col("page_id") / 100).cast("string"))
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), dv.cycle(ITEM_SUFFIXES, F.col("page_id") % 6))
    return p.select(filing.alias("filing"), F.col("page_id").alias("pos"), name.alias("name"))


PAGE_ITEMS_SQL = f"""(SELECT regexp_extract(url, '://([^/:?#]+)', 1) || '#' || CAST(page_id // 100 AS VARCHAR) AS filing,
    page_id AS pos,
    'p' || CAST(page_id AS VARCHAR) || {dv.sql_list(ITEM_SUFFIXES)}[page_id % 6 + 1] AS name FROM pages)"""


@register(
    "primary_doc",
    f"""
    SELECT h.filing, COALESCE(b.name, h.filing || '.xml') AS primary
    FROM (SELECT DISTINCT filing FROM {PAGE_ITEMS_SQL}) h
    LEFT JOIN (SELECT filing, name FROM {PAGE_ITEMS_SQL}
               WHERE (lower(name) LIKE '%.htm' OR lower(name) LIKE '%.html')
                 AND (contains(lower(name), '10-k') OR contains(lower(name), '10k'))
               QUALIFY row_number() OVER (PARTITION BY filing ORDER BY length(name), pos) = 1) b
      ON h.filing = b.filing
    """,
)
def q_primary_doc(spark, d):
    items = page_items(spark, d)
    filings = items.select("filing").distinct().withColumn(
        "primaryDocument", F.concat(F.col("filing"), F.lit(".xml"))
    )
    best = fo.best_primary_doc(items, "filing")
    return fo.with_primary_doc(filings, best, "filing").select("filing", "primary")


def raw_cik():
    k = F.col("c_custkey")
    return (
        F.when(k % 3 == 0, k.cast("string"))
        .when(k % 3 == 1, (k + 10_000_000_000).cast("string"))
        .otherwise(F.concat(F.lit("00"), k.cast("string")))
    )
RAW_CIK_SQL = """(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR)
    WHEN c_custkey % 3 = 1 THEN CAST(c_custkey + 10000000000 AS VARCHAR)
    ELSE '00' || CAST(c_custkey AS VARCHAR) END)"""


@register(
    "cik_pad",
    f"""SELECT c_custkey, {RAW_CIK_SQL} AS raw_cik,
        CASE WHEN length({RAW_CIK_SQL}) < 10 THEN lpad({RAW_CIK_SQL}, 10, '0') ELSE {RAW_CIK_SQL} END AS cik10
        FROM customer""",
)
def q_cik_pad(spark, d):
    c = read_table(spark, d, "customer", "c_custkey")
    return c.select("c_custkey", raw_cik().alias("raw_cik"), cik10(raw_cik()).alias("cik10"))


@register(
    "archive_url",
    f"""SELECT k AS o_orderkey,
        'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(lpad(cik, 10, '0') AS BIGINT) AS VARCHAR) || '/'
          || replace(accessionNumber, '-', '') || '/' || primaryDocument AS url
        FROM {dv.sql_submission_rows()}""",
)
def q_archive_url(spark, d):
    rows = dv.submission_rows(spark, d)
    padded = cik10(F.col("cik"))
    url = F.concat(archive_base(padded, F.col("accessionNumber")), F.lit("/"), F.col("primaryDocument"))
    return rows.select(F.col("k").alias("o_orderkey"), url.alias("url"))


@register(
    "index_url",
    """SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/daily-index/' || CAST(year(o_orderdate) AS VARCHAR)
        || '/QTR' || CAST(quarter(o_orderdate) AS VARCHAR) || '/master.' || strftime(o_orderdate, '%Y%m%d') || '.idx' AS url
        FROM orders""",
)
def q_index_url(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", daily_index_url(F.col("o_orderdate").cast("date")).alias("url"))


@register(
    "safe_name",
    f"""SELECT doc_id, substring({sql_strip("regexp_replace(text, '[^\\p{L}\\p{N}._\\- ]', '', 'g')")}, 1, 80) AS safe
        FROM documents""",
)
def q_safe_name(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", safe_name(F.col("text")).alias("safe"))


@register(
    "fiscal_year",
    f"""SELECT k AS o_orderkey, filingDate, TRY_CAST(substring(filingDate, 1, 4) AS INTEGER) AS fiscal_year
        FROM {dv.sql_submission_rows()}""",
)
def q_fiscal_year(spark, d):
    rows = dv.submission_rows(spark, d)
    return rows.select(F.col("k").alias("o_orderkey"), "filingDate", fiscal_year(F.col("filingDate")).alias("fiscal_year"))
