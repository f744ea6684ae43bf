"""Inputs derived from the driver tables, built the same way in Spark and SQL.

The driver tables hold no filings, indexes or manifests, so the registered
queries derive them from whole tables (documents, orders, customer, pages,
labels, conversations, embeddings). Each builder has a Spark form and a DuckDB
form; both apply the same rules to every row (modulo arithmetic only varies
the generated content, it never drops rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# Fixed values of the derived fixtures.
FORM_CYCLE = ("10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "S-1")
DOC_FORM_CYCLE = ("10-K", "10-K/A", "10-Q", "10-K", "10-K", "10-Q/A")
TOC_BLOCK = (
    "Table of Contents\n"
    "Item 1A. Risk Factors 12\n"
    "Item 1B. Unresolved Staff Comments 20\n"
    "Item 2. Properties 21\n\n"
)
TAIL_BLOCK = "Item 1B. Unresolved Staff Comments\nNone.\nItem 2. Properties\nLeased offices.\n"
CONTENTS_NOTE = "Details are listed in the Table of Contents.\n"
INDEX_PREAMBLE = "Description: Daily Index of Filings by Company\nLast Data Received: "
INDEX_HEADER = "CIK|Company Name|Form Type|Date Filed|Filename"
INDEX_RULE = "-" * 60
FILE_BLOCK = 10_000_000  # order keys per derived index file of one day


def sql_str(s: str) -> str:
    """DuckDB expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(lits) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def cycle(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# ---------------------------------------------------------------------------
# Filings built from documents: annual-report text with a contents block, a
# risk-factor heading (absent every 7th), body, a page number, a contents
# mention (every 11th) and the next items.
# ---------------------------------------------------------------------------

def filing_text(doc_id: Column, text: Column) -> Column:
    return F.concat(
        F.lit("ANNUAL REPORT "),
        doc_id.cast("string"),
        F.lit("\n" + TOC_BLOCK),
        F.when(doc_id % 7 == 0, F.lit("Item 1. Business\n")).otherwise(
            F.lit("Item 1A. Risk Factors\n")
        ),
        text,
        F.lit("\n"),
        (doc_id % 97 + 1).cast("string"),
        F.lit("\n"),
        F.when(doc_id % 11 == 0, F.lit(CONTENTS_NOTE)).otherwise(F.lit("")),
        F.lit(TAIL_BLOCK),
    )


def sql_filing_text(doc_id: str, text: str) -> str:
    return (
        f"('ANNUAL REPORT ' || CAST({doc_id} AS VARCHAR) || {sql_str(chr(10) + TOC_BLOCK)} || "
        f"(CASE WHEN {doc_id} % 7 = 0 THEN {sql_str('Item 1. Business' + chr(10))} "
        f"ELSE {sql_str('Item 1A. Risk Factors' + chr(10))} END) || {text} || chr(10) || "
        f"CAST({doc_id} % 97 + 1 AS VARCHAR) || chr(10) || "
        f"(CASE WHEN {doc_id} % 11 = 0 THEN {sql_str(CONTENTS_NOTE)} ELSE '' END) || "
        f"{sql_str(TAIL_BLOCK)})"
    )


def filing_html(doc_id: Column, text: Column) -> Column:
    """The filing text as an HTML page: one <p> per line, with a style block."""
    body = F.replace(filing_text(doc_id, text), F.lit("\n"), F.lit("</p>\n<p>"))
    return F.concat(
        F.lit("<html><head><style>p{margin:0}</style></head><body><p>"),
        body,
        F.lit("</p></body></html>"),
    )


def sql_filing_html(doc_id: str, text: str) -> str:
    body = f"replace({sql_filing_text(doc_id, text)}, chr(10), '</p>' || chr(10) || '<p>')"
    return (
        f"('<html><head><style>p{{margin:0}}</style></head><body><p>' || {body} || "
        f"'</p></body></html>')"
    )


def doc_filing_meta(doc_id: Column) -> dict[str, Column]:
    """Metadata of the filing made from one document."""
    owner = F.floor(doc_id / 4).cast("bigint")
    cik = owner.cast("string")
    return {
        "cik": cik,
        "accessionNumber": F.format_string(
            "%010d-%02d-%06d", owner, 20 + doc_id % 5, doc_id
        ),
        "form": cycle(DOC_FORM_CYCLE, doc_id % 6),
        "filingDate": F.date_format(
            F.date_add(F.lit("2019-01-01").cast("date"), ((doc_id * 37) % 1800).cast("int")),
            "yyyy-MM-dd",
        ),
        "primaryDocument": F.concat(F.lit("d"), doc_id.cast("string"), F.lit("_10k.htm")),
        "company": F.when(doc_id % 5 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("Company "), cik)
        ),
    }


def sql_doc_filing_meta(doc_id: str) -> dict[str, str]:
    cik = f"CAST({doc_id} // 4 AS VARCHAR)"
    return {
        "cik": cik,
        "accessionNumber": f"printf('%010d-%02d-%06d', {doc_id} // 4, 20 + {doc_id} % 5, {doc_id})",
        "form": f"{sql_list(DOC_FORM_CYCLE)}[{doc_id} % 6 + 1]",
        "filingDate": f"strftime(DATE '2019-01-01' + CAST(({doc_id} * 37) % 1800 AS INTEGER), '%Y-%m-%d')",
        "primaryDocument": f"'d' || CAST({doc_id} AS VARCHAR) || '_10k.htm'",
        "company": f"(CASE WHEN {doc_id} % 5 = 0 THEN NULL ELSE 'Company ' || {cik} END)",
    }


def doc_filings(spark: SparkSession, d: str) -> DataFrame:
    """Raw filings table: cik, accessionNumber, form, filingDate,
    primaryDocument, company, html (one filing per document)."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    meta = doc_filing_meta(F.col("doc_id"))
    return docs.select(
        "doc_id",
        *[v.alias(k) for k, v in meta.items()],
        filing_html(F.col("doc_id"), F.col("text")).alias("html"),
    )


def sql_doc_filings() -> str:
    meta = sql_doc_filing_meta("doc_id")
    cols = ", ".join(f"{v} AS {k}" for k, v in meta.items())
    return f"(SELECT doc_id, {cols}, {sql_filing_html('doc_id', 'text')} AS html FROM documents)"


# ---------------------------------------------------------------------------
# Daily master-index files built from orders x customer: one file per order
# date; preamble, header (indented on even days, missing on the 13th),
# a rule line, then one line per order with some bad-arity and padded lines.
# ---------------------------------------------------------------------------

def order_form(orderkey: Column) -> Column:
    return cycle(FORM_CYCLE, orderkey % 6)


def sql_order_form(orderkey: str) -> str:
    return f"{sql_list(FORM_CYCLE)}[{orderkey} % 6 + 1]"


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """file_date (yyyy-MM-dd string), file_part and text of each daily index
    file. A day's orders are split into files by blocks of 10M order keys, so
    a file stays bounded at any scale (one file per day at the test scales)."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", spread=True)
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    cik = F.col("o_custkey").cast("string")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    fname = F.concat(
        F.lit("edgar/data/"), cik, F.lit("/"), F.format_string("%010d", F.col("o_orderkey")), F.lit(".txt")
    )
    form = order_form(F.col("o_orderkey"))
    k = F.col("o_orderkey")
    line = (
        F.when(k % 13 == 0, F.concat_ws("|", cik, F.col("c_name"), form, date))
        .when(k % 17 == 0, F.concat_ws("|", cik, F.col("c_name"), form, date, fname, F.lit("extra")))
        .when(
            k % 5 == 0,
            F.concat(
                F.lit(" "), cik, F.lit(" | "), F.col("c_name"), F.lit(" |"), form,
                F.lit("| "), date, F.lit(" |"), fname, F.lit("  "),
            ),
        )
        .otherwise(F.concat_ws("|", cik, F.col("c_name"), form, date, fname))
    )
    part = F.floor(k / FILE_BLOCK).cast("long")
    per_file = j.select(date.alias("file_date"), part.alias("file_part"), k.alias("k"), line.alias("line")).groupBy(
        "file_date", "file_part"
    ).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    day = F.dayofmonth(F.col("file_date").cast("date"))
    header = (
        F.when(day == 13, F.lit(""))
        .when(day % 2 == 0, F.lit("  " + INDEX_HEADER + "\n"))
        .otherwise(F.lit(INDEX_HEADER + "\n"))
    )
    text = F.concat(
        F.lit(INDEX_PREAMBLE),
        F.col("file_date"),
        F.lit("\n\n"),
        header,
        F.lit(INDEX_RULE + "\n"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
        F.lit("\n"),
    )
    return per_file.select("file_date", "file_part", text.alias("text"))


def sql_index_files() -> str:
    cik = "CAST(o_custkey AS VARCHAR)"
    date = "strftime(o_orderdate, '%Y-%m-%d')"
    fname = f"('edgar/data/' || {cik} || '/' || printf('%010d', o_orderkey) || '.txt')"
    form = sql_order_form("o_orderkey")
    line = f"""(CASE WHEN o_orderkey % 13 = 0 THEN concat_ws('|', {cik}, c_name, {form}, {date})
        WHEN o_orderkey % 17 = 0 THEN concat_ws('|', {cik}, c_name, {form}, {date}, {fname}, 'extra')
        WHEN o_orderkey % 5 = 0 THEN ' ' || {cik} || ' | ' || c_name || ' |' || {form} || '| ' || {date} || ' |' || {fname} || '  '
        ELSE concat_ws('|', {cik}, c_name, {form}, {date}, {fname}) END)"""
    hdr = (
        f"(CASE WHEN day(CAST(file_date AS DATE)) = 13 THEN '' "
        f"WHEN day(CAST(file_date AS DATE)) % 2 = 0 THEN {sql_str('  ' + INDEX_HEADER + chr(10))} "
        f"ELSE {sql_str(INDEX_HEADER + chr(10))} END)"
    )
    return f"""(SELECT file_date, file_part,
        {sql_str(INDEX_PREAMBLE)} || file_date || chr(10) || chr(10) || {hdr} || {sql_str(INDEX_RULE + chr(10))}
        || body || chr(10) AS text
      FROM (SELECT {date} AS file_date, o_orderkey // {FILE_BLOCK} AS file_part,
                   string_agg({line}, chr(10) ORDER BY o_orderkey) AS body
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""


# ---------------------------------------------------------------------------
# Company submissions built from orders x customer: one row per customer with
# the struct-of-arrays layout; names blank for every 10th customer; dates
# shifted a day for pending orders and written yyyyMMdd for every 4th order.
# ---------------------------------------------------------------------------

def submission_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with the fields the arrays are built from."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", spread=True)
    date = F.when(
        F.col("o_orderstatus") == "P", F.date_add(F.col("o_orderdate").cast("date"), 1)
    ).otherwise(F.col("o_orderdate").cast("date"))
    filing_date = F.when(F.col("o_orderkey") % 4 == 1, F.date_format(date, "yyyyMMdd")).otherwise(
        F.date_format(date, "yyyy-MM-dd")
    )
    return o.select(
        F.col("o_custkey").cast("string").alias("cik"),
        F.col("o_orderkey").alias("k"),
        order_form(F.col("o_orderkey")).alias("form"),
        F.format_string(
            "%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100, F.col("o_orderkey")
        ).alias("accessionNumber"),
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primaryDocument"),
        filing_date.alias("filingDate"),
    )


def sql_submission_rows() -> str:
    date = "(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END)"
    return f"""(SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderkey AS k, {sql_order_form('o_orderkey')} AS form,
        printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accessionNumber,
        'd' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primaryDocument,
        (CASE WHEN o_orderkey % 4 = 1 THEN strftime({date}, '%Y%m%d') ELSE strftime({date}, '%Y-%m-%d') END) AS filingDate
      FROM orders)"""


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """cik, name, filings struct<recent: struct<form, accessionNumber,
    primaryDocument, filingDate arrays>> — the submissions JSON layout."""
    rows = submission_rows(spark, d)
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    per = rows.groupBy("cik").agg(
        F.array_sort(
            F.collect_list(F.struct("k", "form", "accessionNumber", "primaryDocument", "filingDate"))
        ).alias("fs")
    )
    def field(f):
        return F.transform("fs", lambda x: x[f]).alias(f)

    recent = F.struct(
        *[field(f) for f in ("form", "accessionNumber", "primaryDocument", "filingDate")]
    )
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.col("c_name"))
    return per.join(c, per.cik == c.c_custkey.cast("string"), "inner").select(
        "cik", name.alias("name"), F.struct(recent.alias("recent")).alias("filings")
    )
