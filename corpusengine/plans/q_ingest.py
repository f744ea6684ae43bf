"""Queries: ingestion flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import HISTORICAL_FORMS
from ..session import materialize
from ..sources.tables import read_table
from . import derived as dv
from . import ingest as ing
from .q_filings import (
    DAILY_MATCH_SQL,
    FILE_ROW_KEY,
    SUB_FLAT_SQL,
    SUB_NAMES_SQL,
    URGENT_SQL,
    flat_submissions,
    index_rows,
    labels_manifest,
    submission_names,
    urgent_manifest,
)
from .registry import CFG, register
from .sqlfrag import sql_fixed_chunks, sql_fixed_count, sql_html_to_text, sql_recursive_chunks, sql_section_select, sql_strip

ARCHIVE = "'https://www.sec.gov/Archives/edgar/data/'"


def _url_sql(cik: str, acc: str, primary: str) -> str:
    return f"({ARCHIVE} || CAST(CAST({cik} AS BIGINT) AS VARCHAR) || '/' || replace({acc}, '-', '') || '/' || {primary})"


# --- filings made from documents (provided-filings path, I4) ----------------

def doc_batch(spark, d):
    # The list needs the ids alone; only the pages read the texts.
    ids = read_table(spark, d, "documents", "doc_id")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    filings = ids.select(F.col("doc_id").alias("input_pos"), *[meta[c].alias(c) for c in (
        "cik", "accessionNumber", "primaryDocument", "filingDate", "form", "company")])
    return filings, dv.doc_filings(spark, d).select("accessionNumber", "html")


def doc_ingest(spark, d, chunker="fixed"):
    filings, raw = doc_batch(spark, d)
    return ing.ingest_batch(
        filings, raw, labels_manifest(spark, d), CFG, companies=submission_names(spark, d), chunker=chunker)


def doc_status(spark, d, chunker="fixed"):
    return doc_ingest(spark, d, chunker).status


def _doc_status_sql() -> str:
    m = dv.sql_doc_filing_meta("d.doc_id")
    lab = dv.sql_doc_filing_meta("l.doc_id")["accessionNumber"]
    return f"""
    WITH f AS (SELECT d.doc_id AS input_pos, {m['cik']} AS cik, {m['accessionNumber']} AS accessionNumber,
                      {m['form']} AS form, {m['filingDate']} AS filingDate, {m['primaryDocument']} AS primaryDocument,
                      {m['company']} AS company0, {dv.sql_filing_html('d.doc_id', 'd.text')} AS html
               FROM documents d),
    seen AS (SELECT DISTINCT {lab} AS acc FROM labels l),
    c AS (SELECT f.*, CASE WHEN f.company0 IS NULL OR f.company0 = '' THEN
                 {sql_strip("COALESCE(NULLIF(n.name, ''), 'CIK ' || f.cik)")} ELSE f.company0 END AS company
          FROM f LEFT JOIN {SUB_NAMES_SQL} n ON f.cik = n.cik),
    todo AS (SELECT * FROM c WHERE accessionNumber NOT IN (SELECT acc FROM seen)),
    s AS {sql_section_select(f"(SELECT input_pos, {sql_html_to_text('html')} AS t FROM todo)", 'input_pos', 't',
                             CFG.min_item1a_chars)},
    st AS (
      SELECT c.input_pos, c.cik, c.company, c.form, c.filingDate, c.accessionNumber,
             {_url_sql('c.cik', 'c.accessionNumber', 'c.primaryDocument')} AS url,
             CASE WHEN c.accessionNumber IN (SELECT acc FROM seen) THEN 'already_ingested:' || c.accessionNumber
                  WHEN s.section IS NULL THEN c.accessionNumber || ':no_item_1a' END AS reason,
             CASE WHEN c.accessionNumber NOT IN (SELECT acc FROM seen) AND s.section IS NOT NULL
                  THEN {sql_fixed_count('length(s.section)', CFG.chunk_size, CFG.chunk_overlap)} END AS chunks
      FROM c LEFT JOIN s USING (input_pos))
    """


@register(
    "ingest_filings",
    _doc_status_sql() + "SELECT company, cik, filingDate, form, accessionNumber, url, chunks FROM st WHERE reason IS NULL",
)
def q_ingest_filings(spark, d):
    return ing.records(doc_status(spark, d))


RECURSIVE_SECTIONS = sql_recursive_chunks("(SELECT * FROM s WHERE section IS NOT NULL)", "input_pos", "section",
                                          CFG.chunk_size, CFG.chunk_overlap)


@register(
    "ingest_filings_recursive",
    _doc_status_sql() + f""", r AS (SELECT input_pos, count(*) AS n FROM {RECURSIVE_SECTIONS} GROUP BY input_pos)
    SELECT company, cik, filingDate, form, accessionNumber, url, COALESCE(r.n, 0) AS chunks
    FROM st LEFT JOIN r USING (input_pos) WHERE reason IS NULL""",
)
def q_ingest_filings_recursive(spark, d):
    """I4 with the recursive splitter (1500/200) counting each record's chunks."""
    return ing.records(doc_status(spark, d, chunker="recursive"))


@register(
    "corpus_chunks_recursive",
    _doc_status_sql() + f"""SELECT cik, accessionNumber, chunk_ix,
        sha1(cik || '__' || accessionNumber || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id, chunk,
        TRY_CAST(substring(filingDate, 1, 4) AS INTEGER) AS fiscalYear
    FROM st JOIN (SELECT * FROM {RECURSIVE_SECTIONS}) USING (input_pos) WHERE reason IS NULL""",
)
def q_corpus_chunks_recursive(spark, d):
    """D9 with the recursive splitter: text, ids and year of every chunk."""
    ch = ing.corpus_chunks(doc_ingest(spark, d, "recursive").parsed, CFG, chunker="recursive")
    return ch.select("cik", "accessionNumber", F.col("chunk_ix").cast("long"), "chunk_id", "chunk", "fiscalYear")


@register("ingest_status", _doc_status_sql() + "SELECT input_pos, cik, accessionNumber, reason, chunks FROM st")
def q_ingest_status(spark, d):
    return doc_status(spark, d).select("input_pos", "cik", "accessionNumber", "reason", "chunks")


@register(
    "ingest_summary",
    _doc_status_sql()
    + """SELECT count(*) AS prepared, CAST(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS processed,
         CAST(sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
         CAST(sum(COALESCE(chunks, 0)) AS BIGINT) AS total_chunks FROM st""",
)
def q_ingest_summary(spark, d):
    return ing.summary(doc_status(spark, d))


@register(
    "processed_head",
    _doc_status_sql() + "SELECT input_pos, company FROM st WHERE reason IS NULL ORDER BY input_pos LIMIT 10",
)
def q_processed_head(spark, d):
    """The first ten processed companies, in processing order."""
    st = doc_status(spark, d)
    return st.where(F.col("reason").isNull()).orderBy("input_pos").limit(10).select("input_pos", "company")


@register(
    "ingest_skips",
    _doc_status_sql() + "SELECT cik, reason FROM st WHERE reason IS NOT NULL",
)
def q_ingest_skips(spark, d):
    """K6: the skip table (cik, reason) of the batch."""
    return ing.skips(doc_status(spark, d))


@register(
    "manifest_rows",
    _doc_status_sql()
    + f"""SELECT cik, company, form, filingDate, accessionNumber, url, primaryDocument AS "primary",
              'Item 1A' AS section, CAST(chunks AS INTEGER) AS chunks, '{CFG.embedding_model}' AS embedding_model
         FROM st JOIN (SELECT {dv.sql_doc_filing_meta('d.doc_id')['primaryDocument']} AS primaryDocument,
                              d.doc_id AS input_pos FROM documents d) USING (input_pos)
         WHERE reason IS NULL""",
)
def q_manifest_rows(spark, d):
    """K2: manifest fields of every record."""
    return ing.manifest_rows(doc_status(spark, d), CFG.embedding_model)


@register(
    "corpus_chunks",
    _doc_status_sql()
    + f"""SELECT cik, accessionNumber, chunk_ix,
              sha1(cik || '__' || accessionNumber || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id,
              chunk, TRY_CAST(substring(filingDate, 1, 4) AS INTEGER) AS fiscalYear
         FROM ({sql_fixed_chunks('(SELECT * FROM st JOIN s USING (input_pos) WHERE reason IS NULL)',
                                 'cik, accessionNumber, filingDate', 'section', CFG.chunk_size, CFG.chunk_overlap)})""",
)
def q_corpus_chunks(spark, d):
    """Chunk rows of the successful filings with sha1('{cik}__{acc}__{i}')
    ids and chunk metadata (fixed windows)."""
    ch = ing.corpus_chunks(doc_ingest(spark, d).parsed, CFG, chunker="fixed")
    return ch.select("cik", "accessionNumber", F.col("chunk_ix").cast("long"), "chunk_id", "chunk", "fiscalYear")


def order_pages(spark, d):
    """Fetches the main documents of order-derived filings: the filing page of
    document o_orderkey div 15 (absent when that document does not exist).

    The wanted filings find their document's id first. That list is written, so
    its size is known: a short one is broadcast and no text is shuffled, a long
    one meets every text once, not once per filing."""
    def fetch(wanted):
        o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
        docs = read_table(spark, d, "documents", "doc_id", "text")
        acc = F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100, F.col("o_orderkey"))
        link = o.select(acc.alias("accessionNumber"), F.floor(F.col("o_orderkey") / 15).cast("long").alias("_doc"))
        links = materialize(wanted.join(link, "accessionNumber"), "fetch-list")
        # A number of its own: few texts are many seconds of parsing, so they are
        # not put together into few tasks for being few bytes.
        links = links.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_doc")
        pages = links.join(docs, links["_doc"] == docs["doc_id"])
        return pages.select(*wanted.columns, dv.filing_html(F.col("doc_id"), F.col("text")).alias("html"))

    return fetch


def history_status(spark, d, limit=None):
    c = read_table(spark, d, "customer", "c_custkey")
    ciks = c.select(F.col("c_custkey").cast("string").alias("cik"), F.col("c_custkey").alias("pos"))
    filings, none = ing.history_filings(
        ciks, flat_submissions(spark, d), submission_names(spark, d), n=CFG.top_n_per_cik, limit=limit
    )
    filings = materialize(filings, "filings")  # used for the fetch list and the status
    st = ing.ingest_filings(filings, order_pages(spark, d), urgent_manifest(spark, d), CFG)
    return st.select("cik", "accessionNumber", "reason", "chunks").unionByName(
        none.select("cik", F.lit(None).cast("string").alias("accessionNumber"), "reason",
                    F.lit(None).cast("long").alias("chunks"))
    )


def _history_sql(limit: int | None = None) -> str:
    some = f"(SELECT * FROM customer ORDER BY c_custkey LIMIT {limit})" if limit else "customer"
    forms = "(" + ", ".join(f"'{f}'" for f in HISTORICAL_FORMS) + ")"
    html = dv.sql_filing_html("doc.doc_id", "doc.text")
    return f"""
    WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filingDate DESC, pos) AS rank
                               FROM {SUB_FLAT_SQL} WHERE form IN {forms}) WHERE rank <= {CFG.top_n_per_cik}
                               AND cik IN (SELECT CAST(c_custkey AS VARCHAR) FROM {some})),
    none AS (SELECT CAST(c_custkey AS VARCHAR) AS cik FROM {some}
             WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT cik FROM top)),
    raw AS (SELECT printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accessionNumber,
                   {html} AS html
            FROM orders o JOIN documents doc ON doc.doc_id = o.o_orderkey // 15),
    seen AS (SELECT DISTINCT accessionNumber AS acc FROM {URGENT_SQL}),
    todo AS (SELECT top.*, raw.html FROM top LEFT JOIN raw USING (accessionNumber)
             WHERE accessionNumber NOT IN (SELECT acc FROM seen)),
    s AS {sql_section_select(f"(SELECT accessionNumber, {sql_html_to_text('html')} AS t FROM todo)", 'accessionNumber',
                             't', CFG.min_item1a_chars)},
    st AS (SELECT top.cik, top.accessionNumber,
                  CASE WHEN top.accessionNumber IN (SELECT acc FROM seen) THEN 'already_ingested:' || top.accessionNumber
                       WHEN todo.html IS NULL THEN '{ing.MISSING_DOCUMENT}'
                       WHEN s.section IS NULL THEN top.accessionNumber || ':no_item_1a' END AS reason,
                  s.section
           FROM top LEFT JOIN todo USING (accessionNumber) LEFT JOIN s USING (accessionNumber))
    SELECT cik, accessionNumber, reason,
           CASE WHEN reason IS NULL THEN {sql_fixed_count('length(section)', CFG.chunk_size, CFG.chunk_overlap)} END AS chunks
    FROM st
    UNION ALL
    SELECT cik, NULL, 'no_10k_recent', NULL FROM none
    """


@register("ingest_history", _history_sql())
def q_ingest_history(spark, d):
    return history_status(spark, d)


@register("history_limit", _history_sql(25))
def q_history_limit(spark, d):
    """The historical load of the first 25 companies (the limit is the
    feature)."""
    return history_status(spark, d, limit=25)


# --- daily incremental path over every derived index day (T1, J1, J2, W3, W4) ---

def daily_status(spark, d):
    from ..config import DAILY_FORMS
    from ..operators import filings as fo

    idx = fo.filter_forms(index_rows(spark, d), DAILY_FORMS)
    matched = fo.match_first_submission(idx, flat_submissions(spark, d))
    prepared = fo.prepare_daily(matched, fo.seen_accessions(urgent_manifest(spark, d)), row_key=FILE_ROW_KEY)
    # Written once: matching feeds the fetch list, the status and the skips.
    prepared = materialize(prepared.withColumn("input_pos", F.struct(*FILE_ROW_KEY)), "prepared")
    provided = prepared.where(F.col("status") == "provided").select(
        "input_pos", "cik", "accessionNumber", "primaryDocument", F.col("date_filed").alias("filingDate"),
        "form", "company",
    )
    # The seen filings are skips already.
    st = ing.ingest_filings(provided, order_pages(spark, d), provided.select("accessionNumber").limit(0), CFG)
    missed = prepared.where(F.col("status") == "skip").select(
        "input_pos", "cik", "accessionNumber", "reason", F.lit(None).cast("long").alias("chunks")
    )
    both = st.select("input_pos", "cik", "accessionNumber", "reason", "chunks").unionByName(missed)
    return both.select("input_pos.*", "cik", "accessionNumber", "reason", "chunks")


def daily_sql() -> str:
    html = dv.sql_filing_html("doc.doc_id", "doc.text")
    pos = "{'d': file_date, 'p': file_part, 'l': line_no}"
    return f"""
    WITH dm AS ({DAILY_MATCH_SQL}),
    prov AS (SELECT *, {pos} AS input_pos FROM dm WHERE reason IS NULL),
    firsts AS (SELECT accessionNumber, min(input_pos) AS first_pos FROM prov GROUP BY accessionNumber),
    raw AS (SELECT printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accessionNumber,
                   {html} AS html
            FROM orders o JOIN documents doc ON doc.doc_id = o.o_orderkey // 15),
    todo AS (SELECT f.accessionNumber, raw.html FROM firsts f LEFT JOIN raw USING (accessionNumber)),
    s AS {sql_section_select(f"(SELECT accessionNumber, {sql_html_to_text('html')} AS t FROM todo)",
                             'accessionNumber', 't', CFG.min_item1a_chars)},
    o AS (SELECT todo.accessionNumber,
                 CASE WHEN todo.html IS NULL THEN '{ing.MISSING_DOCUMENT}'
                      WHEN s.section IS NULL THEN todo.accessionNumber || ':no_item_1a' END AS r,
                 {sql_fixed_count('length(s.section)', CFG.chunk_size, CFG.chunk_overlap)} AS n
          FROM todo LEFT JOIN s USING (accessionNumber)),
    st AS (SELECT p.file_date, p.file_part, p.line_no, p.cik, p.accessionNumber,
                  CASE WHEN p.input_pos = f.first_pos THEN o.r
                       WHEN o.r IS NULL THEN 'already_ingested:' || p.accessionNumber ELSE o.r END AS reason,
                  o.n
           FROM prov p JOIN firsts f USING (accessionNumber) JOIN o USING (accessionNumber))
    SELECT file_date, file_part, line_no, cik, accessionNumber, reason, CASE WHEN reason IS NULL THEN n END AS chunks FROM st
    UNION ALL
    SELECT file_date, file_part, line_no, cik, accessionNumber, reason, NULL FROM dm WHERE reason IS NOT NULL
    """


@register("daily_ingest", daily_sql())
def q_daily_ingest(spark, d):
    """T1 over every index day: match, seen check, ingest, first occurrence."""
    return daily_status(spark, d)


# --- several landed documents per filing, a directory listing and bad rows ----

LISTED = (("exhibit.htm", "x"), ("big-annual-10-k-report.htm", "x"), ("a10k.htm", "m"), ("r2.xml", "x"))


def multi_document_batch(spark, d):
    """One filing per document: four landed files, of which the listing picks
    a10k.htm (the shortest 10-K page); every 17th has no accession, every 19th a
    bad date; every 23rd filing comes twice."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    base = docs.select("doc_id", "text", *[v.alias(k) for k, v in meta.items()])
    k = F.col("doc_id")
    filings = base.select(
        F.struct(k.alias("n"), F.lit(0).alias("copy")).alias("input_pos"), "cik", "form", "company",
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("accessionNumber")).alias("accessionNumber"),
        F.when(k % 19 == 0, F.lit("soon")).otherwise(F.col("filingDate")).alias("filingDate"), "primaryDocument")
    again = filings.where(F.col("input_pos.n") % 23 == 0).withColumn(
        "input_pos", F.struct(F.col("input_pos.n").alias("n"), F.lit(1).alias("copy")))
    listing = base.select("accessionNumber", F.posexplode(F.array(*[F.lit(n) for n, _ in LISTED])).alias("pos", "name"))
    main = dv.filing_html(k, F.col("text"))
    landed = base.select("accessionNumber", F.explode(F.array(*[
        F.struct(F.lit(n).alias("primary"), (main if kind == "m" else F.lit("<p>Exhibit</p>")).alias("html"))
        for n, kind in LISTED])).alias("f")).select("accessionNumber", "f.*")
    return filings.unionByName(again), landed, listing


def _multi_sql() -> str:
    m = dv.sql_doc_filing_meta("doc_id")
    url = _url_sql("cik", "accessionNumber", "'a10k.htm'")
    return f"""
    WITH base AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in m.items())},
                         {dv.sql_filing_html('doc_id', 'text')} AS html FROM documents),
    s AS {sql_section_select(f"(SELECT doc_id, {sql_html_to_text('html')} AS t FROM base)", 'doc_id', 't', CFG.min_item1a_chars)},
    f AS (SELECT doc_id, unnest(CASE WHEN doc_id % 23 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM documents),
    j AS (SELECT base.*, f.copy, s.section,
                 CASE WHEN base.doc_id % 17 = 0 THEN '{ing.MISSING_ACCESSION}'
                      WHEN base.doc_id % 19 = 0 THEN '{ing.BAD_DATE}'
                      WHEN s.section IS NULL THEN base.accessionNumber || ':no_item_1a'
                      WHEN f.copy = 1 THEN 'already_ingested:' || base.accessionNumber END AS reason
          FROM base JOIN f USING (doc_id) LEFT JOIN s USING (doc_id))
    SELECT doc_id AS n, copy, cik, reason,
           CASE WHEN reason LIKE 'error:%' THEN NULL ELSE 'a10k.htm' END AS "primary",
           CASE WHEN reason LIKE 'error:%' THEN NULL ELSE {url} END AS url,
           CASE WHEN reason IS NULL THEN {sql_fixed_count('length(section)', CFG.chunk_size, CFG.chunk_overlap)} END AS chunks
    FROM j"""


@register("ingest_multi_document", _multi_sql())
def q_ingest_multi_document(spark, d):
    filings, landed, listing = multi_document_batch(spark, d)
    st = ing.ingest_filings(filings, landed, labels_manifest(spark, d).limit(0), CFG, listings=listing)
    return st.select("input_pos.n", "input_pos.copy", "cik", "reason", "primary", "url", "chunks")
