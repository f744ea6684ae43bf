"""Ingestion flows.

One DataFrame plan for a whole batch of filings instead of a loop per filing:

    filings --(J3 company look-up)--> one row per accession (first copy)
    --(J2 seen flag)--(J5 main document)--(S5 html of exactly that document)-->
    F1 text --> F4 section --> F12 chunk count  ==> per-accession outcome
    --> joined back to every input row with W4 first-occurrence rules
    ==> status table (one row per input filing; reason null = record).

The expensive text work runs once per distinct, not-yet-seen accession, in the
scan of the documents; section texts never travel through the status joins.
Errors are per-row reasons, never exceptions that drop a whole company.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REASON_NO_FILINGS, IngestConfig
from ..functions.chunking import chunk_fixed, chunk_id, chunk_recursive, fixed_chunk_count, recursive_span_array
from ..functions.filings import company_or_default, document_url, fiscal_year, parse_filing_date
from ..functions.sections import extract_section
from ..functions.text import html_to_text
from ..operators import filings as fo

STATUS_COLUMNS = (
    "input_pos", "cik", "company", "form", "filingDate", "accessionNumber",
    "primary", "url", "chunks", "reason",
)
RECORD_COLUMNS = ("company", "cik", "filingDate", "form", "accessionNumber", "url", "chunks")
META_COLUMNS = ("cik", "company", "form", "filingDate", "primaryDocument")
MISSING_DOCUMENT = "error:filing document not found"
MISSING_ACCESSION = "error:missing accession number"
BAD_DATE = "error:bad filing date"


@dataclass(frozen=True)
class IngestBatch:
    """Result of one batch: ``status`` (one row per input filing) and
    ``parsed`` (one row per fetched document: accessionNumber, the first copy's
    metadata, primary, url, section)."""

    status: DataFrame
    parsed: DataFrame


def ingest_batch(
    filings: DataFrame,
    raw_html: DataFrame | Callable[[DataFrame], DataFrame],
    seen: DataFrame,
    cfg: IngestConfig = IngestConfig(),
    companies: DataFrame | None = None,
    listings: DataFrame | None = None,
    chunker: str = "fixed",
) -> IngestBatch:
    """Status of every filing of a batch, and its parsed documents.

    filings  : input_pos (any ordered type, e.g. a struct), cik,
               accessionNumber, primaryDocument, filingDate, form (null ->
               '10-K'), company (nullable)
    raw_html : accessionNumber, html, and primary (the document's name) if
               several documents of a filing have landed; only the chosen main
               document is then read. Or a function that fetches: it is given
               the wanted documents (accessionNumber, primary and more, one row
               per filing) and returns these rows with html, one per landed
               document; pages kept under another key need not be spread over
               the filings first
    seen     : accessionNumber (manifest of earlier runs)
    companies: cik, name (look-up for missing company names)
    listings : accessionNumber, pos, name (filing directory items)
    chunker  : 'fixed' (native windows) or 'recursive' (separator-descending
               splitter); the record's chunk count follows the same chunker
               that corpus_chunks uses.

    A filing without an accession or with a date in neither format is a skip
    with an 'error:' reason of its own; it touches no other row."""
    f = filings.withColumn("form", F.coalesce(F.col("form"), F.lit("10-K")))
    if companies is not None:
        f = fo.fill_company(f, companies)
    else:
        f = f.withColumn(
            "company",
            F.when(F.col("company").isNull() | (F.col("company") == ""),
                   company_or_default(F.lit(None).cast("string"), F.col("cik"))).otherwise(F.col("company")),
        )
    f = f.withColumn("_bad", F.when(F.col("accessionNumber").isNull() | (F.col("accessionNumber") == ""),
                                    F.lit(MISSING_ACCESSION))
                     .when(parse_filing_date(F.col("filingDate")).isNull(), F.lit(BAD_DATE)))
    good = f.where(F.col("_bad").isNull())

    # First copy per accession (partial aggregation: a repeated accession
    # costs one row per map task) with the flag of the seen set.
    per_acc = good.groupBy("accessionNumber").agg(
        F.min("input_pos").alias("_first_pos"),
        F.min_by(F.struct(*META_COLUMNS), F.col("input_pos")).alias("_f"),
    )
    seen_set = fo.seen_accessions(seen).withColumn("_seen", F.lit(True))
    acc = per_acc.join(seen_set, "accessionNumber", "left")
    if listings is not None:
        acc = acc.withColumn("primaryDocument", F.col("_f.primaryDocument"))
        acc = fo.with_primary_doc(acc, fo.best_primary_doc(listings, "accessionNumber"), "accessionNumber")
    else:
        acc = acc.withColumn("primary", F.col("_f.primaryDocument"))
    acc = acc.withColumn("url", document_url(F.col("_f.cik"), F.col("accessionNumber"), F.col("primary")))

    # Only documents of filings still to do are parsed. No hint: at run time a
    # small fetch list is broadcast and the documents stream past it.
    todo = acc.where(F.col("_seen").isNull()).select("accessionNumber", "_f", "primary", "url")
    if callable(raw_html):
        found = raw_html(todo)
    elif "primary" in raw_html.columns:
        html = raw_html.select("accessionNumber", "primary", "html")
        found = html.join(todo, ["accessionNumber", "primary"])
    else:
        found = raw_html.select("accessionNumber", "html").join(todo, "accessionNumber")
    section = extract_section(html_to_text(F.col("html")), min_chars=cfg.min_item1a_chars)
    parsed = found.select("accessionNumber", "_f.*", "primary", "url", section.alias("section"))
    outcome = parsed.select(
        "accessionNumber", F.lit(True).alias("_found"),
        F.when(F.col("section").isNull(), F.concat(F.col("accessionNumber"), F.lit(":no_item_1a"))).alias("_reason"),
        _chunk_count(F.col("section"), cfg, chunker).alias("_chunks"),
    )

    per_filing = acc.select("accessionNumber", "_first_pos", "_seen", "primary", "url").join(
        outcome, "accessionNumber", "left")
    already = F.concat(F.lit("already_ingested:"), F.col("accessionNumber"))
    failed = F.when(F.col("_found").isNull(), F.lit(MISSING_DOCUMENT)).otherwise(F.col("_reason"))
    reason = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("_seen").isNotNull(), already)
        .when(F.col("input_pos") == F.col("_first_pos"), failed)
        .when(failed.isNull(), already)
        .otherwise(failed)
    )
    # Rows in error have no partner: they join on a value of their own.
    own = F.concat(F.lit("error:"), F.xxhash64("input_pos").cast("string"))
    left = f.withColumn("_key", F.when(F.col("_bad").isNull(), F.col("accessionNumber")).otherwise(own))
    status = left.join(per_filing.withColumnRenamed("accessionNumber", "_key"), "_key", "left")
    status = status.withColumn("reason", reason).withColumn(
        "chunks", F.when(F.col("reason").isNull(), F.col("_chunks"))
    )
    return IngestBatch(status.select(*STATUS_COLUMNS), parsed)


def ingest_filings(filings: DataFrame, raw_html: DataFrame | Callable[[DataFrame], DataFrame], seen: DataFrame,
                   cfg: IngestConfig = IngestConfig(), companies: DataFrame | None = None, listings: DataFrame | None = None,
                   chunker: str = "fixed") -> DataFrame:
    """The status table of ``ingest_batch``."""
    return ingest_batch(filings, raw_html, seen, cfg, companies, listings, chunker).status


def _chunk_count(section, cfg: IngestConfig, chunker: str):
    if chunker == "recursive":
        return F.size(recursive_span_array(section, cfg.chunk_size, cfg.chunk_overlap)).cast("long")
    return fixed_chunk_count(F.length(section), cfg.chunk_size, cfg.chunk_overlap).cast("long")


def records(status: DataFrame) -> DataFrame:
    """K6: successful filings with the 7 record columns (schema kept if empty)."""
    return status.where(F.col("reason").isNull()).select(*RECORD_COLUMNS)


def skips(status: DataFrame) -> DataFrame:
    """K6: (cik, reason) of every skipped filing."""
    return status.where(F.col("reason").isNotNull()).select("cik", "reason")


def summary(status: DataFrame) -> DataFrame:
    """One-row batch summary."""
    return status.agg(
        F.count(F.lit(1)).alias("prepared"),
        F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).cast("long").alias("processed"),
        F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).cast("long").alias("skipped"),
        F.sum(F.coalesce(F.col("chunks"), F.lit(0))).cast("long").alias("total_chunks"),
    )


def manifest_rows(status: DataFrame, embedding_model: str | None = None) -> DataFrame:
    """K2 rows: one per record, the manifest fields. ``embedding_model`` names
    the embedder that ran (null: none did)."""
    return status.where(F.col("reason").isNull()).select(
        "cik", "company", "form", "filingDate", "accessionNumber", "url", "primary",
        F.lit("Item 1A").alias("section"), F.col("chunks").cast("int").alias("chunks"),
        F.lit(embedding_model).cast("string").alias("embedding_model"),
    )


def corpus_chunks(parsed: DataFrame, cfg: IngestConfig = IngestConfig(), chunker: str = "recursive") -> DataFrame:
    """Chunk rows of the successful filings (documents of a batch with a
    section) with deterministic ids sha1('{cik}__{accession}__{i}') and the
    chunk metadata. The chunks are cut where the document was parsed; a null
    section has none (a filter on it would parse the document twice)."""
    ok = parsed.select(
        "cik", "company", "form", "filingDate", "accessionNumber", "url", "primary", "section",
        fiscal_year(F.col("filingDate")).alias("fiscalYear"),
    )
    split = chunk_recursive if chunker == "recursive" else chunk_fixed
    ch = split(ok, "section", cfg.chunk_size, cfg.chunk_overlap)
    return ch.withColumn(
        "chunk_id", chunk_id(F.col("cik"), F.col("accessionNumber"), F.col("chunk_ix"))
    ).withColumn("section", F.lit("Item 1A"))


def history_filings(ciks: DataFrame, flat_subs: DataFrame, names: DataFrame, n: int = 3,
                    limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """I2/I3 + J4 + W1 + O2: companies -> their newest ``n`` 10-K/10-K/A.

    Returns (filings, skips) where skips are companies without such a filing
    ('no_10k_recent'). ``ciks`` has (cik, pos); ``limit`` keeps the first
    companies by pos (the reference's ordered limit)."""
    if limit is not None:
        ciks = ciks.orderBy("pos").limit(limit)
    top = fo.top_n_filings(flat_subs, n=n)
    found = ciks.select("cik", F.col("pos").alias("cik_pos")).join(top, "cik", "left")
    none = found.where(F.col("rank").isNull()).select("cik", F.lit(REASON_NO_FILINGS).alias("reason"))
    named = names.select("cik", company_or_default(F.col("name"), F.col("cik")).alias("company"))
    filings = found.where(F.col("rank").isNotNull()).join(named, "cik", "left").select(
        "cik", "company", "form", "accessionNumber", "primaryDocument", "filingDate",
        F.struct("cik_pos", "rank").alias("input_pos"),
    )
    return filings, none
