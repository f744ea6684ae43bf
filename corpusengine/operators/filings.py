"""Filing-list operators: index parsing, selection, matching and de-duplication.

All are DataFrame -> DataFrame compositions of joins, windows and
higher-order functions; none collects data to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    DAILY_FORMS,
    HISTORICAL_FORMS,
    MASTER_INDEX_HEADER,
    REASON_ALREADY_INGESTED,
    REASON_ALREADY_SEEN,
    REASON_NOT_IN_SUBMISSIONS,
)
from ..functions.filings import company_or_default, parse_filing_date
from ..functions.text import LINE_BREAK, strip_ws

INDEX_FIELDS = ("cik", "company", "form", "date_filed", "filename")
RECENT_FIELDS = ("form", "accessionNumber", "primaryDocument", "filingDate")


# ---------------------------------------------------------------------------
# Master index text -> rows
# ---------------------------------------------------------------------------

def parse_master_index(files: DataFrame, text_col: str = "text", header: str = MASTER_INDEX_HEADER) -> DataFrame:
    """Rows of pipe-separated index files.

    Lines before the first line whose stripped form starts with ``header`` are
    skipped (no header -> no rows); after it, lines with exactly five fields
    are kept and every field is stripped. Adds ``line_no`` (1-based line
    number in its file). Other input columns are kept.
    """
    keep = [c for c in files.columns if c != text_col]
    # Each step is its own projection so the split lines, the header position
    # and the split fields are computed once per file / line.
    lined = files.select(*keep, F.split(F.col(text_col), LINE_BREAK).alias("_lines"))
    lines = F.col("_lines")
    hdr = F.array_position(
        F.transform(lines, lambda ln: ln.contains(header) & strip_ws(ln).startswith(header)), True
    )
    with_hdr = lined.select(*keep, "_lines", hdr.alias("_hdr"))
    body = F.when(F.col("_hdr") > 0, F.slice(lines, (F.col("_hdr") + 1).cast("int"), F.size(lines))).otherwise(
        F.array().cast("array<string>")
    )
    exploded = with_hdr.select(*keep, "_hdr", F.posexplode(body).alias("_pos", "_line"))
    split_rows = exploded.select(*keep, "_hdr", "_pos", F.split(F.col("_line"), r"\|").alias("_parts"))
    parts = F.col("_parts")
    out = split_rows.where(F.size(parts) == 5).select(
        *keep,
        (F.col("_hdr") + F.col("_pos") + 1).cast("bigint").alias("line_no"),
        *[strip_ws(parts.getItem(i)).alias(n) for i, n in enumerate(INDEX_FIELDS)],
    )
    return out


def filter_forms(df: DataFrame, forms=DAILY_FORMS, col: str = "form") -> DataFrame:
    """Keep rows whose form is one of ``forms``."""
    return df.where(F.col(col).isin(list(forms)))


# ---------------------------------------------------------------------------
# S3: submissions struct-of-arrays -> one row per filing
# ---------------------------------------------------------------------------

def flatten_submissions(subs: DataFrame, recent_col: str = "filings.recent", keep=("cik", "name")) -> DataFrame:
    """Zip the parallel arrays of ``filings.recent`` into rows with ``pos``.

    Missing arrays count as empty; shorter arrays give nulls (arrays_zip).
    """
    arrays = [
        F.coalesce(F.col(f"{recent_col}.{f}"), F.array().cast("array<string>")).alias(f)
        for f in RECENT_FIELDS
    ]
    z = subs.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "r"))
    return z.select(*keep, F.col("pos").cast("bigint"), *[F.col(f"r.{f}").alias(f) for f in RECENT_FIELDS])


# ---------------------------------------------------------------------------
# Newest n filings of the wanted forms per company
# ---------------------------------------------------------------------------

def top_n_filings(
    filings: DataFrame,
    n: int = 3,
    forms=HISTORICAL_FORMS,
    key: str = "cik",
    date_col: str = "filingDate",
    pos_col: str = "pos",
) -> DataFrame:
    """Per company, the ``n`` latest filings by date string, input order on
    ties (the stable sort of the original); adds ``rank`` (1-based)."""
    w = Window.partitionBy(key).orderBy(F.col(date_col).desc(), F.col(pos_col).asc())
    ranked = filter_forms(filings, forms).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------------------
# Index row -> first submission of same cik, form and date
# ---------------------------------------------------------------------------

def match_first_submission(
    index_rows: DataFrame,
    sub_rows: DataFrame,
    match: str = "first",
) -> DataFrame:
    """Left join index rows to submission rows on (cik, form, filing date),
    both dates parsed from 'yyyy-MM-dd' or 'yyyyMMdd'. With ``match='first'``
    only the first submission (by ``pos``) is kept for each index row;
    ``match='all'`` keeps every match. Unmatched rows keep null accession.
    """
    idx = index_rows.withColumn("_d", parse_filing_date(F.col("date_filed")))
    subs = sub_rows.select(
        F.col("cik").alias("_cik"),
        F.col("form").alias("_form"),
        parse_filing_date(F.col("filingDate")).alias("_sd"),
        "pos",
        "accessionNumber",
        "primaryDocument",
    )
    if match == "first":
        # One row per key first (partial aggregation), so the join adds no rows
        # and needs no window over the index rows.
        subs = subs.groupBy("_cik", "_form", "_sd").agg(
            F.min_by(F.struct("pos", "accessionNumber", "primaryDocument"), F.col("pos")).alias("_s")
        ).select("_cik", "_form", "_sd", "_s.*")
    cond = (idx.cik == subs._cik) & (idx.form == subs._form) & (idx._d == subs._sd)
    return idx.join(subs, cond, "left").drop("_cik", "_form", "_sd", "_d")


def prepare_daily(matched: DataFrame, seen: DataFrame, seen_col: str = "accessionNumber",
                  row_key=("file_date", "line_no")) -> DataFrame:
    """Status of matched index rows: 'provided', or a skip with reason
    'already_seen' / 'not_found_in_submissions_recent'.

    Rows without an accession match nothing; they join on a value of their own
    (prefix and row), so they do not meet in one partition."""
    s = seen.select(F.col(seen_col).alias("_seen")).where(F.col("_seen").isNotNull()).distinct()
    own = F.concat_ws(":", F.lit("none"), *[F.col(c).cast("string") for c in row_key])
    j = matched.withColumn("_key", F.coalesce(F.col("accessionNumber"), own))
    j = j.join(s, j._key == s._seen, "left")
    reason = (
        F.when(F.col("accessionNumber").isNull(), F.lit(REASON_NOT_IN_SUBMISSIONS))
        .when(F.col("_seen").isNotNull(), F.lit(REASON_ALREADY_SEEN))
    )
    return j.withColumn("reason", reason).drop("_seen", "_key").withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("provided")).otherwise(F.lit("skip"))
    )


# ---------------------------------------------------------------------------
# Seen-set anti join and its skips
# ---------------------------------------------------------------------------

def seen_accessions(manifest: DataFrame, col: str = "accessionNumber") -> DataFrame:
    """A3: distinct non-blank accessions of a manifest."""
    return manifest.select(F.col(col).alias("accessionNumber")).where(
        F.col("accessionNumber").isNotNull() & (F.col("accessionNumber") != "")
    ).distinct()


def drop_seen(filings: DataFrame, seen: DataFrame, col: str = "accessionNumber") -> DataFrame:
    """Filings whose accession is not in the seen set (left anti join).

    No broadcast hint: the seen set grows with the corpus; AQE turns the join
    into a broadcast at run time when the set is small."""
    return filings.join(seen.select(F.col("accessionNumber").alias(col)), col, "left_anti")


def seen_skips(filings: DataFrame, seen: DataFrame, col: str = "accessionNumber") -> DataFrame:
    """Filings already seen, with reason 'already_ingested:{acc}' (left semi)."""
    hit = filings.join(seen.select(F.col("accessionNumber").alias(col)), col, "left_semi")
    return hit.withColumn(
        "reason", F.concat(F.lit(REASON_ALREADY_INGESTED.split("{")[0]), F.col(col))
    )


# ---------------------------------------------------------------------------
# First occurrence inside one batch
# ---------------------------------------------------------------------------

def first_occurrence_status(
    batch: DataFrame,
    outcome_reason: Column,
    key: str = "accessionNumber",
    order_col: str = "input_pos",
) -> DataFrame:
    """Status of every filing of a batch processed in ``order_col`` order.

    ``outcome_reason`` is the skip reason a filing gets when processed (null =
    success). The first copy of a key gets its own outcome; a later copy is
    'already_ingested:{key}' if the first succeeded and otherwise repeats the
    first copy's reason. The first copy per key comes from a grouped
    ``min_by`` (partially aggregated before the shuffle, so a hot key costs
    one row per map task), joined back on the key.
    """
    firsts = batch.groupBy(key).agg(
        F.min(order_col).alias("_first_pos"),
        F.min_by(F.struct(outcome_reason.alias("r")), F.col(order_col)).alias("_first"),
    )
    j = batch.join(firsts, key, "inner")
    first_reason = F.col("_first.r")
    dup_reason = F.when(
        first_reason.isNull(),
        F.concat(F.lit(REASON_ALREADY_INGESTED.split("{")[0]), F.col(key)),
    ).otherwise(first_reason)
    reason = F.when(F.col(order_col) == F.col("_first_pos"), first_reason).otherwise(dup_reason)
    return j.withColumn("reason", reason).drop("_first_pos", "_first")


# ---------------------------------------------------------------------------
# Company name only when missing
# ---------------------------------------------------------------------------

def fill_company(filings: DataFrame, companies: DataFrame, key: str = "cik") -> DataFrame:
    """Keep a given company; for missing/empty ones look up ``name`` by cik,
    default 'CIK <cik>', stripped. Only keys that need a look-up are joined."""
    need = filings.where(F.col("company").isNull() | (F.col("company") == "")).select(key).distinct()
    names = companies.select(key, F.col("name").alias("_name")).join(need, key, "left_semi")
    j = filings.join(names, key, "left")
    filled = F.when(
        F.col("company").isNull() | (F.col("company") == ""),
        company_or_default(F.col("_name"), F.col(key)),
    ).otherwise(F.col("company"))
    return j.withColumn("company", filled).drop("_name")


# ---------------------------------------------------------------------------
# Main document of a filing
# ---------------------------------------------------------------------------

def is_main_doc_name(name: Column) -> Column:
    low = F.lower(name)
    return (low.endswith(".htm") | low.endswith(".html")) & (
        low.contains("10-k") | low.contains("10k")
    )


def best_primary_doc(items: DataFrame, key: str, name_col: str = "name", pos_col: str = "pos") -> DataFrame:
    """Per filing key: the shortest qualifying name, first listed on ties.

    A grouped ``min_by`` (partial aggregation before the shuffle), not a sort.
    """
    cand = items.where(is_main_doc_name(F.col(name_col)))
    return cand.groupBy(key).agg(
        F.min_by(F.col(name_col), F.struct(F.length(name_col), F.col(pos_col))).alias("best_doc")
    )


def with_primary_doc(filings: DataFrame, best: DataFrame, key: str, default_col: str = "primaryDocument") -> DataFrame:
    """Left join the chosen document; fall back to the default."""
    return filings.join(best, key, "left").withColumn(
        "primary", F.coalesce(F.col("best_doc"), F.col(default_col))
    ).drop("best_doc")
