"""Column functions for filing identifiers, URLs, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ARCHIVE_BASE, DAILY_INDEX_BASE
from .text import safe_name, strip_ws


def cik10(cik: Column) -> Column:
    """Zero-pad to 10 characters; longer values stay whole (lpad would cut)."""
    c = cik.cast("string")
    return F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)


def archive_base(cik: Column, accession: Column, base: str = ARCHIVE_BASE) -> Column:
    """Archive folder URL: cik without leading zeros, accession without dashes."""
    cik_nolead = cik.cast("string").cast("bigint").cast("string")
    return F.concat(F.lit(base), cik_nolead, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def document_url(cik: Column, accession: Column, primary: Column) -> Column:
    return F.concat(archive_base(cik, accession), F.lit("/"), primary)


def daily_index_url(d: Column, base: str = DAILY_INDEX_BASE) -> Column:
    """Daily master index location for a date: year/QTRq/master.yyyyMMdd.idx."""
    return F.concat(
        F.lit(base),
        F.year(d).cast("string"),
        F.lit("/QTR"),
        F.quarter(d).cast("string"),
        F.lit("/master."),
        F.date_format(d, "yyyyMMdd"),
        F.lit(".idx"),
    )


def parse_filing_date(s: Column) -> Column:
    """Date from 'yyyy-MM-dd' or 'yyyyMMdd'; anything else -> null."""
    s = strip_ws(s)
    return F.coalesce(
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd")),
        F.when(s.rlike(r"^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd")),
    )


def fiscal_year(filing_date: Column) -> Column:
    """First four characters of the filing date as int; null when absent."""
    return F.substring(filing_date, 1, 4).try_cast("int")


def company_or_default(name: Column, cik: Column) -> Column:
    """Given name, or 'CIK <cik>' when missing/empty; then stripped."""
    return strip_ws(
        F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("CIK "), cik.cast("string")))
    )


def file_safe_form(form: Column) -> Column:
    """Form as used in file names ('/' would open a sub-folder)."""
    return F.replace(form, F.lit("/"), F.lit("-"))


def artifact_name(
    filing_date: Column, cik: Column, company: Column, form: Column, accession: Column
) -> Column:
    return F.concat(
        F.concat_ws(
            "__", filing_date, cik, safe_name(company), file_safe_form(form), accession
        ),
        F.lit(".txt"),
    )
