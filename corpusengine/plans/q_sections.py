"""Queries: section extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sections import extract_section
from ..sources.tables import read_table
from .derived import filing_text, sql_filing_text
from .registry import CFG, register
from .sqlfrag import sql_section_select


@register(
    "section_extract",
    f"""
    SELECT doc_id, section, CAST(length(section) AS BIGINT) AS section_len
    FROM {sql_section_select(f"(SELECT doc_id, {sql_filing_text('doc_id', 'text')} AS t FROM documents)",
                             'doc_id', 't', CFG.min_item1a_chars)}
    """,
)
def q_section_extract(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    sec = extract_section(filing_text(F.col("doc_id"), F.col("text")), min_chars=CFG.min_item1a_chars)
    return docs.select("doc_id", sec.alias("section")).withColumn(
        "section_len", F.length("section").cast("bigint")
    )
