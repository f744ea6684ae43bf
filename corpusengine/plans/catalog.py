"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them) and returns
a DataFrame; the oracle SQL derives the same inputs with the same rules.
Integer outputs are BIGINT on both sides, floats are rounded, dates are
rendered as 'yyyy-MM-dd' strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk_fixed, chunk_id
from ..functions.text import html_to_text
from ..sources.tables import read_table

from .registry import CFG, ORACLE, QUERIES, register  # noqa: F401
from .sqlfrag import sql_fixed_chunks, sql_html_to_text


# ---------------------------------------------------------------------------
# Text: HTML to text, chunking, ids
# ---------------------------------------------------------------------------

@register("html_to_text", f"SELECT page_id, {sql_html_to_text('html')} AS text FROM pages")
def q_html_to_text(spark, d):
    pages = read_table(spark, d, "pages", "page_id", "html")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


# References and tags that are easily read wrongly, one per page.
ODD_MARKUP = (
    "caf&eacute; &rarr; &dagger;", "&#00000169; &#xA9; &#0; &#99999999;", "&NotEqualTilde;&fjlig;&bogus;&amp;lt;",
    "<a title=\"a>b\" href='x>y'>quoted</a>", "<a title=\"open>ends</a>", "&#x1F600;&#xD800;&#2;ITEM 1A",
    "a < b &lt;i&gt; <3",
)


def sql_odd_html() -> str:
    odd = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in ODD_MARKUP) + "]"
    return f"('<p>' || {odd}[page_id % {len(ODD_MARKUP)} + 1] || '</p>' || html)"


@register("html_references", f"SELECT page_id, {sql_html_to_text(sql_odd_html())} AS text FROM pages")
def q_html_references(spark, d):
    """F1 on every page with odd references, quoted '>' and marks put in front."""
    pages = read_table(spark, d, "pages", "page_id", "html")
    odd = F.element_at(F.array(*[F.lit(m) for m in ODD_MARKUP]), (F.col("page_id") % len(ODD_MARKUP) + 1).cast("int"))
    return pages.select("page_id", html_to_text(F.concat(F.lit("<p>"), odd, F.lit("</p>"), F.col("html"))).alias("text"))


@register(
    "chunk_fixed",
    sql_fixed_chunks("documents", "doc_id", "text", CFG.chunk_size, CFG.chunk_overlap),
)
def q_chunk_fixed(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    out = chunk_fixed(docs, "text", CFG.chunk_size, CFG.chunk_overlap)
    return out.select("doc_id", F.col("chunk_ix").cast("bigint"), "chunk")


@register(
    "chunk_ids",
    f"""
    SELECT doc_id, chunk_ix, sha1(CAST(doc_id AS VARCHAR) || '__' || source || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id,
           length(chunk) AS chunk_len
    FROM ({sql_fixed_chunks('documents', 'doc_id, source', 'text', CFG.chunk_size, CFG.chunk_overlap)})
    """,
)
def q_chunk_ids(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "source", "text")
    ch = chunk_fixed(docs, "text", CFG.chunk_size, CFG.chunk_overlap)
    return ch.select(
        "doc_id",
        F.col("chunk_ix").cast("bigint"),
        chunk_id(F.col("doc_id"), F.col("source"), F.col("chunk_ix")).alias("chunk_id"),
        F.length("chunk").cast("bigint").alias("chunk_len"),
    )


@register(
    "chunks_per_doc",
    f"""
    SELECT doc_id, count(*) AS n_chunks,
           CAST(ceil(count(*) / {CFG.batch_size}.0) AS BIGINT) AS n_batches,
           max(length(chunk)) AS max_chunk_len
    FROM ({sql_fixed_chunks('documents', 'doc_id', 'text', CFG.chunk_size, CFG.chunk_overlap)})
    GROUP BY doc_id
    """,
)
def q_chunks_per_doc(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    ch = chunk_fixed(docs, "text", CFG.chunk_size, CFG.chunk_overlap)
    return ch.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.ceil(F.count(F.lit(1)) / F.lit(CFG.batch_size)).cast("bigint").alias("n_batches"),
        F.max(F.length("chunk")).cast("bigint").alias("max_chunk_len"),
    )


def pages_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: raw pages -> clean text -> overlapping chunks with stable ids."""
    pages = read_table(spark, d, "pages", "page_id", "url", "html")
    text = pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))
    ch = chunk_fixed(text, "text", CFG.chunk_size, CFG.chunk_overlap)
    return ch.select(
        "page_id",
        F.col("chunk_ix").cast("bigint"),
        chunk_id(F.col("page_id"), F.col("url"), F.col("chunk_ix")).alias("chunk_id"),
        "chunk",
    )


register(
    "pages_to_chunks",
    f"""
    SELECT page_id, chunk_ix,
           sha1(CAST(page_id AS VARCHAR) || '__' || url || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id,
           chunk
    FROM ({sql_fixed_chunks(f"(SELECT page_id, url, {sql_html_to_text('html')} AS text FROM pages)",
                             'page_id, url', 'text', CFG.chunk_size, CFG.chunk_overlap)})
    """,
)(pages_to_chunks)


# Topic modules register their queries on import.
from . import q_chat, q_daily, q_filings, q_ingest, q_io, q_retrieval, q_sections  # noqa: E402,F401
