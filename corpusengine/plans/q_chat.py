"""Queries: page assembly, uploads, answers and conversation history
(S11, A9, A10, I5, K4, K5, F12, F18, F19, C4-C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunking import chunk_fixed, chunk_recursive
from ..functions.rag import clean_answer
from ..functions.text import strip_ws
from ..operators import context as cx
from ..sinks import files as sf
from ..sources.pages import assemble_pages
from ..sources.tables import read_table
from .registry import RAG, register
from .sqlfrag import sql_fixed_chunks, sql_recursive_chunks, sql_strip

ASSEMBLED_SQL = f"""(SELECT k.conv_id, {sql_strip("COALESCE(p.body, '')")} AS text
    FROM (SELECT DISTINCT conv_id FROM conversations) k
    LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body
               FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id) p
    ON k.conv_id = p.conv_id)"""


def conversations(spark, d):
    return read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")


@register("ordered_concat", f"SELECT conv_id, text FROM {ASSEMBLED_SQL}")
def q_ordered_concat(spark, d):
    """Every conversation's turns as one text, in turn order."""
    return assemble_pages(conversations(spark, d), "conv_id", "turn")


@register(
    "upload_corpus",
    f"""SELECT conv_id, chunk_ix, chunk, 'upload' AS corpus FROM ({sql_fixed_chunks(
        f"(SELECT * FROM {ASSEMBLED_SQL} WHERE {sql_strip('text')} <> '')", 'conv_id', 'text',
        RAG.upload_chunk_size, RAG.upload_chunk_overlap)})""",
)
def q_upload_corpus(spark, d):
    """Each assembled conversation as an uploaded document, chunked
    1000/200 into an 'upload' corpus; blank documents give no corpus."""
    docs = assemble_pages(conversations(spark, d), "conv_id", "turn")
    docs = docs.where(strip_ws(F.col("text")) != "")
    ch = chunk_fixed(docs, "text", RAG.upload_chunk_size, RAG.upload_chunk_overlap)
    return sf.upload_corpus(ch.select("conv_id", F.col("chunk_ix").cast("long"), "chunk"))


@register(
    "clear_upload",
    f"""SELECT conv_id, chunk_ix, 'main' AS corpus FROM ({sql_fixed_chunks(
        f"(SELECT * FROM {ASSEMBLED_SQL} WHERE {sql_strip('text')} <> '')", 'conv_id', 'text',
        RAG.upload_chunk_size, RAG.upload_chunk_overlap)})""",
)
def q_clear_upload(spark, d):
    """K5: a main and an upload corpus side by side; the upload is cleared."""
    up = q_upload_corpus(spark, d)
    both = up.withColumn("corpus", F.lit("main")).unionByName(up)
    return sf.clear_upload(both).select("conv_id", "chunk_ix", "corpus")


@register(
    "upload_recursive",
    f"""SELECT conv_id, chunk_ix, chunk, 'upload' AS corpus FROM {sql_recursive_chunks(
        f"(SELECT * FROM {ASSEMBLED_SQL} WHERE {sql_strip('text')} <> '')", 'conv_id', 'text',
        RAG.upload_chunk_size, RAG.upload_chunk_overlap)}""",
)
def q_upload_recursive(spark, d):
    """I5/K4 with the recursive splitter (1000/200)."""
    docs = assemble_pages(conversations(spark, d), "conv_id", "turn").where(strip_ws(F.col("text")) != "")
    ch = chunk_recursive(docs, "text", RAG.upload_chunk_size, RAG.upload_chunk_overlap)
    return sf.upload_corpus(ch.select("conv_id", F.col("chunk_ix").cast("long"), "chunk"))


@register(
    "chunk_recursive",
    f"""SELECT doc_id, chunk_ix, chunk_start, chunk_end, chunk FROM {sql_recursive_chunks(
        'documents', 'doc_id', 'text', RAG.upload_chunk_size, RAG.upload_chunk_overlap)}""",
)
def q_chunk_recursive(spark, d):
    """F12 (recursive contract) over every document, with offsets."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    ch = chunk_recursive(docs, "text", RAG.upload_chunk_size, RAG.upload_chunk_overlap, with_offsets=True)
    return ch.select("doc_id", F.col("chunk_ix").cast("long"), "chunk_start", "chunk_end", "chunk")


RAW_ANSWER_SQL = """(CASE WHEN turn % 3 = 0 THEN text
    WHEN turn % 3 = 1 THEN 'Question: what changed?' || chr(10) || 'Answer: ' || text
    ELSE 'Answer: draft' || chr(10) || 'Answer:' || text || '  ' END)"""


def raw_answers(spark, d):
    c = conversations(spark, d).where(F.col("role") == "assistant")
    t = F.col("turn") % 3
    raw = (
        F.when(t == 0, F.col("text"))
        .when(t == 1, F.concat(F.lit("Question: what changed?\nAnswer: "), F.col("text")))
        .otherwise(F.concat(F.lit("Answer: draft\nAnswer:"), F.col("text"), F.lit("  ")))
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


@register(
    "answer_clean",
    f"""SELECT conv_id, turn, {sql_strip(f"string_split({RAW_ANSWER_SQL}, 'Answer:')[-1]")} AS answer
        FROM conversations WHERE role = 'assistant'""",
)
def q_answer_clean(spark, d):
    """model outputs with 'Answer:' markers cleaned to the final answer."""
    return raw_answers(spark, d).select("conv_id", "turn", clean_answer(F.col("raw")).alias("answer"))


def new_pairs(spark, d):
    """Per conversation: its first user question asked again, answered with
    the cleaned last assistant output."""
    c = conversations(spark, d)
    q = c.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    a = raw_answers(spark, d).groupBy("conv_id").agg(F.max_by("raw", "turn").alias("raw"))
    return q.join(a, "conv_id", "left").select("conv_id", "question", clean_answer(F.col("raw")).alias("answer"))


@register(
    "history_append",
    f"""WITH last AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id),
        q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
        a AS (SELECT conv_id, arg_max({RAW_ANSWER_SQL}, turn) AS raw FROM conversations WHERE role = 'assistant'
              GROUP BY conv_id),
        p AS (SELECT q.conv_id, q.question, {sql_strip("string_split(a.raw, 'Answer:')[-1]")} AS answer,
                     COALESCE(last.t, -1) AS base
              FROM q LEFT JOIN a USING (conv_id) LEFT JOIN last USING (conv_id))
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT conv_id, base + 1, 'user', question FROM p
        UNION ALL SELECT conv_id, base + 2, 'assistant', answer FROM p""",
)
def q_history_append(spark, d):
    return cx.history_append(conversations(spark, d), new_pairs(spark, d))


@register(
    "history_pairs",
    """SELECT conv_id, turn, text AS user_text, next_text AS bot_text FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'user' AND next_role = 'assistant'""",
)
def q_history_pairs(spark, d):
    return cx.history_pairs(conversations(spark, d))


@register(
    "history_clear",
    """SELECT conv_id, turn, role, text FROM conversations
       WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def q_history_clear(spark, d):
    """Clear every conversation that has a system turn."""
    c = conversations(spark, d)
    cleared = c.where(F.col("role") == "system").select("conv_id").distinct()
    return cx.history_clear(c, cleared)
