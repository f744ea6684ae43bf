"""Queries: retrieval, contexts, prompts and answers (V1-V5, J6, W2, P9,
U1, O3, A9, F15-F19, C1, C2, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BLANK_QUESTION_REPLY, NOTHING_FOUND_REPLY, PROMPT_TEMPLATE, RagConfig
from ..operators import codes as pq
from ..operators import context as cx
from ..operators import retrieval as rt
from ..operators.embed import hash_counts, model_embed, model_generate
from ..session import materialize, scratch_path
from ..sinks import corpus as sc
from ..sources.tables import read_table
from .derived import sql_str
from .registry import RAG, register
from .sqlfrag import sql_strip

# --- shared SQL ------------------------------------------------------------
E_SQL = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
CENTROID_SQL = f"""(SELECT CAST(label AS BIGINT) AS qid, list(x ORDER BY i) AS qv FROM (
    SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM {E_SQL})
    GROUP BY label, i) GROUP BY label)"""
QUESTION_TEXT_SQL = (
    "(CASE WHEN qid % 5 = 4 THEN '   ' ELSE 'What are the main risks in group ' || CAST(qid AS VARCHAR) || '?' END)"
)


def embeddings(spark, d):
    return read_table(spark, d, "embeddings", "vec_id", "embedding", "label")


def centroid_questions(spark, d):
    """Question vectors: the mean vector of every label (whole table)."""
    c = rt.vector_mean(embeddings(spark, d), "label", "embedding")
    # Written once: the questions are asked of several corpora and joined again.
    return materialize(c.select(F.col("label").cast("long").alias("qid"), F.col("embedding").alias("qvec")), "questions")


def question_text(qid):
    return F.when(qid % 5 == 4, F.lit("   ")).otherwise(
        F.concat(F.lit("What are the main risks in group "), qid.cast("string"), F.lit("?"))
    )


def _topk_sql(score_expr: str, order: str, k: int, where: str = "TRUE", corpus: str = E_SQL) -> str:
    return f"""SELECT qid, rank, vec_id, round(score, 6) AS score FROM (
        SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) AS rank
        FROM (SELECT q.qid, e.vec_id, {score_expr} AS score FROM {CENTROID_SQL} q, {corpus} e WHERE {where}))
      WHERE rank <= {k}"""


def _hits(spark, d, metric="cosine", k=RAG.retrieval_k, **kw):
    h = rt.knn(
        embeddings(spark, d), centroid_questions(spark, d), k, metric=metric,
        id_col="vec_id", vec_col="embedding", qid_col="qid", qvec_col="qvec", **kw,
    )
    return h


@register("knn_exact", _topk_sql("list_cosine_similarity(e.v, q.qv)", "DESC", RAG.retrieval_k))
def q_knn_exact(spark, d):
    h = _hits(spark, d, "cosine")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_l2", _topk_sql("list_distance(e.v, q.qv)", "ASC", RAG.retrieval_k))
def q_knn_l2(spark, d):
    h = _hits(spark, d, "l2")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_dot", _topk_sql("list_inner_product(e.v, q.qv)", "DESC", RAG.retrieval_k))
def q_knn_dot(spark, d):
    h = _hits(spark, d, "dot")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register(
    "knn_filtered",
    _topk_sql("list_cosine_similarity(e.v, q.qv)", "DESC", RAG.retrieval_k, where="e.label = q.qid"),
)
def q_knn_filtered(spark, d):
    qs = centroid_questions(spark, d).withColumn("qlabel", F.col("qid").cast("int"))
    h = rt.knn(
        embeddings(spark, d), qs, RAG.retrieval_k, metric="cosine", id_col="vec_id", vec_col="embedding",
        qid_col="qid", qvec_col="qvec", filter_col="label", q_filter_col="qlabel",
    )
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register(
    "knn_self",
    f"""SELECT qid, rank, vec_id, round(score, 6) AS score FROM (
        SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(e.v, q.v) AS score
              FROM {E_SQL} q, {E_SQL} e WHERE q.vec_id % 100 = 0))
      WHERE rank <= {RAG.retrieval_k}""",
)
def q_knn_self(spark, d):
    """The stated query set (every vector whose id is divisible by 100) against
    the whole table, block by block."""
    e = embeddings(spark, d)
    qs = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    h = rt.knn(e, qs, RAG.retrieval_k, metric="cosine", id_col="vec_id", vec_col="embedding",
               qid_col="qid", qvec_col="qvec")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


# --- dual corpus ------------------------------------------------------------
MAIN_SQL = f"(SELECT * FROM {E_SQL} WHERE label % 2 = 0)"
UPLOAD_SQL = f"(SELECT * FROM {E_SQL} WHERE label % 2 = 1)"
CONTENT_SQL = "COALESCE(doc.text, 'vector ' || CAST(h.vec_id AS VARCHAR))"


def _dual_sql(cfg=RAG) -> str:
    main = _topk_sql("list_cosine_similarity(e.v, q.qv)", "DESC", cfg.main_k, corpus=MAIN_SQL)
    up = _topk_sql("list_cosine_similarity(e.v, q.qv)", "DESC", cfg.upload_k, corpus=UPLOAD_SQL)
    return f"""(SELECT h.qid, h.source_ord, h.rank, h.vec_id, h.source, {CONTENT_SQL} AS content FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source_ord, rank) AS pos FROM (
          SELECT qid, rank, vec_id, 0::BIGINT AS source_ord, '{RAG.main_label}' AS source FROM ({main})
          UNION ALL
          SELECT qid, rank, vec_id, 1::BIGINT AS source_ord, '{RAG.upload_label}' AS source FROM ({up})))
        h LEFT JOIN documents doc ON doc.doc_id = h.vec_id WHERE pos <= {RAG.merged_cap})"""


def dual_hits(spark, d, qs=None):
    e = embeddings(spark, d)
    qs = centroid_questions(spark, d) if qs is None else qs
    kw = dict(metric=RAG.metric, id_col="vec_id", vec_col="embedding", qid_col="qid", qvec_col="qvec")
    main = rt.knn(e.where(F.col("label") % 2 == 0), qs, RAG.main_k, **kw)
    up = rt.knn(e.where(F.col("label") % 2 == 1), qs, RAG.upload_k, **kw)
    merged = cx.source_hits(main, up, RAG)
    docs = read_table(spark, d, "documents", "doc_id", "text")
    j = merged.join(docs, merged.vec_id == docs.doc_id, "left")
    return j.select(
        "qid", "source_ord", "rank", "vec_id", "source",
        F.coalesce(F.col("text"), F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("content"),
    )


ITEM_SQL = f"'[' || source || ']' || chr(10) || substring(content, 1, {RAG.item_chars})"


@register(
    "dual_retrieval",
    f"SELECT qid, source_ord, rank, vec_id, {ITEM_SQL} AS item FROM {_dual_sql()}",
)
def q_dual_retrieval(spark, d):
    items = cx.labelled_items(dual_hits(spark, d), "content", RAG)
    return items.select("qid", "source_ord", "rank", "vec_id", "item")


# --- contexts, prompts and answers -------------------------------------------

LABEL_QUESTIONS_SQL = f"SELECT qid, {QUESTION_TEXT_SQL} AS question FROM {CENTROID_SQL}"


def _answer_sql(context_sql: str, questions: str = LABEL_QUESTIONS_SQL, raw: str | None = None, kind: str = "extract") -> str:
    from ..functions.rag import template_parts

    prompt = " || ".join(sql_str(v) if k == "lit" else v for k, v in template_parts(PROMPT_TEMPLATE))
    raw = raw.format(prompt=prompt) if raw else "'Answer: ' || split_part(context, chr(10) || chr(10), 1)"
    return f"""SELECT qid, question,
        CASE WHEN (question IS NULL OR {sql_strip('question')} = '') THEN NULL ELSE context END AS context,
        CASE WHEN (question IS NULL OR {sql_strip('question')} = '') OR context IS NULL THEN NULL ELSE {prompt} END AS prompt,
        CASE WHEN (question IS NULL OR {sql_strip('question')} = '') THEN {sql_str(BLANK_QUESTION_REPLY)}
             WHEN context IS NULL THEN {sql_str(NOTHING_FOUND_REPLY)}
             ELSE {sql_strip(f"string_split({raw}, 'Answer:')[-1]")} END AS answer,
        CASE WHEN (question IS NULL OR {sql_strip('question')} = '') OR context IS NULL THEN 'fixed' ELSE '{kind}' END
          AS answer_kind
      FROM ({questions}) qs
      LEFT JOIN ({context_sql}) c USING (qid)"""


def _asked(qs):
    return qs.select("qid", question_text(F.col("qid")).alias("question"))


@register(
    "rag_context",
    _answer_sql(
        f"""SELECT qid, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM (
            SELECT h.qid, h.rank, {CONTENT_SQL} AS content
            FROM ({_topk_sql('list_cosine_similarity(e.v, q.qv)', 'DESC', RAG.retrieval_k)}) h
            LEFT JOIN documents doc ON doc.doc_id = h.vec_id) GROUP BY qid"""
    ),
)
def q_rag_context(spark, d):
    """Single corpus, k = 5, contents joined by blank lines."""
    qs = centroid_questions(spark, d)
    main = rt.knn(embeddings(spark, d), qs, RAG.retrieval_k, metric=RAG.metric, id_col="vec_id", vec_col="embedding",
                  qid_col="qid", qvec_col="qvec")
    hits = cx.source_hits(main, None, RAG)
    docs = read_table(spark, d, "documents", "doc_id", "text")
    h = hits.join(docs, hits.vec_id == docs.doc_id, "left").select(
        "qid", "rank",
        F.coalesce(F.col("text"), F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("content"),
    )
    ctx = cx.assemble_context(h, "content", order_cols=("rank",))
    return cx.answer_frame(_asked(qs), ctx)


@register(
    "rag_prompt",
    _answer_sql(
        f"""SELECT qid, string_agg({ITEM_SQL}, chr(10) || chr(10) ORDER BY source_ord, rank) AS context
            FROM {_dual_sql()} GROUP BY qid"""
    ),
)
def q_rag_prompt(spark, d):
    """Two corpora (3 + 4, cap 6), labelled 500-character items."""
    qs = centroid_questions(spark, d)
    items = cx.labelled_items(dual_hits(spark, d, qs), "content", RAG)
    ctx = cx.assemble_context(items, "item")
    return cx.answer_frame(_asked(qs), ctx)


THREE = RagConfig(main_k=3, upload_k=3, label_format="[From {label}]\n")


def _three_sql() -> str:
    item = f"'[From ' || source || ']' || chr(10) || substring(content, 1, {THREE.item_chars})"
    return f"""SELECT qid, source_ord, rank, vec_id, {item} AS item FROM {_dual_sql(THREE)}"""


@register("dual_three", _three_sql())
def q_dual_three(spark, d):
    """C2 variant: three and three hits under '[From ...]' labels."""
    e, qs = embeddings(spark, d), centroid_questions(spark, d)
    kw = dict(metric=THREE.metric, id_col="vec_id", vec_col="embedding", qid_col="qid", qvec_col="qvec")
    hits = cx.source_hits(rt.knn(e.where(F.col("label") % 2 == 0), qs, THREE.main_k, **kw),
                          rt.knn(e.where(F.col("label") % 2 == 1), qs, THREE.upload_k, **kw), THREE)
    docs = read_table(spark, d, "documents", "doc_id", "text")
    h = hits.join(docs, hits.vec_id == docs.doc_id, "left").withColumn(
        "content", F.coalesce(F.col("text"), F.concat(F.lit("vector "), F.col("vec_id").cast("string"))))
    return cx.labelled_items(h, "content", THREE).select("qid", "source_ord", "rank", "vec_id", "item")


# --- approximate search and embeddings (no SQL equivalent) -------------------

@register("knn_approx")
def q_knn_approx(spark, d):
    """V4: IVF over KMeans cells, as many of them probed as a measured recall of
    0.9 asks for; questions = the vectors whose id divides by 100."""
    e = embeddings(spark, d)
    model, cells = rt.ivf_cells(e, "embedding")
    # Written once: cells are assigned by the model and read several times.
    cells = materialize(cells, "ivf_cells")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    nprobe, _ = rt.choose_nprobe(cells, asked, model, RAG.retrieval_k, id_col="vec_id")
    qs = rt.probe_cells(asked, model, "qvec", nprobe)
    h = rt.knn(cells, qs, RAG.retrieval_k, metric="cosine", id_col="vec_id", vec_col="embedding",
               qid_col="qid", qvec_col="qvec", cell_col="cell", q_cells_col="cells")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_approx_all_cells", _topk_sql("list_cosine_similarity(e.v, q.qv)", "DESC", RAG.retrieval_k))
def q_knn_approx_all_cells(spark, d):
    """V4 with every cell probed, over the stored cell layout: exact."""
    model, cells = rt.ivf_cells(embeddings(spark, d), "embedding", nlist=16)
    path = scratch_path(spark, "ivf")
    rt.write_ivf_corpus(cells, path, id_col="vec_id")
    h = rt.knn_ivf(path, centroid_questions(spark, d), model, RAG.retrieval_k, nprobe=16, id_col="vec_id",
                   vec_col="embedding", qid_col="qid", qvec_col="qvec")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


SELF_SQL = f"""SELECT qid, rank, vec_id, round(score, 6) AS score FROM (
        SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(e.v, q.v) AS score
              FROM {E_SQL} q, {E_SQL} e WHERE q.vec_id % 100 = 0))
      WHERE rank <= {RAG.retrieval_k}"""


def code_index(spark, d):
    """The whole table encoded and stored by cell, its index, and the questions
    (ids divisible by 100)."""
    e = embeddings(spark, d)
    index = pq.fit_codes(e)
    path = scratch_path(spark, "codes")
    rt.write_ivf_corpus(pq.encode(e, index), path, id_col="vec_id")
    coded = spark.read.parquet(path)
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return pq.measure(index, coded), coded, asked


@register("knn_codes", SELF_SQL)
def q_knn_codes(spark, d):
    """V4 over product codes, exact: answers that the bounds do not prove are
    asked again."""
    index, coded, asked = code_index(spark, d)
    h = pq.knn_codes(coded, asked, index, RAG.retrieval_k, nprobe=4, shortlist=20 * RAG.retrieval_k, exact=True, id_col="vec_id")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_codes_approx")
def q_knn_codes_approx(spark, d):
    """V4 over product codes, as many cells and as long a shortlist as a measured
    recall of 0.9 asks for."""
    index, coded, asked = code_index(spark, d)
    nprobe, size, _ = pq.choose_probes(coded, asked, index, RAG.retrieval_k, id_col="vec_id")
    h = pq.knn_codes(coded, asked, index, RAG.retrieval_k, nprobe, size, id_col="vec_id")
    return h.select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("embed_tfidf")
def q_embed_tfidf(spark, d):
    """V1: lexical 384-d unit vectors of every document (Spark ML pipeline)."""
    from ..operators.embed import tfidf_embed

    docs = read_table(spark, d, "documents", "doc_id", "text")
    emb = tfidf_embed(docs, "text", dim=384)
    return emb.select(
        "doc_id",
        F.size("embedding").cast("long").alias("dim"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"),
    )


@register("benchmark_retrieval")
def q_benchmark_retrieval(spark, d):
    """V1 + F12 + V2 end to end on real text: every document chunked
    (1000/200) and embedded with the lexical TF-IDF embedder fitted on the
    chunks, every benchmark passage asked as a question with the same model,
    top-5 chunks per passage."""
    from ..functions.chunking import chunk_fixed
    from ..operators.embed import apply_tfidf, fit_tfidf

    docs = read_table(spark, d, "documents", "doc_id", "text")
    chunks = chunk_fixed(docs, "text", RAG.upload_chunk_size, RAG.upload_chunk_overlap)
    chunks = chunks.select("doc_id", "chunk_ix", "chunk")
    model = fit_tfidf(chunks, "chunk", dim=1024)
    cid = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_ix").cast("string"))
    corpus = apply_tfidf(model, chunks, "chunk").select(cid.alias("cid"), "embedding")
    bench = read_table(spark, d, "benchmark", "item_id", "text")
    qs = apply_tfidf(model, bench, "text").select(F.col("item_id").alias("qid"), F.col("embedding").alias("qvec"))
    h = rt.knn(corpus, qs, RAG.retrieval_k, metric="cosine", id_col="cid", vec_col="embedding",
               qid_col="qid", qvec_col="qvec")
    at = F.split("cid", ":")
    return h.select(
        F.col("qid").alias("item_id"), "rank", at[0].cast("long").alias("doc_id"), at[1].cast("long").alias("chunk_ix"),
        F.round("score", 6).alias("score"))


# --- text to answer on the engine's own corpus --------------------------------

HASH_DIM = 256
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_hash_vector(src: str, key: str, text: str) -> str:
    """Subquery (key, b, n): token counts of the hash embedder's buckets."""
    bucket = f"CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {HASH_DIM}"
    return f"""(SELECT {key}, {bucket} AS b, CAST(count(*) AS DOUBLE) AS n FROM (
        SELECT {key}, unnest(regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '[a-z0-9]+')) AS t FROM {src})
        GROUP BY 1, 2)"""


@register("embed_hash", f"SELECT doc_id, b AS bucket, n AS weight FROM {sql_hash_vector('documents', 'doc_id', 'text')}")
def q_embed_hash(spark, d):
    """The hash embedder's vectors, as their non-zero entries."""
    docs = read_table(spark, d, "documents", "doc_id", "text")
    v = docs.select("doc_id", F.posexplode(model_embed(F.col("text"), hash_counts(HASH_DIM))).alias("bucket", "weight"))
    return v.where("weight > 0").select("doc_id", F.col("bucket").cast("long"), F.col("weight").cast("double"))


def prompt_lengths():
    """A deterministic stand-in for a language model."""
    return lambda prompts: [f"Question: ...\nAnswer: {len(p)} characters read " for p in prompts]


def _ask_sql() -> str:
    from .q_ingest import _doc_status_sql
    from .registry import CFG
    from .sqlfrag import sql_fixed_chunks

    chunks = sql_fixed_chunks("(SELECT * FROM st JOIN s USING (input_pos) WHERE reason IS NULL)",
                              "cik, accessionNumber, form", "section", CFG.chunk_size, CFG.chunk_overlap)
    questions = """SELECT item_id AS qid, CASE WHEN item_id % 10 = 9 THEN '   ' ELSE text END AS question,
        CASE WHEN item_id % 7 = 3 THEN 'S-1' ELSE '10-K' END AS form FROM benchmark"""
    answers = _answer_sql(
        f"""SELECT qid, string_agg(chunk, chr(10) || chr(10) ORDER BY rank) AS context FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
              SELECT q.qid, c.chunk_id, any_value(c.chunk) AS chunk,
                     sum(qv.n * cv.n) / (any_value(qn.x) * any_value(cn.x)) AS score
              FROM q JOIN ch c ON c.form = q.form JOIN qv ON qv.qid = q.qid JOIN cv ON cv.chunk_id = c.chunk_id AND cv.b = qv.b
              JOIN qn ON qn.qid = q.qid JOIN cn ON cn.chunk_id = c.chunk_id GROUP BY q.qid, c.chunk_id))
            WHERE rank <= {RAG.retrieval_k} GROUP BY qid""",
        questions="SELECT qid, question FROM q",
        raw="'Question: ...' || chr(10) || 'Answer: ' || CAST(length({prompt}) AS VARCHAR) || ' characters read '",
        kind="model")
    return _doc_status_sql() + f""",
    ch AS (SELECT *, sha1(cik || '__' || accessionNumber || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id FROM ({chunks})),
    q AS ({questions}),
    cv AS {sql_hash_vector('ch', 'chunk_id', 'chunk')}, cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS x FROM cv GROUP BY 1),
    qv AS {sql_hash_vector('q', 'qid', 'question')}, qn AS (SELECT qid, sqrt(sum(n * n)) AS x FROM qv GROUP BY 1)
    """ + answers


@register("ask_corpus", _ask_sql())
def q_ask_corpus(spark, d):
    """The whole way: filings -> chunks -> vectors -> stored corpus; benchmark
    texts as questions, embedded by the same model -> hits of the wanted form
    -> context -> prompt -> model -> answer (blank questions and questions
    without a hit get the fixed replies)."""
    from . import ingest as ing
    from .q_ingest import doc_ingest
    from .registry import CFG

    chunks = ing.corpus_chunks(doc_ingest(spark, d).parsed, CFG, chunker="fixed")
    vector = model_embed(F.col("chunk"), hash_counts(HASH_DIM))
    rows = chunks.withColumn("embedding", vector).withColumn("version", F.lit(1).cast("long"))
    store = scratch_path(spark, "corpus")
    sc.upsert_corpus(rows, store, "1", partition_by=["fiscalYear"])
    corpus = sc.read_corpus(spark, store, ["cik", "accessionNumber"])

    bench = read_table(spark, d, "benchmark", "item_id", "text")
    asked = bench.select(
        F.col("item_id").alias("qid"), F.when(F.col("item_id") % 10 == 9, F.lit("   ")).otherwise(F.col("text")).alias("question"),
        F.when(F.col("item_id") % 7 == 3, F.lit("S-1")).otherwise(F.lit("10-K")).alias("qform"))
    asked = materialize(asked.withColumn("qvec", model_embed(F.col("question"), hash_counts(HASH_DIM))), "asked")
    hits = rt.knn(corpus, asked, RAG.retrieval_k, id_col="chunk_id", vec_col="embedding", qid_col="qid", qvec_col="qvec",
                  filter_col="form", q_filter_col="qform")
    items = cx.source_hits(hits, None, RAG).join(corpus.select("chunk_id", "chunk"), "chunk_id")
    context = cx.assemble_context(items, "chunk", order_cols=("rank",))
    return cx.answer_frame(asked.select("qid", "question"), context, generate=lambda p: model_generate(p, prompt_lengths))
