"""Registered queries: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, codes, decontam, hmm_lm, jaccard, oracles, packing, quality_kn, quality_rules, secrets, simhash, token_counts, toxicity, url_filter
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def packing_tokenizer() -> str:
    """Place of the vocabulary that packing uses (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


@register("op10_quality_rules", oracles.quality_rules_sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    order = quality_rules.cascade_order(docs, quality_rules.BASE_RULES + quality_rules.METHOD_RULES)
    # Which rule rejects first depends on measured costs; the verdict does not.
    return quality_rules.apply_cascade(docs, order=order).drop("text", "rejected_by")


@register("op2_decontam", oracles.decontam_sql())
def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents", "doc_id", "text"),
                                  read(spark, sf_dir, "benchmark", "item_id", "text"))


@register("op8_secrets", oracles.secrets_sql())
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), packing_tokenizer())


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    import public_tokenizers

    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents", "doc_id", "text"),
                                    read(spark, sf_dir, "labels", "doc_id", "toxic"))


@register("op9_url_filter", oracles.url_filter_sql())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages", "page_id", "url"))


@register("op6_quality_kn")
def op6_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    judged = quality_kn.judge(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("doc_id", "lang", judged["_chars"].alias("n_symbols"), judged["_lp"].alias("log10_prob"),
                         judged["_ppl"].alias("perplexity"), judged["_limit"].alias("threshold"),
                         judged["_rep"].alias("repeated"), judged["_rep_limit"].alias("repeated_threshold"),
                         judged["_keep"].alias("kept"))


@register("op7_hmm_lm")
def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = toxicity.fold(F.col("doc_id"))
    scored = hmm_lm.score_texts(read(spark, sf_dir, "documents", "doc_id", "text"), fold != 1)
    return scored.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op11_centroids", centroids.centroids_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@register("op12_jaccard_join")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


@register("op13_vector_codes", codes.codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
