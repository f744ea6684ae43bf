"""Context assembly, prompts, answers and conversation history (A9, U1, O3,
F15-F19, C1, C2, C4-C6, P10, X2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLANK_QUESTION_REPLY, NOTHING_FOUND_REPLY, PROMPT_TEMPLATE, RagConfig
from ..functions.rag import clean_answer, is_blank, label_item, render_prompt


def merge_sources(hits: list[tuple[DataFrame, str]], cap: int, qid_col: str = "qid") -> DataFrame:
    """U1 + O3: union the hit lists in the given source order (not re-ranked
    by score) and keep the first ``cap`` per question. Each hit frame has
    (qid, rank, ...); adds source and source_ord."""
    tagged = [h.withColumn("source", F.lit(label)).withColumn("source_ord", F.lit(i).cast("long"))
              for i, (h, label) in enumerate(hits)]
    allh = tagged[0]
    for t in tagged[1:]:
        allh = allh.unionByName(t)
    w = Window.partitionBy(qid_col).orderBy("source_ord", "rank")
    return allh.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= cap).drop("_pos")


def assemble_context(items: DataFrame, text_col: str, order_cols=("source_ord", "rank"),
                     qid_col: str = "qid", sep: str = "\n\n") -> DataFrame:
    """Per question, the item texts joined in order. The list per question
    is bounded by the retrieval k (or the merge cap)."""
    packed = F.struct(*[F.col(c) for c in order_cols], F.col(text_col).alias("_t"))
    return items.groupBy(qid_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_t"]), sep).alias("context")
    )


def answer_frame(questions: DataFrame, contexts: DataFrame, generate: Callable[[Column], Column] | None = None,
                 template: str = PROMPT_TEMPLATE, qid_col: str = "qid", question_col: str = "question") -> DataFrame:
    """C1/C2 over a question table: blank guard (P10), prompt (F17), model
    hook (X2), answer clean-up (F18), nothing-found fall-back (F19).

    ``generate`` maps the prompt column to raw model output. No model ships
    with the engine: by default the output is an extract, the first paragraph
    of the context after 'Answer:'; column ``answer_kind`` tells 'model' and
    'extract' apart ('fixed' for the two fixed replies).
    """
    j = questions.join(contexts, qid_col, "left")
    prompt = render_prompt(F.col("context"), F.col(question_col), template)
    raw = generate(prompt) if generate else F.concat(
        F.lit("Answer: "), F.substring_index(F.col("context"), "\n\n", 1)
    )
    blank = is_blank(F.col(question_col))
    return j.select(
        qid_col,
        question_col,
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("context")).alias("context"),
        F.when(blank | F.col("context").isNull(), F.lit(None).cast("string")).otherwise(prompt).alias("prompt"),
        F.when(blank, F.lit(BLANK_QUESTION_REPLY))
        .when(F.col("context").isNull(), F.lit(NOTHING_FOUND_REPLY))
        .otherwise(clean_answer(raw))
        .alias("answer"),
        F.when(blank | F.col("context").isNull(), F.lit("fixed"))
        .otherwise(F.lit("model" if generate else "extract"))
        .alias("answer_kind"),
    )


def source_hits(main: DataFrame, upload: DataFrame | None, cfg: RagConfig = RagConfig(), qid_col: str = "qid") -> DataFrame:
    """The hits a question's context is made of. With an upload both sources
    are merged (C2: labels, main_k + upload_k, merged cap); without one the
    main source alone, unlabelled, counts (C1)."""
    if upload is None:
        return main.where(F.col("rank") <= cfg.retrieval_k).withColumn("source", F.lit(None).cast("string")).withColumn(
            "source_ord", F.lit(0).cast("long"))
    return merge_sources([(main.where(F.col("rank") <= cfg.main_k), cfg.main_label),
                          (upload.where(F.col("rank") <= cfg.upload_k), cfg.upload_label)], cfg.merged_cap, qid_col)


def labelled_items(hits: DataFrame, content_col: str, cfg: RagConfig = RagConfig()) -> DataFrame:
    """F15 + F16: '[source]\\n' + first item_chars characters of the content."""
    pre, post = cfg.label_format.split("{label}")
    return hits.withColumn("item", label_item(F.col(content_col), F.col("source"), cfg.item_chars, pre, post))


# ---------------------------------------------------------------------------
# History (C4-C6)
# ---------------------------------------------------------------------------

def history_append(history: DataFrame, pairs: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """C4: append (question, answer) per conversation as two new turns after
    the last one (turn = max + 1 for the user, max + 2 for the assistant)."""
    last = history.groupBy(conv_col).agg(F.max("turn").alias("_last"))
    p = pairs.join(last, conv_col, "left").withColumn("_base", F.coalesce(F.col("_last"), F.lit(-1)))
    new_rows = p.select(
        conv_col,
        F.explode(
            F.array(
                F.struct((F.col("_base") + 1).cast("long").alias("turn"), F.lit("user").alias("role"),
                         F.col("question").alias("text")),
                F.struct((F.col("_base") + 2).cast("long").alias("turn"), F.lit("assistant").alias("role"),
                         F.col("answer").alias("text")),
            )
        ).alias("r"),
    ).select(conv_col, "r.turn", "r.role", "r.text")
    return history.select(conv_col, "turn", "role", "text").unionByName(new_rows)


def history_pairs(history: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """[user, assistant] pairs: each user turn with the next turn when that
    is an assistant turn."""
    w = Window.partitionBy(conv_col).orderBy("turn")
    nxt = history.withColumn("_next_role", F.lead("role").over(w)).withColumn("_next_text", F.lead("text").over(w))
    return nxt.where((F.col("role") == "user") & (F.col("_next_role") == "assistant")).select(
        conv_col, "turn", F.col("text").alias("user_text"), F.col("_next_text").alias("bot_text")
    )


def history_clear(history: DataFrame, cleared: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Drop the conversations listed in ``cleared``."""
    return history.join(cleared.select(conv_col), conv_col, "left_anti")
