"""Toxicity scores: gradient-boosted trees over dense features, calibrated by
isotonic regression.

Labelled rows fall into folds by crc32(doc_id) mod ``FOLDS``. Fold 0 is held
out. Folds 1 and 2 give the lexicon (words and word beginnings that surely
mark toxic texts) and the calibration, folds 3 and 4 the
trees, so the trees see lexicon densities as they are on unseen texts. At most
``max_labels`` labelled rows are used to fit (a documented bound); every row is
scored, over its whole text.

Features come from one map-only pass. The lexicon (at most ``max_lexicon``
entries) and the trees are bounded; neither grows with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FOLDS = 5
STEMS = (4, 5, 6)
# Pronouns of the second person (en, de, fr, es).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tuyo tus".split())
# Characters that stand in for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
                          "!": "i", "*": None, ".": None, "-": None, "_": None, "+": "t"})
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…¿¡"
FEATURES = ("words", "density", "hits", "distinct", "window", "near_you", "you", "capitals", "marks", "symbols",
            "disguised_hits", "disguised", "stretched")
NEAR = 5
WINDOW = 50
STRETCHED = re.compile(r"([^\W\d_])\1\1")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def in_lexicon(word: str, lexicon: frozenset[str]) -> bool:
    return word in lexicon or any(word[:n] + "*" in lexicon for n in STEMS)


def text_features(text: str | None, lexicon: frozenset[str], seen: dict[str, bool]) -> list[float]:
    """Dense features of one whole text (null: as the empty text); ``seen``
    remembers lexicon answers for words."""
    text = text or ""
    tokens = text.split()
    words = [t.strip(EDGE) for t in text.lower().split()]
    n = max(1, len(tokens))
    hits, you, odd = [], [], []
    for i, w in enumerate(words):
        hit = seen.get(w)
        if hit is None:
            hit = seen[w] = in_lexicon(w, lexicon)
        if hit:
            hits.append(i)
        if w in SECOND_PERSON:
            you.append(i)
        if not w.isalpha() and w:
            odd.append(w)
    disguised = [w for w in odd if any(c.isalpha() for c in w) and not w.replace("'", "").replace("’", "").isalpha()]
    disguised_hits = sum(in_lexicon(w.translate(DISGUISE), lexicon) for w in disguised)
    most, low = 0, 0
    for high, at in enumerate(hits):
        while at - hits[low] >= WINDOW:
            low += 1
        most = max(most, high - low + 1)
    near, k = 0, 0
    for at in hits:
        while k < len(you) and you[k] < at - NEAR:
            k += 1
        near += k < len(you) and you[k] <= at + NEAR
    letters = sum(map(len, words)) or 1
    upper = sum(1 for c in text if c.isupper())
    marks = text.count("!") + text.count("?")
    symbols = sum(map(text.count, "#*$%&@"))
    stretched = len(STRETCHED.findall(text))
    return [float(len(tokens)), len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})),
            most / min(n, WINDOW), near / n, len(you) / n, upper / letters, marks / n, symbols / n,
            disguised_hits / n, len(disguised) / n, stretched / n]


def with_features(docs: DataFrame, lexicon: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, features) for every row, map-only."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words = frozenset(lexicon)
        seen: dict[str, bool] = {}
        for b in batches:
            rows = []
            for t in b.column(1):
                rows.append(text_features(t.as_py(), words, seen))
                if len(seen) > 200_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["doc_id", "features"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, features array<double>")


def learn_lexicon(labelled: DataFrame, max_lexicon: int = 400, min_texts: int = 3, least_share: float = 0.5) -> list[str]:
    """Words, and beginnings written ``abcd*``, that mark toxic texts: the share
    of toxic ones among the texts that hold them is surely (95 % Wilson bound)
    at least ``least_share``. Those that mark most texts come first. Exact
    copies of a text count once."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = F.array_distinct(F.flatten(F.array(words, *[
        F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
        for n in STEMS])))
    once = labelled.select("toxic", "text").dropDuplicates()
    counts = once.select("toxic", F.explode(stems).alias("w")).filter(F.length("w") > 2).groupBy("w").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    share, zz = F.col("a") / F.col("n"), 1.96 ** 2
    bound = (share + zz / (2 * F.col("n")) - F.sqrt(zz * (share * (1 - share) + zz / (4 * F.col("n"))) / F.col("n"))) / (
        1 + zz / F.col("n"))
    best = counts.filter(F.col("a") >= min_texts).withColumn("bound", bound).filter(F.col("bound") >= least_share)
    return [r["w"] for r in best.orderBy(F.desc(F.col("a") * F.col("bound")), "w").limit(max_lexicon).collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", max_labels: int = 20_000, max_lexicon: int = 400,
                    trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Only the text makes a score. Null texts are empty; they are scored too.
    Labels that are null or have no id are passed over; of repeated labels the
    higher counts. Rows without an id are scored and not held out. Without two
    labelled texts of each kind every score is the share of toxic labels (0
    without labels). Repeated rows stay repeated; an empty table gives an empty
    result."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold(F.col("doc_id")))
    # The bounded sample of labelled rows: smallest hashes first.
    sample = scratch.write(known.filter("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lexicon = learn_lexicon(texts.join(F.broadcast(sample.filter("fold IN (1, 2)")), "doc_id"), max_lexicon)

    rows = scratch.write(with_features(texts, lexicon, "doc_id", "text"), "features")
    rows = rows.withColumn("features", array_to_vector("features"))
    labelled = scratch.write(rows.join(F.broadcast(sample), "doc_id")
                             .select("features", F.col("toxic").cast("double").alias("label"), "fold"), "labelled")
    train = labelled.filter("fold IN (3, 4)").coalesce(4)
    kinds = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(kinds.get(0.0, 0), kinds.get(1.0, 0)) < 2:
        share = labelled.agg(F.avg("label")).first()[0] or 0.0
        scored = rows.withColumn("score", F.lit(float(share)))
    else:
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
                              subsamplingRate=0.8, seed=11).fit(train)

        def scores(df: DataFrame) -> DataFrame:
            return model.transform(df).withColumn("p", vector_to_array("probability")[1])

        fit = scores(labelled.filter("fold IN (1, 2)")).select("p", "label").coalesce(4)
        calibrated = None
        if fit.limit(1).count():
            calibrated = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="iso").fit(fit)
        scored = scores(rows)
        if calibrated is not None:
            # The steps of the calibration keep the order of the trees inside.
            scored = calibrated.transform(scored).withColumn("p", 0.999 * F.col("iso") + 0.001 * F.col("p"))
        scored = scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
