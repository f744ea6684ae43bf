"""Toxicity: features by hand, held-out accuracy, awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusengine.llm import toxicity as tx

LEX = frozenset(["idiot", "scum", "vequ*"])


def features(text):
    return dict(zip(tx.FEATURES, tx.text_features(text, LEX, {})))


def test_features():
    f = features("You absolute IDIOT! vequno scum ... 1d1ot aaaargh #$")
    assert f["words"] == 9 and f["hits"] == 3 and f["distinct"] == 3
    assert f["near_you"] == pytest.approx(3 / 9) and f["you"] == pytest.approx(1 / 9)
    assert f["disguised_hits"] == pytest.approx(1 / 9) and f["stretched"] > 0 and f["symbols"] > 0
    assert features("calm words only")["hits"] == 0
    assert features(None) == features("") and all(x == x for x in features("").values())


def test_window_density():
    text = "idiot " * 10 + "calm " * 500 + "scum"
    assert features(text)["window"] == pytest.approx(10 / tx.WINDOW)


def made(n, seed=0):
    rng = random.Random(seed)
    bad = ["moron", "trash", "loser", "vequno", "vequta", "vequre", "vequli"]
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}" if rng.random() < 0.2 else "plain" + "abcdef"[rng.randint(0, 5)] * 2 for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = made(1500)
    extra = [(None, "moron"), (5000, None), (5001, ""), docs[3]]
    out = tx.toxicity_scores(spark.createDataFrame(docs + extra, DOCS).repartition(3),
                             spark.createDataFrame(labels + [(None, 1, 1), (7000, 1, None), labels[0]], LABELS), trees=8).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert not next(r for r in out if r.doc_id is None).held_out


def test_scores_do_not_follow_held_out_labels(spark):
    docs, labels = made(400, 2)
    df = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    held = tx.fold(F.col("doc_id")) == 0
    turned = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in tx.toxicity_scores(df, x, trees=4).collect()} for x in (lab, turned))
    assert one == two


def test_few_labels(spark, empty_docs):
    df = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in tx.toxicity_scores(df, none).collect()} == {0.0}
    assert tx.toxicity_scores(empty_docs, none).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], LABELS)
    assert {r.predicted for r in tx.toxicity_scores(df, one).collect()} == {1}
