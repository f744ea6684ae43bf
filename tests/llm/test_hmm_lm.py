"""The hidden Markov model against brute force on small sequences."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.llm import hmm_lm, toxicity


def parameters(states=3, seed=1):
    rng = np.random.default_rng(seed)
    emit = rng.random((hmm_lm.CLASSES, states))
    move = rng.random((states, states))
    start = rng.random(states)
    return hmm_lm.Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(p, seq):
    """Every state path of a sequence and its probability."""
    k = len(p.start)
    for states in itertools.product(range(k), repeat=len(seq)):
        x = p.start[states[0]] * p.emit[seq[0], states[0]]
        for a, b, c in zip(states, states[1:], seq[1:]):
            x *= p.move[a, b] * p.emit[c, b]
        yield states, x


def test_forward_is_exact():
    p, rng = parameters(), random.Random(1)
    seqs = [[rng.randrange(hmm_lm.CLASSES) for _ in range(n)] for n in (1, 4, 2, 6, 1, 5)]
    got = hmm_lm.forward_log10(p, np.array([c for s in seqs for c in s]), np.array([len(s) for s in seqs]))
    assert np.allclose(got, [math.log10(sum(x for _, x in paths(p, s))) for s in seqs])


def test_expected_counts_are_exact():
    p, rng = parameters(2), random.Random(2)
    seqs = [[rng.randrange(5) for _ in range(n)] for n in (3, 1, 5, 2)]
    start, move, emit, like = hmm_lm.expected_counts(p, np.array([c for s in seqs for c in s]), np.array([len(s) for s in seqs]))
    s2, m2, e2 = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm_lm.CLASSES, 2))
    total = 0.0
    for seq in seqs:
        z = sum(x for _, x in paths(p, seq))
        total += math.log10(z)
        for states, x in paths(p, seq):
            s2[states[0]] += x / z
            for t, (state, c) in enumerate(zip(states, seq)):
                e2[c, state] += x / z
                if t:
                    m2[states[t - 1], state] += x / z
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2) and like == pytest.approx(total)


def test_no_underflow_on_long_sequences():
    p = parameters()
    out = hmm_lm.forward_log10(p, np.zeros(60_000, np.int64), np.array([60_000]))
    assert np.isfinite(out).all() and out[0] < -100_000


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(3)
    size = np.full(200, 30)
    classes = np.concatenate([rng.integers(10, size=30) + 10 * (i % 2) for i in range(200)])
    total = np.bincount(classes, minlength=hmm_lm.CLASSES).astype(float)
    p, before = parameters(2), -math.inf
    for _ in range(8):
        start, move, emit, like = hmm_lm.expected_counts(p, classes, size)
        assert like >= before - 1.0  # smoothing may cost a little
        before, p = like, hmm_lm.Parameters.estimate(start, move, emit, total)


def corpus(n=120):
    rng = random.Random(9)
    kinds = ["the of and word other thing".split(), "der die und wort andere ding".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) + rng.choice(["", "", "s", str(rng.randint(0, 9))])
                         for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Never SEEN before\x1cx"), (None, "the of"), (3, rows[3][1])]


@pytest.mark.parametrize("block", [60, 800_000])
def test_counts_and_base_scores(spark, monkeypatch, block):
    monkeypatch.setattr(hmm_lm, "BLOCK_WORDS", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, train int, block int").repartition(3)
    out = hmm_lm.score_texts(df, toxicity.fold(F.col("doc_id")) != 1, states=2, passes=1).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    train = Counter()
    for i, w in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(w)
    n, v = sum(train.values()), len(train)
    expected = sorted((str(i), len(w), sum(x in train for x in w), n,
                       round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)


@pytest.mark.parametrize("hot", [1, 5, 10_000])
def test_hot_words_change_no_count(spark, monkeypatch, hot):
    """Counts come from the broadcast or from the join, by how common a word is."""
    monkeypatch.setattr(hmm_lm, "HOT", hot)
    rows = [(b, i, w.encode(), n) for b in range(6) for i, (w, n) in enumerate(
        [("the", 3), (f"only{b}", 1), ("x" * 100, 2), ("unseen", 0)])]
    words = spark.createDataFrame(rows, "block bigint, i int, word binary, n bigint")
    totals = words.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")).filter("c > 0")
    got = sorted(tuple(r) for r in hmm_lm.known_counts(words, totals, 18).collect())
    assert got == sorted(x for b in range(6) for x in [(b, 0, 18), (b, 1, 1), (b, 2, 12)])


def test_seed_sample_covers_all_blocks(spark, monkeypatch):
    """The sample that seeds the states is bounded, and drawn from every block."""
    monkeypatch.setattr(hmm_lm, "BLOCK_WORDS", 2_000)
    rows = [(i, " ".join([f"w{i // 100}"] * 63)) for i in range(1_000)]
    blocks = hmm_lm.encode_blocks(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).select(
        "doc_id", F.lit(True).alias("train"), "text"))
    classes, size = hmm_lm.sample_segments(blocks, 10_000, 64_000)
    assert 8_000 < size.sum() <= 10_000 and len(classes) == size.sum()
    assert {hmm_lm.word_class(f"w{k}".encode()) for k in range(10)} <= set(classes.tolist())
    assert len(hmm_lm.sample_segments(blocks, 0, 64_000)[0]) == 0


def test_better_than_the_base_on_held_out_texts(spark):
    df = spark.createDataFrame(corpus(400), "doc_id bigint, text string").repartition(3)
    fold = toxicity.fold(F.col("doc_id"))
    out = hmm_lm.score_texts(df, fold != 1, states=4, passes=2).filter("doc_id IS NOT NULL").withColumn("f", toxicity.fold(F.col("doc_id")))
    held = [r for r in out.collect() if r.f == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_word_probabilities_sum_to_one():
    """Known words of a class and its unseen mass."""
    counts = np.array([5.0, 1.0, 1.0])
    total, kinds = counts.sum(), len(counts)
    assert ((counts - hmm_lm.DISCOUNT) / total).sum() + hmm_lm.DISCOUNT * kinds / total == pytest.approx(1)


def test_empty_and_untrained(spark, empty_docs):
    assert hmm_lm.score_texts(empty_docs, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = hmm_lm.score_texts(one, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_model_comes_from_all_training_text(spark):
    """Whole scores, against passes over every training segment from the start on."""
    rows = [(i, t) for i, t in corpus(60) if i is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = hmm_lm.score_texts(df, toxicity.fold(F.col("doc_id")) != 1, states=2, passes=2).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in rows]
    classes = [np.array([hmm_lm.word_class(x) for x in w]) for _, w in tokens]
    learnt = [k for k, (i, _) in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for k in learnt for x in tokens[k][1])
    total, kinds = np.zeros(hmm_lm.CLASSES), np.zeros(hmm_lm.CLASSES)
    for w, c in counts.items():
        total[hmm_lm.word_class(w)] += c
        kinds[hmm_lm.word_class(w)] += 1
    p = hmm_lm.seed_parameters(total, 2)
    lengths = np.array([len(c) for c in classes])
    own, size = hmm_lm.segments(lengths, np.isin(np.arange(len(rows)), learnt), np.concatenate(classes))
    for _ in range(2):
        p = hmm_lm.Parameters.estimate(*hmm_lm.expected_counts(p, own, size)[:3], total)

    def inside(w):
        c, k = counts[w], hmm_lm.word_class(w)
        return (c - hmm_lm.DISCOUNT) / total[k] if c else hmm_lm.DISCOUNT * kinds[k] / total[k] if total[k] else 1.0

    full = hmm_lm.forward_log10(p, np.concatenate(classes), lengths)
    expected = sorted((i, len(w), round(f + sum(math.log10(inside(x)) for x in w), 6)) for (i, w), f in zip(tokens, full))
    assert sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == expected
