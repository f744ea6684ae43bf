"""Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from corpusengine.llm import jaccard


def shingles(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([b" ".join(w)]) if len(w) < words else frozenset(
        b" ".join(w[i:i + words]) for i in range(len(w) - words + 1))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for family in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        if family % 3 == 0:
            words += passage  # long passages that unlike documents share
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    out += [" ".join(passage)] * 3 + ["a b c", "A  b\tc", "a b", None, "", " \n", "été ÉTÉ x y z", "ÉTÉ été x y z"]
    return [(i, t) for i, t in enumerate(out)]


def test_components(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(jaccard.jaccard_components(df)) == brute(rows)


def test_parts_and_hot_tokens_lose_no_link(spark, monkeypatch):
    # Tiny limits: families are split over many parts, most tokens come last.
    monkeypatch.setattr(jaccard, "PART_TOKENS", 700)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 2)
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 3)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(jaccard.jaccard_components(df)) == brute(rows)


def test_awkward_rows(spark):
    long_text = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, "p q r s t"), (1, "p q r s t"), (None, "P Q R S T"), (None, "only here it is"), (4, None), (None, None),
            (6, long_text), (5, long_text + " more")]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id bigint, text string, k string, token int")
    assert result(jaccard.jaccard_components(df)) == brute(rows)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_components(empty).collect() == []
    with pytest.raises(ValueError):
        jaccard.jaccard_components(df, percent=0)


def test_shingle_sets():
    cases = ["a b c d e", "a b c d a b c d", "", None, "a b", "b a", "a b", " a\nb\tc\x0bd ", "A B C D", "a b c d e"]
    tokens, n = jaccard.shingle_sets(pa.array(cases), 4)
    own = [frozenset(x.tolist()) for x in np.split(tokens, np.cumsum(n)[:-1])]
    want = [shingles(t) for t in cases]
    assert [len(s) for s in own] == [len(s) for s in want]
    for i, j in combinations(range(len(cases)), 2):
        assert (own[i] == own[j]) == (want[i] == want[j])
        assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_linked_sets_share_enough_prefix_tokens():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 200)
        a = set(rng.sample(range(400), n))
        b = set(a)
        for x in rng.sample(sorted(a), min(n - 1, rng.randint(0, n // 8 + 1))):
            b.discard(x)
        b |= set(rng.sample(range(400), rng.randint(0, n // 12)))
        both = len(a & b)
        if 100 * both >= 85 * len(a | b):
            first = [set(sorted(s)[:int(jaccard.prefix_length(len(s), 85))]) for s in (a, b)]
            assert len(first[0] & first[1]) >= min(jaccard.shares(len(a)), jaccard.shares(len(b)))
