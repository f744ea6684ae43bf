"""Window containment against a direct scan."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from corpusengine.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    found = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[tuple(w[i:i + n])].add(str(item))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in found:
                    hit.update(range(i, i + n))
                    ids |= found[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def made(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "über", "x1", "日本"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 12, 13, 20, 30])))) for i in range(12)]
    items += [(3, items[0][1]), (50, None), (51, " .. "), (52, "the"), (9, items[9][1])]
    docs = []
    for i in range(60):
        text = rng.choices(vocab, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").upper().split() if rng.random() < 0.5 else words(rng.choice(items)[1])
        docs.append((i % 50 if i % 11 else None, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(70, None), (71, ""), (72, "THE"), docs[5], docs[5]], items


@pytest.mark.parametrize("seed, block", [(1, 100_000), (2, 100_000), (3, 20)])
def test_like_brute_force(spark, monkeypatch, seed, block):
    """A small block makes several passes over the documents."""
    monkeypatch.setattr(decontam, "MAX_WINDOWS", block)
    docs, items = made(seed)
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                                 spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_vocabulary_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_VOCABULARY", 3)
    docs, items = made(4)
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                 spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    row = decontam.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert decontam.contamination(docs.limit(0), none).count() == 0
    assert decontam.drop_contaminated(docs, none).count() == 1


def test_drop_keeps_columns_and_clean_rows(spark):
    docs, items = made(5)
    df = spark.createDataFrame([(i, t, "w", 7) for i, t in docs], "doc_id bigint, text string, win string, n_words int")
    kept = decontam.drop_contaminated(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == df.columns
    bad = [b[5] for b in brute(docs, items)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(
        ((i, t) for (i, t), x in zip(docs, bad) if not x), key=key)


def test_no_python_in_the_plan(spark):
    docs, items = made(6)
    df = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                spark.createDataFrame(items, "item_id bigint, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
