"""Statistics and verdicts of the rule cascade against plain Python."""

import random
import re
from collections import Counter

import pytest

from corpusengine.llm import quality_rules as qr

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPACE.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    lines = (text or "").split("\n")
    for line in lines:
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    letters = [c for w in words for c in w if c.isalpha()]
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    upper = sum(c.isupper() for c in letters)
    failed = n < 50 or 100 * len(hit) > 50 * n
    junk = (10 * symbols > 3 * n or (len(letters) >= 50 and 10 * upper > 6 * len(letters)) or chars > 40 * n
            or 2 * chars < 3 * n or (len(lines) >= 4 and 10 * dup > 5 * len(lines)))
    return n, chars, symbols, dup, len(hit), failed, not failed and not junk


def made(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Été", "THE", "x*", "$$", "日本", "word", "über", "…", "NBSP here", "x\x85y"]
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\x0by\x0cz\x1cq"]
    for _ in range(120):
        size = rng.choice([5, 49, 50, 51, 80, 200])
        words = [rng.choice(vocab[:rng.randint(1, len(vocab))]) + str(rng.randint(0, 99)) for _ in range(size)]
        if rng.random() < 0.4:
            words[size // 2:] = words[:size - size // 2]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t", " \n"]) for w in words))
    texts += ["same line here\n" * 30 + " ".join(f"w{i}" for i in range(40)), "WORD" * 30 + " UPPER" * 60]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    texts = made(seed)
    df = spark.createDataFrame([(i, t, 4, "n") for i, t in enumerate(texts)],
                               "doc_id bigint, text string, n_words int, kept string").repartition(3)
    got = {r.doc_id: r for r in qr.apply_cascade(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(t), t
        assert r.kept == (r.rejected_by is None)


def test_order_changes_cost_not_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made(3))], "doc_id bigint, text string")
    rules = qr.BASE_RULES + qr.METHOD_RULES
    order = qr.cascade_order(df, rules)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules)
    one = {r.doc_id: r.kept for r in qr.apply_cascade(df, order=order).collect()}
    two = {r.doc_id: r.kept for r in qr.apply_cascade(df, order=list(reversed(rules))).collect()}
    assert one == two


def test_rules_that_reject_more_per_cost_come_first(spark):
    df = spark.createDataFrame([(i, "short") for i in range(30)], "doc_id bigint, text string")
    assert qr.cascade_order(df, qr.BASE_RULES + qr.METHOD_RULES)[0].name == "few_words"


def test_empty_table(empty_docs):
    rules = qr.BASE_RULES + qr.METHOD_RULES
    assert qr.cascade_order(empty_docs, rules) == list(rules)
    assert qr.apply_cascade(empty_docs).count() == 0


def test_long_text_and_plan(spark):
    text = " ".join(f"w{i}" for i in range(150_000)) + " w1 w2 w3"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    out = qr.apply_cascade(df)
    assert out.first().n_repeat_words == 6
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
