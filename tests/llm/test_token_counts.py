"""Attribution: every token exactly once, against a character-by-character rule."""

import random

import numpy as np
import public_tokenizers
import pytest

from corpusengine.llm import token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return token_counts.SpanEncoder(RANKS, public_tokenizers.PATTERN)


def brute(encoder, fields, rule):
    text = "\n".join(fields)
    raw = text.encode()
    owner, section = [], 0
    for byte in raw:
        owner.append(section)
        section += byte == 10
    n = section + 1
    count, crossing, at = [0.0] * n, [0] * n, 0
    for token in encoder.encoding.encode_ordinary(text):
        size = len(encoder.encoding.decode_single_token_bytes(token))
        own = owner[at:at + size]
        crossing[own[0]] += own[0] != own[-1]
        if rule == "start":
            count[own[0]] += 1
        elif rule == "end":
            count[own[-1]] += 1
        else:
            for s in own:
                count[s] += 1 / size
        at += size
    assert at == len(raw)
    return count, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_like_brute_force(encoder, rule):
    rng = random.Random(7)
    pieces = ["a", " the", "\n", "\n\n", "é", "日本", "  ", "word's", " 1999", "🙂", "\t", ".\n"]
    for _ in range(150):
        fields = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        text, field, ends, begin, stop = token_counts.sections(fields)
        tokens, crossing = token_counts.attribute(encoder.ends(text), ends, rule)
        count, cross = brute(encoder, fields, rule)
        assert np.allclose(tokens, count) and list(crossing) == cross
        assert [text[a:b] for a, b in zip(begin, stop)] == text.splitlines(keepends=True)[:0] or "".join(
            text[a:b] for a, b in zip(begin, stop)) == text
        assert [sum(field == i) for i in range(len(fields))] == [f.count("\n") + 1 for f in fields]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_documents(spark, docs, docs_rows, encoder, rule):
    clash = docs.selectExpr("*", "1 AS section", "'x' AS field")
    rows = token_counts.count_tokens(clash, RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    total = {}
    for i, text, lang, source, _ in docs_rows:
        whole = "\n".join([source or "", lang or "", text or ""])
        total[i] = total.get(i, 0) + len(encoder.encoding.encode_ordinary(whole))
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == pytest.approx(total)
    assert {r.field for r in rows} == {"source", "lang", "text"}


def test_empty_table_and_bad_rule(empty_docs):
    assert token_counts.count_tokens(empty_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty_docs, RANKS, public_tokenizers.PATTERN, rule="both")


@pytest.mark.parametrize("unit", ["a", " ", "\n", " \n", "eyJ", "."])
def test_very_long_runs(unit):
    import public_tokenizers

    encoder = token_counts.SpanEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "x " + unit * (5_000_000 // len(unit)) + " y"
    ends = encoder.ends(text)
    assert ends[-1] == len(text) and (ends[1:] > ends[:-1]).all()
