"""Kneser-Ney estimates against a direct computation; both scoring paths agree."""

import math
import random
from collections import Counter, defaultdict

import pytest

from corpusengine.llm import quality_kn as kn
from corpusengine.llm.common import Scratch


def symbols(text):
    out = [kn.BEGIN] * 2
    for c in text or "":
        out.append(ord(c) if ord(c) < kn.LATIN else kn.LETTER if c.isalpha() else kn.OTHER)
    return out + [kn.END]


class Brute:
    """Interpolated modified Kneser-Ney over symbol trigrams, by definition."""

    def __init__(self, texts):
        c3 = Counter(g for t in texts for g in zip(symbols(t), symbols(t)[1:], symbols(t)[2:]))
        c2 = Counter((b, c) for a, b, c in c3)
        c1 = Counter((c,) for b, c in c2)
        self.counts = {3: c3, 2: c2, 1: c1}
        self.discounts = {k: self.discount(c) for k, c in self.counts.items()}
        self.after = {k: defaultdict(list) for k in self.counts}
        for k, table in self.counts.items():
            for g, n in table.items():
                self.after[k][g[:-1]].append(n)

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        if min(n[i] for i in (1, 2, 3, 4)) == 0:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(i - 0.01, max(0.01, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3))

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / kn.ALPHABET
        lower = self.p(gram[1:])
        after = self.after[k][gram[:-1]]
        if not after:
            return lower
        d = self.discounts[k]
        off = lambda n: d[min(n, 3) - 1]
        n = self.counts[k][gram]
        return ((n - off(n)) if n else 0) / sum(after) + sum(map(off, after)) / sum(after) * lower

    def log_prob(self, text):
        s = symbols(text)
        return sum(math.log10(self.p(g)) for g in zip(s, s[1:], s[2:]))


def made(n, seed, odd=False):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "été", "ß"]
    return ["".join(rng.choice(["%", "$", "Q", "日", "🙂"]) if odd and rng.random() < 0.6 else rng.choice(syllables) + rng.choice(["", " ", "\n"])
                    for _ in range(rng.randint(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    texts = made(80, 1)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    return kn.kneser_ney(kn.trigram_counts(df), scratch), Brute(texts)


def test_log_probabilities(trained):
    tables, brute = trained
    model = kn.collect_model(tables)
    for t in [*made(15, 2), *made(15, 3, True), "", "a", "日本🙂", "x" * 50]:
        assert model.log_prob(t) == pytest.approx(brute.log_prob(t), rel=1e-9)


def test_probabilities_sum_to_one(trained):
    _, brute = trained
    for ctx in [(kn.BEGIN, kn.BEGIN), (ord("t"), ord("h")), (ord("~"), ord("h")), (1, 2)]:
        assert sum(brute.p((*ctx, c)) for c in range(kn.ALPHABET)) == pytest.approx(1)


def test_joins_give_the_same_sums(spark, trained, monkeypatch):
    tables, brute = trained
    rows = list(enumerate([*made(10, 4), *made(10, 5, True), "", None])) + [(1, "he he")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, g int, ctx int").repartition(3)
    got = sorted((r.doc_id, r.text or "", r._lp, r._chars) for r in kn.log_prob_by_joins(df, tables, "text").collect())
    expected = sorted((i, t or "", brute.log_prob(t), len(t or "") + 1) for i, t in rows)
    for a, b in zip(got, expected, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3]
    monkeypatch.setattr(kn, "MAX_ROWS", 1)
    assert kn.collect_model(tables) is None


def test_long_texts_in_blocks(trained, monkeypatch):
    model = kn.collect_model(trained[0])
    text = "there on another " * 500
    whole = model.log_prob(text)
    monkeypatch.setattr(kn, "BLOCK", 100)
    assert model.log_prob(text) == pytest.approx(whole)


SCHEMA = "doc_id bigint, text string, lang string, _keep int"


def test_judging(spark):
    good, bad = made(150, 6), [t for t in made(40, 7, True) if len(t) > 60]
    rows = [(i, t, ["en", "de", None][i % 3], 1) for i, t in enumerate(good)]
    rows += [(1000 + i, t * 3, "en", 1) for i, t in enumerate(bad)]
    rows += [(2000, None, "en", 1), (2001, "", "xx", 1), (None, "there", "en", 1), rows[0]]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(1000, 0), (None, 1), (0, 1), (2, None)], "doc_id bigint, quality int")
    df = spark.createDataFrame(rows, SCHEMA).drop("_keep").repartition(3)
    out = kn.judge(df, labels).collect()
    assert len(out) == len(rows)
    keep = {r.doc_id: r._keep for r in out}
    assert all(keep[i] for i in range(150)) and keep[2000] and keep[2001]
    assert sum(keep[1000 + i] for i in range(len(bad))) <= 0.1 * len(bad)


def test_short_junk_and_repeated_words(spark):
    """Short junk is held to a limit of its own length, and one ordinary word
    over and over is not ordinary."""
    rng = random.Random(8)
    good = made(400, 6) + [t[:40] for t in made(400, 9)]
    word = "".join(rng.choice(["th", "er", "on"]) for _ in range(3))
    junk = ["".join(rng.choice("ßéehrnt") for _ in range(40)) for _ in range(30)]
    again = [(word + " ") * n for n in range(10, 40)]
    rows = [(i, t, "en") for i, t in enumerate(good + junk + again)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id bigint, quality int")
    keep = {r.doc_id: r._keep for r in kn.judge(df, labels).collect()}
    n = len(good)
    assert sum(keep[i] for i in range(n)) >= 0.985 * n
    assert sum(keep[n + i] for i in range(30)) <= 3 and not any(keep[n + 30 + i] for i in range(30))


def test_other_scripts(spark, monkeypatch):
    """Letters of Greek and Cyrillic words in random order are not ordinary, and
    both scoring paths tell code points apart."""
    rng = random.Random(10)
    words = "και του την που στο για από με να θα στην μια λόγο άνθρωπος это что как она было только может человек время 日本 東京 😀".split()
    good = [" ".join(rng.choices(words, k=30)) for _ in range(260)]
    letters = sorted(set("".join(words)) - {" "})
    junk = ["".join(c if c == " " else rng.choice(letters) for c in t) for t in good[:20]]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id bigint, text string").selectExpr("*", "'el' lang").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id bigint, quality int")
    first = {r.doc_id: (r._lp, r._keep) for r in kn.judge(df, labels).collect()}
    assert sum(first[i][1] for i in range(260)) >= 0.98 * 260 and not any(first[260 + i][1] for i in range(20))
    monkeypatch.setattr(kn, "MAX_CELLS", 1)
    for r in kn.judge(df, labels).collect():
        assert (pytest.approx(r._lp), r._keep) == first[r.doc_id]


def test_without_trusted_text_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    df = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    assert [r._keep for r in kn.judge(df, none).collect()] == [True, True]
    assert kn.judge(df.limit(0), none).count() == 0


def test_all_trusted_documents_are_counted(spark, monkeypatch):
    """No bound on the trusted documents that the model is trained on."""
    counted, count = [], kn.trigram_counts

    def spy(texts, *args):
        counted.append(texts.count())
        return count(texts, *args)

    monkeypatch.setattr(kn, "trigram_counts", spy)
    n = 21_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('the ', id % 10) AS text", "'en' AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    kn.judge(df, labels)
    assert counted == [df.filter(~kn.held_out("doc_id")).count()] and counted[0] > 10_000


def test_texts_are_scored_before_they_are_joined(spark, monkeypatch):
    """The held-out texts meet the labels as scores, so that no text is shuffled for the limits."""
    plans, repeats = [], kn.with_repeats

    def spy(docs, *args):
        plans.append(docs._jdf.queryExecution().analyzed().toString())
        return repeats(docs, *args)

    monkeypatch.setattr(kn, "with_repeats", spy)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made(30, 11))], "doc_id bigint, text string, lang string")
    kn.judge(df, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, quality int"))
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_scores_come_from_the_sharded_tables(spark, monkeypatch):
    """Every document is scored by joins with the count tables, in blocks, also
    when the tables are small; the values are those of the array."""
    rows = [(i, t, "en") for i, t in enumerate([*made(40, 12), *made(20, 13, True), "", None, "日"])] + [(3, "twice", "en")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    asked, logs, collect = [], kn.gram_logs, kn.collect_model

    def spy(flat, tables):
        asked.append((flat.count(), tables))
        return logs(flat, tables)

    def no_array(tables):
        raise AssertionError("the tables are collected")

    monkeypatch.setattr(kn, "gram_logs", spy)
    monkeypatch.setattr(kn, "collect_model", no_array)
    monkeypatch.setattr(kn, "BLOCK_TEXTS", 7)
    got = kn.judge(df, labels).collect()
    grams = {g for _, t, _ in rows for g in kn.grams(kn.symbols(t or "")).tolist()}
    assert len(asked) == 1 and asked[0][0] == len(grams)
    model = collect(asked[0][1])
    assert len(got) == len(rows)
    for r in got:
        own = model.symbol_logs(r.text or "")
        assert (r._lp, r._chars) == (pytest.approx(own.sum()), len(own))
        assert r._ppl == pytest.approx(10 ** -kn.core_mean(own))


def test_counts_of_long_texts_in_pieces(monkeypatch):
    texts = [*made(5, 14), "", "a" * 99]
    whole = [kn.text_counts(t) for t in texts]
    monkeypatch.setattr(kn, "BLOCK", 10)
    for t, (g, n) in zip(texts, whole, strict=True):
        own = kn.text_counts(t)
        assert own[0].tolist() == g.tolist() and own[1].tolist() == n.tolist() and n.sum() == len(t) + 1


def test_blocks_are_never_broadcast(spark, trained, monkeypatch):
    """The trigrams of all blocks are exploded from a scan that looks small."""
    plans, write = [], Scratch.write

    def spy(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", spy)
    out = kn.log_prob_by_joins(spark.createDataFrame([("he he",), ("on",)], "text string"), trained[0], "text")
    assert "Broadcast" not in dict(plans)["text-scores"]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
