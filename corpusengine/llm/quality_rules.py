"""Quality rules as a short-circuit cascade, in SQL functions only.

Every rule is a boolean column over per-text statistics. The order of the
cascade comes from a sample: rules are ranked by rejected share per unit of
measured cost, so a text leaves at the first rule that rejects it and the dear
rules see few texts. The order never changes which texts are kept, only what
is spent; ``kept`` is therefore the same for any sample.

Repeated words need the 3-word windows that occur twice within one text. They
are found inside the row (hashes of the windows), so no window is ever shuffled.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word rule: x20 and x09-x0D.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    real = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(real) - F.size(F.array_distinct(real))).cast("long")


def window_hashes(words: Column, n: int = 3) -> Column:
    """64-bit hash of every n-word window, in order; ``words`` is a plain column."""
    last = F.size(words) - n
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


# Repeated windows of one text that are looked up one by one.
FEW = 64


def n_repeat_words(hashes: Column, n: int = 3) -> Column:
    """Words inside an n-word window that occurs twice or more in the text.

    ``hashes`` (a plain column) are its windows. Most texts repeat none: their
    distinct count says so. A few repeated windows are looked up; many are found
    by sorting the windows with their positions and comparing neighbours."""
    count = F.size(hashes)
    order = F.sort_array(hashes)
    twice = F.array_distinct(F.array_compact(F.zip_with(
        F.slice(order, 1, count - 1), F.slice(order, 2, count), lambda a, b: F.when(a == b, a))))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[i + k for k in range(n)])))))

    def looked_up(some: Column) -> Column:
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(some, h), i)), lambda i: i.isNotNull())

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.arrays_zip(F.slice(placed, 1, count - 1).alias("a"), F.slice(placed, 2, count).alias("b"))
    neighbours = F.array_distinct(F.flatten(F.transform(
        F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"]), lambda p: F.array(p["a"]["i"], p["b"]["i"]))))
    # ``twice`` is bound once, as the one element of an array.
    found = F.get(F.transform(F.array(twice), lambda some: F.when(
        F.size(some) <= FEW, covered(looked_up(some))).otherwise(covered(neighbours))), 0)
    return F.when(F.size(F.array_distinct(hashes)) == count, F.lit(0)).otherwise(found).cast("long")


# Statistics of every text (returned), and those that only a rule asks for: they
# stay inside the cascade, so a text that left earlier never pays for them.
ALWAYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LAZY = {
    "n_upper": r"length(regexp_replace({text}, '[^\\p{{Lu}}]+', ''))",
    "n_letters": r"length(regexp_replace({text}, '[^\\p{{L}}]+', ''))",
    "n_lines": r"size(split({text}, '\\n', -1))",
}


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_qr_") -> DataFrame:
    """``docs`` plus the statistics of every text, named with ``prefix``."""
    p = prefix
    w, t = F.col(p + "words"), F.col(text_col)
    df = docs.withColumn(p + "words", words_of(t)).withColumn(p + "hashes", window_hashes(w))
    return df.withColumns({
        p + "n_words": F.size(w).cast("long"),
        p + "word_chars": F.length(F.array_join(w, "")).cast("long"),
        p + "n_symbols": n_symbols(t),
        p + "n_dup_lines": n_dup_lines(t),
        p + "n_repeat_words": n_repeat_words(F.col(p + "hashes")),
    }).drop(p + "words", p + "hashes")


def lazy(name: str, text_col: str) -> str:
    return LAZY[name].format(text=f"coalesce(`{text_col}`, '')")


@dataclass(frozen=True)
class Rule:
    """A named rejection rule over the statistics (SQL, names without prefix)."""

    name: str
    rejects: str
    #: Statistics the rule needs; its cost on the sample is theirs.
    needs: tuple[str, ...]


#: Base rules first by contract; the others reject clear junk only. Ratios are
#: written as products, so an empty text divides nothing.
BASE_RULES = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
)
METHOD_RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words", ("n_symbols", "n_words")),
    Rule("capitals", "n_letters >= 50 AND 10 * n_upper > 6 * n_letters", ("n_upper", "n_letters")),
    Rule("long_words", "word_chars > 40 * n_words", ("word_chars", "n_words")),
    Rule("short_words", "2 * word_chars < 3 * n_words", ("word_chars", "n_words")),
    Rule("dup_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines", ("n_dup_lines", "n_lines")),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text",
                  sample_rows: int = 200, seed: int = 7) -> list[Rule]:
    """Rules by rejected share per second of cost, measured on a sample.

    The sample is at most ``sample_rows`` rows drawn from one input split (a
    documented bound; it sets the order, never the verdict). Ties keep the
    given order; on an empty table so do all."""
    spark = docs.sparkSession
    sample = spark.createDataFrame(docs.select(F.col(text_col).alias("text")).limit(sample_rows).collect(),
                                   "text string")
    stats = with_statistics(sample, "text", "").withColumns({n: F.expr(lazy(n, "text")) for n in LAZY})
    shares = stats.agg(*[F.avg(F.expr(r.rejects).cast("double")).alias(r.name) for r in rules]).first()
    cost: dict[str, float] = {}
    for need in {n for r in rules for n in r.needs}:
        t0 = time.perf_counter()
        stats.agg(F.sum(need)).first()
        cost[need] = time.perf_counter() - t0
    per_cost = {r.name: (shares[r.name] or 0.0) / sum(cost[n] for n in r.needs) for r in rules}
    return sorted(rules, key=lambda r: -per_cost[r.name])


def apply_cascade(docs: DataFrame, text_col: str = "text", order: list[Rule] | None = None,
                  base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and rejected_by (name of the first rule
    of the cascade that rejects, null for kept texts).

    Null and empty texts have no words: they fail ``few_words``. Columns of
    the input with clashing names are replaced by the results; repeated rows
    are judged alike; an empty table gives an empty result."""
    order = list(order if order is not None else (*base, *method))
    out = list(ALWAYS)
    stats = with_statistics(docs, text_col, "_qr_")

    def sql(rule: Rule) -> Column:
        text = rule.rejects
        for n in sorted(rule.needs, key=len, reverse=True):
            text = _rename(text, n, lazy(n, text_col) if n in LAZY else f"_qr_{n}")
        return F.expr(text)

    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(sql(rule), F.lit(rule.name)).otherwise(verdict)
    failed = F.lit(False)
    for rule in base:
        failed = failed | sql(rule)
    keep = [c for c in docs.columns if c not in {*out, "base_failed", "kept", "rejected_by"}]
    return stats.select(
        *keep, *[F.col("_qr_" + n).alias(n) for n in out], failed.alias("base_failed"),
        verdict.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def _rename(sql: str, name: str, to: str) -> str:
    return re.sub(rf"(?<!\w){name}(?!\w)", lambda _: to, sql)
