"""Named-section extraction from document text, as native expressions.

A section starts at each match of ``start_re`` and runs to the first match of
``end_re`` after it (or to the end of the text). Candidates are stripped,
filtered by length and by ``reject_re``, page-number lines are removed, and
the longest candidate wins (the first one on ties). No match -> null.

Method: a sentinel character is inserted before every start heading and
another before every end heading; splitting by the end sentinel gives blocks,
and inside a block each start sentinel with everything after it is one
candidate. Everything runs as higher-order functions inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LINE_BREAK, WS_CLASS, let, strip_ws, without_marks

_START_MARK = "\u0002"
_END_MARK = "\u0003"

# Headings of the risk-factor section and of the items after it.
# (?d): '^' only after '\n'; (?m): per line; (?i): any case. Whitespace is
# Python's (WS_CLASS), digits are Unicode digits, as in the original rules. Both
# patterns match prefixes, so '[2-9]' covers items with a letter (7A, 9B).
_WS = WS_CLASS
ITEM_1A_START = rf"(?imd)^{_WS}*ITEM{_WS}*1A(?:[.:\-–—]|\b){_WS}*(?:Risk{_WS}+Factors\b)?"
NEXT_ITEM_END = rf"(?imd)^{_WS}*ITEM{_WS}*(?:1B|1C|[2-9]|1[0-4])"
TABLE_OF_CONTENTS = r"(?i)\bTable of Contents\b"
PAGE_NUMBER_LINE = rf"^{_WS}*\p{{Nd}}{{1,3}}{_WS}*$"


def section_candidates(text: Column, start_re: str, end_re: str) -> Column:
    """array<string>: raw (unstripped) candidate sections in text order."""
    # Bound once: the text may be a large expression.
    t = F.replace(let(text, without_marks), F.lit("\u00a0"), F.lit(" "))
    marked = F.regexp_replace(t, start_re, _START_MARK + "$0")
    marked = F.regexp_replace(marked, end_re, _END_MARK + "$0")
    blocks = F.split(marked, _END_MARK)

    def block_candidates(b: Column) -> Column:
        parts = F.split(b, _START_MARK)
        n = F.size(parts)
        return F.when(
            n > 1,
            F.transform(
                F.sequence(F.lit(2), n),
                lambda i: F.array_join(F.slice(parts, i, n - i + 1), ""),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(blocks, block_candidates))


def drop_page_number_lines(s: Column) -> Column:
    """Drop lines that are only 1-3 digits (page numbers); lines re-joined
    with '\n', result stripped."""
    lines = F.split(s, LINE_BREAK)
    kept = F.filter(lines, lambda ln: ~ln.rlike(PAGE_NUMBER_LINE))
    return strip_ws(F.array_join(kept, "\n"))


def extract_section(
    text: Column,
    start_re: str = ITEM_1A_START,
    end_re: str = NEXT_ITEM_END,
    min_chars: int = 800,
    reject_re: str | None = TABLE_OF_CONTENTS,
) -> Column:
    """Best (longest) section of ``text`` or null."""
    cands = F.transform(section_candidates(text, start_re, end_re), strip_ws)
    keep = F.filter(
        cands,
        lambda s: (F.length(s) >= min_chars)
        & (F.lit(True) if reject_re is None else ~s.rlike(reject_re)),
    )
    cleaned = F.transform(keep, drop_page_number_lines)
    return F.aggregate(
        cleaned,
        F.lit(None).cast("string"),
        lambda acc, x: F.when(
            acc.isNull() | (F.length(x) > F.length(acc)), x
        ).otherwise(acc),
    )
