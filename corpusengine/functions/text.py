"""Text column functions (HTML to text, whitespace, safe names).

Every function maps Column -> Column and stays inside Catalyst: only built-in
regular-expression and string expressions, no Python per row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags whose content is dropped, comments, and every other tag. A run of
# markers becomes a single join between two text nodes.
_TAG_MARK = "\u0001"
# (All alternatives start with '<', so it is factored out: positions without
# a '<' fail on the first character. As in HTML tokenisation, '<' followed by
# anything but a letter, '/', '!' or '?' is text, not a tag.)
# A quoted attribute value may hold '>'; a tag whose quotes do not close ends
# at the first '>'.
_DROP_PATTERN = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b[^>]*>.*?</script\s*>"
    r"|style\b[^>]*>.*?</style\s*>"
    r"|noscript\b[^>]*>.*?</noscript\s*>"
    r"|[a-zA-Z/!?](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|[a-zA-Z/!?][^>]*>)"
)
# Whitespace exactly as Python's str.isspace() / str.strip() define it (all
# such characters are below U+3001), as a string and as a regex class that
# both Java regex and RE2 accept.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
# Line breaks of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

# The references of filings' common characters, tried before the
# full HTML5 table of Python's standard library. Numeric references (&#N; and
# &#xH;) are all decoded; names that HTML5 does not know are left as written.
NAMED_ENTITIES = (
    "nbsp", "amp", "lt", "gt", "quot", "apos", "copy", "reg", "trade", "middot",
    "bull", "hellip", "mdash", "ndash", "lsquo", "rsquo", "ldquo", "rdquo",
    "sect", "para", "deg", "plusmn", "times", "frac12", "cent", "pound", "euro",
)
ENTITY_RE = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);"
# Control characters that the rules below use as marks; dropped from the input.
MARKS = "\u0001\u0002\u0003"


def entity_table() -> dict[str, str]:
    """'&name;' -> character(s), for every HTML5 name that ends in ';'."""
    from html.entities import html5

    return {f"&{n}": c for n, c in html5.items() if n.endswith(";")}


def without_marks(t: Column) -> Column:
    """The text without the mark characters (texts hardly ever hold one)."""
    has = F.lit(False)
    for m in MARKS:
        has = has | t.contains(m)
    return F.when(has, F.translate(t, MARKS, "")).otherwise(t)


def _hex2(b: Column) -> Column:
    return F.lpad(F.hex(b), 2, "0")


def _utf8_byte(n: Column, shift: int, mask: int, mark: int) -> Column:
    return _hex2(F.shiftright(n, shift).bitwiseAND(mask).bitwiseOR(mark))


def code_point_char(n: Column) -> Column:
    """The character of Unicode code point ``n`` (its UTF-8 bytes built with
    arithmetic, then decoded); invalid code points give U+FFFD."""
    hexs = (
        F.when(n < 0x80, _hex2(n))
        .when(n < 0x800, F.concat(_utf8_byte(n, 6, 0x1F, 0xC0), _utf8_byte(n, 0, 0x3F, 0x80)))
        .when(n < 0x10000, F.concat(_utf8_byte(n, 12, 0x0F, 0xE0), _utf8_byte(n, 6, 0x3F, 0x80),
                                    _utf8_byte(n, 0, 0x3F, 0x80)))
        .otherwise(F.concat(_utf8_byte(n, 18, 0x07, 0xF0), _utf8_byte(n, 12, 0x3F, 0x80),
                            _utf8_byte(n, 6, 0x3F, 0x80), _utf8_byte(n, 0, 0x3F, 0x80)))
    )
    bad = (n <= 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF))
    return F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(hexs), "UTF-8"))


def _code_point(digits: Column, most: int, base: int) -> Column:
    """The number of a digit string (too long, so too large: -1)."""
    short = F.regexp_replace(digits, "^0+", "")
    number = F.conv(short, base, 10).cast("long")
    return F.when(F.length(short) > most, F.lit(-1)).when(short == "", F.lit(0)).otherwise(number)


def decode_entity(e: Column) -> Column:
    """One character reference ('&copy;', '&#169;', '&#xA9;') decoded;
    unknown names are returned unchanged."""
    table = entity_table()
    out = None
    for name in NAMED_ENTITIES:
        ref = f"&{name};"
        out = F.when(e == ref, F.lit(table[ref])) if out is None else out.when(e == ref, F.lit(table[ref]))
    dec = F.regexp_extract(e, r"^&#([0-9]+);$", 1)
    hx = F.regexp_extract(e, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
    out = out.when(dec != "", code_point_char(_code_point(dec, 7, 10)))
    out = out.when(hx != "", code_point_char(_code_point(hx, 6, 16)))
    # One literal (folded once), so the table is not thousands of branches.
    names = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    return out.otherwise(F.coalesce(F.try_element_at(names, e), e))


def decode_entities(t: Column) -> Column:
    """All character references of ``t`` decoded in one pass, as an HTML
    parser reads them ('&amp;lt;' gives '&lt;', not '<')."""
    pieces = F.split(t, ENTITY_RE)
    refs = F.transform(F.regexp_extract_all(t, F.lit(ENTITY_RE), 0), decode_entity)
    joined = F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.array_join(joined, "")


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element
    ``transform``), so a large expression is not copied into several
    branches of a CASE."""
    return F.get(F.transform(F.array(value), fn), 0)


def strip_ws(c: Column) -> Column:
    """Strip leading and trailing whitespace (spaces, tabs, newlines...).

    Spark's ``trim`` only removes spaces.
    """
    return F.btrim(c, F.lit(WHITESPACE))


def html_to_text(html: Column) -> Column:
    """Plain text of an HTML page.

    script/style/noscript blocks and comments are dropped, text nodes are
    joined by a newline, NBSP becomes a space, runs of spaces/tabs become one
    space, 2+ newlines become exactly two, and the result is stripped.
    """
    t = F.regexp_replace(let(html, without_marks), _DROP_PATTERN, _TAG_MARK)
    t = F.regexp_replace(t, _TAG_MARK + "+", "\n")

    def decode(x: Column) -> Column:
        return F.when(x.contains("&"), decode_entities(x)).otherwise(x)

    def squeeze(x: Column) -> Column:
        # Only runs that change: 2+ spaces/tabs or a lone tab; 3+ newlines.
        x = F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]{2,}|\t", " ")).otherwise(x)
        return x

    def lines(x: Column) -> Column:
        return F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)

    t = let(t, decode)
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = let(t, squeeze)
    t = let(t, lines)
    return strip_ws(t)


def safe_name(c: Column, limit: int = 80) -> Column:
    """Keep letters, digits, '.', '_', '-' and space; strip; then cut to limit."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}._\- ]", "")
    return F.substring(strip_ws(kept), 1, limit)
