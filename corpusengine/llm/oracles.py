"""DuckDB SQL of the operators that SQL can express, from the same constants."""

from __future__ import annotations

import re

from . import quality_rules, secrets, url_filter
from .common import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def decontam_sql(window: int = 13, min_share: int = 20) -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = f"regexp_extract_all({_lower("COALESCE(text, '')")}, '{words}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS w FROM documents),
    it AS (SELECT item_id, w, least(len(w), {window}) AS n FROM (SELECT item_id, {cut} AS w FROM benchmark) WHERE len(w) > 0),
    iw AS (SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS win, CAST(item_id AS VARCHAR) AS item
           FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM it)),
    dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
           FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM it))),
    hit AS (SELECT r, i, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
    pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
    ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
           sha256(COALESCE(listed, '')) AS items_sha256,
           COALESCE(n_hit, 0) > 0 AND {min_share} * COALESCE(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)"""


def quality_rules_sql() -> str:
    any_of = lambda rules: " OR ".join(f"({r.rejects})" for r in rules)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t,
                      regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
    w3 AS (SELECT r, i, w[i:i + 2] AS win FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (
              SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w3)
              WHERE c > 1) GROUP BY r),
    s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS real,
                 CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words,
                 length(regexp_replace(array_to_string(w, ''), '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
                 length(regexp_replace(array_to_string(w, ''), '[^\\p{{L}}]+', '', 'g')) AS n_letters,
                 len(string_split(t, chr(10))) AS n_lines
          FROM d LEFT JOIN rep USING (r)),
    x AS (SELECT *, CAST(len(real) - len(list_distinct(real)) AS BIGINT) AS n_dup_lines FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({any_of(quality_rules.BASE_RULES)}) AS base_failed,
           NOT ({any_of(quality_rules.BASE_RULES + quality_rules.METHOD_RULES)}) AS kept
    FROM x"""


def _re2(kind: secrets.Kind) -> str:
    """The kind's pattern without look-behind (it only saves time: a run is
    matched whole) and with either case spelt out for ASCII letters."""
    rx = re.sub(r"^\(\?<!\[[^\]]*\]\)", "", kind.regex)

    def spell(m: re.Match) -> str:
        return re.sub(r"[a-z]", lambda c: f"[{c.group()}{c.group().upper()}]", m.group(1))

    return re.sub(r"\(\?i:(\([^)]*\))\)", spell, rx).replace("'", "''")


def secrets_sql(min_owners: int = 3) -> str:
    kinds = (*secrets.BASE_KINDS, *secrets.METHOD_KINDS)
    found = []
    for n, k in enumerate(kinds):
        rx = _re2(k)
        also = "".join(f" AND regexp_matches(value, '{p}')" for p in k.also)
        found.append(f"""SELECT r, source, {n} AS k, '{k.name}' AS kind, {str(k.base).lower()} AS base, value, len,
            sum(gap + len) OVER (PARTITION BY r ORDER BY i) AS e, length(value) >= {k.least}{also} AS ok
          FROM (SELECT r, source, unnest(range(1, len(h) + 1)) AS i, length(unnest(h)) AS len, unnest(v) AS value,
                       length(unnest(g[1:len(h)])) AS gap
                FROM (SELECT r, source, regexp_extract_all(t, '{rx}') AS h, regexp_extract_all(t, '{rx}', {k.group}) AS v,
                             string_split_regex(t, '{rx}') AS g FROM d))""")
    listed = "string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, k)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in secrets.BASE_KINDS)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, COALESCE(text, '') AS t FROM documents),
    f AS (SELECT *, e - len AS s FROM ({' UNION ALL '.join(found)}) WHERE ok),
    o AS (SELECT value, count(*) AS owners FROM (SELECT DISTINCT value, source FROM f) GROUP BY value),
    a AS (SELECT f.*, owners < {min_owners} AS live FROM f JOIN o USING (value)),
    told AS (SELECT * FROM a WHERE base OR (live AND NOT EXISTS (
               SELECT 1 FROM a b WHERE b.base AND b.r = a.r AND b.s < a.e AND a.s < b.e))),
    g AS (SELECT r, {counts}, {listed} FILTER (base) AS own, {listed} AS spans,
                 count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM told GROUP BY r)
    SELECT doc_id, {', '.join(f'COALESCE(n_{k.name}, 0) AS n_{k.name}' for k in secrets.BASE_KINDS)},
           sha256(COALESCE(own, '')) AS base_sha256, COALESCE(spans, '') AS spans,
           COALESCE(n_live, 0) AS n_live, COALESCE(n_example, 0) AS n_example
    FROM d LEFT JOIN g USING (r)"""


def url_filter_sql() -> str:
    ranked = sorted(url_filter.BASE_RULES, key=lambda r: -len(r.name))

    def fits(r: url_filter.HostRule) -> str:
        return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"

    def pattern(glob: str) -> str:
        special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
        return "(?s)" + "".join(special.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob))

    rules = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ranked)
    verdicts = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)
    blocked = " OR ".join(f"regexp_full_match(host || path, '{pattern(g)}')" for g in url_filter.BLOCK_GLOBS)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
               FROM pages),
    h AS (SELECT page_id, {_lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path, CASE {rules} END AS rule,
           CASE {verdicts} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
    FROM h"""
