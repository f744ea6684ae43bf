"""DuckDB SQL fragments mirroring the Spark column functions (oracle side)."""

from __future__ import annotations

from ..functions.text import LINE_BREAK, WHITESPACE, WS_CLASS

WS_CHARS_SQL = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def sql_strip(x: str) -> str:
    """Python's str.strip()."""
    return f"trim({x}, {WS_CHARS_SQL})"


def sql_without_marks(x: str) -> str:
    return f"replace(replace(replace({x}, chr(1), ''), chr(2), ''), chr(3), '')"


def sql_html_to_text(x: str) -> str:
    quoted = "[a-zA-Z/!?](?:[^''\">]|\"[^\"]*\"|''[^'']*'')*>"
    drop = (
        "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
        f"|<noscript\\b[^>]*>.*?</noscript\\s*>|<{quoted}|<[a-zA-Z/!?][^>]*>"
    )
    t = f"regexp_replace({sql_without_marks(x)}, '{drop}', chr(1), 'g')"
    t = f"regexp_replace({t}, chr(1) || '+', chr(10), 'g')"
    t = sql_decode_entities(t)
    t = f"replace({t}, chr(160), ' ')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
    return sql_strip(t)


def sql_code_point_char(n: str) -> str:
    return (f"(CASE WHEN {n} <= 0 OR {n} > 1114111 OR ({n} >= 55296 AND {n} <= 57343) "
            f"THEN chr(65533) ELSE chr(CAST({n} AS INTEGER)) END)")


def sql_decode_entities(t: str) -> str:
    """Same one-pass decoding as functions.text.decode_entities; the input is
    bound once with a one-element list_transform."""
    from ..functions.text import ENTITY_RE, entity_table

    table = entity_table()
    names = "[" + ", ".join(f"'{n}'" for n in table) + "]"
    chars = "[" + ", ".join(" || ".join(f"chr({ord(c)})" for c in v) for v in table.values()) + "]"

    def number(digits: str, most: int, hexa: bool) -> str:
        short = f"ltrim({digits}, '0')"
        value = f"CAST('0x' || {short} AS BIGINT)" if hexa else f"CAST({short} AS BIGINT)"
        return f"(CASE WHEN length({short}) > {most} THEN -1 WHEN {short} = '' THEN 0 ELSE {value} END)"

    dec = sql_code_point_char(number("substr(e, 3, length(e) - 3)", 7, False))
    hx = sql_code_point_char(number("substr(e, 4, length(e) - 4)", 6, True))
    decode = (f"lambda e: CASE WHEN regexp_full_match(e, '&#[0-9]+;') THEN {dec} "
              f"WHEN regexp_full_match(e, '&#[xX][0-9A-Fa-f]+;') THEN {hx} "
              f"ELSE COALESCE({chars}[list_position({names}, e)], e) END")
    refs = f"list_transform(regexp_extract_all(x, '{ENTITY_RE}'), {decode})"
    zipped = f"list_zip(regexp_split_to_array(x, '{ENTITY_RE}'), {refs})"
    decoded = f"array_to_string(list_transform({zipped}, lambda z: z[1] || COALESCE(z[2], '')), '')"
    return f"list_transform([{t}], lambda x: CASE WHEN contains(x, '&') THEN {decoded} ELSE x END)[1]"


def sql_fixed_count(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"(CASE WHEN {n} IS NULL OR {n} <= 0 THEN 0 WHEN {n} <= {size} THEN 1 "
        f"ELSE CAST(ceil(({n} - {overlap}) / {step}.0) AS BIGINT) END)"
    )


def sql_fixed_chunks(src: str, key_cols: str, text: str, size: int, overlap: int) -> str:
    """Subquery with key_cols, chunk_ix, chunk."""
    step = size - overlap
    return f"""
    SELECT {key_cols}, i AS chunk_ix, substring({text}, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk
    FROM (SELECT {key_cols}, {text}, unnest(range({sql_fixed_count(f'length({text})', size, overlap)})) AS i
          FROM {src})
    """




# The same patterns as the Spark side, in RE2 (no (?d): RE2's '^' already
# follows '\n' only).
LINEBREAK_RE2 = LINE_BREAK
START_RE2 = rf"(?im)^{WS_CLASS}*ITEM{WS_CLASS}*1A(?:[.:\-–—]|\b){WS_CLASS}*(?:Risk{WS_CLASS}+Factors\b)?"
END_RE2 = rf"(?im)^{WS_CLASS}*ITEM{WS_CLASS}*(?:1B|1C|[2-9]|1[0-4])"
PAGE_RE2 = rf"^{WS_CLASS}*\p{{Nd}}{{1,3}}{WS_CLASS}*$"


def sql_section_select(src: str, keys: str, text: str, min_chars: int = 800) -> str:
    """Subquery: keys + section (best Item 1A section or NULL)."""
    marked = (
        f"regexp_replace(regexp_replace(replace({sql_without_marks(text)}, chr(160), ' '), '{START_RE2}', chr(2) || '\\0', 'g'), "
        f"'{END_RE2}', chr(3) || '\\0', 'g')"
    )
    cands = (
        "flatten(list_transform(string_split(mk, chr(3)), lambda b: "
        "list_transform(range(2, len(string_split(b, chr(2))) + 1), "
        "lambda i: array_to_string(string_split(b, chr(2))[i:], ''))))"
    )
    keep = (
        f"list_filter(list_transform(cands, lambda c: {sql_strip('c')}), lambda s: length(s) >= {min_chars} "
        "AND NOT regexp_matches(s, '(?i)\\bTable of Contents\\b'))"
    )
    clean = (
        "list_transform(keep, lambda s: "
        + sql_strip(
            f"array_to_string(list_filter(string_split_regex(s, '{LINEBREAK_RE2}'), "
            f"lambda l: NOT regexp_matches(l, '{PAGE_RE2}')), chr(10))"
        )
        + ")"
    )
    best = (
        "cleaned[list_position(list_transform(cleaned, lambda s: length(s)), "
        "list_max(list_transform(cleaned, lambda s: length(s))))]"
    )
    return f"""(SELECT {keys}, {best} AS section FROM (
        SELECT {keys}, {clean} AS cleaned FROM (
          SELECT {keys}, {keep} AS keep FROM (
            SELECT {keys}, {cands} AS cands FROM (
              SELECT {keys}, {marked} AS mk FROM {src})))))"""


def sql_parse_date(x: str) -> str:
    s = sql_strip(x)
    return (
        f"COALESCE(CASE WHEN regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN CAST(try_strptime({s}, '%Y-%m-%d') AS DATE) END, "
        f"CASE WHEN regexp_full_match({s}, '[0-9]{{8}}') THEN CAST(try_strptime({s}, '%Y%m%d') AS DATE) END)"
    )


def sql_master_index_rows(files: str, header: str) -> str:
    """Subquery: file_date, file_part, line_no, cik, company, form, date_filed,
    filename."""
    hdr = header.replace("'", "''")
    fields = ", ".join(
        f"{sql_strip(f'string_split(line, {chr(39)}|{chr(39)})[{i + 1}]')} AS {n}"
        for i, n in enumerate(("cik", "company", "form", "date_filed", "filename"))
    )
    return f"""(SELECT file_date, file_part, line_no, {fields} FROM (
        SELECT file_date, file_part, unnest(list_slice(lines, hdr + 1, len(lines))) AS line,
               unnest(range(hdr + 1, len(lines) + 1)) AS line_no
        FROM (SELECT file_date, file_part, lines,
                     list_position(list_transform(lines, lambda l: starts_with({sql_strip('l')}, '{hdr}')), true) AS hdr
              FROM (SELECT file_date, file_part, string_split_regex(text, '{LINEBREAK_RE2}') AS lines FROM {files}))
        WHERE hdr IS NOT NULL)
      WHERE len(string_split(line, '|')) = 5)"""


def sql_recursive_chunks(src: str, keys: str, text: str, size: int, overlap: int) -> str:
    """Subquery: keys, chunk_ix, chunk_start, chunk_end, chunk of the recursive
    splitter (separators: blank line, newline, space, character).

    Each level cuts its segments at the first separator they hold; pieces that
    are still too long are the next level's segments. Runs of short pieces are
    packed by a fold over (pieces held, their length, chunks so far)."""
    nl = "chr(10)"
    seps = f"[{nl} || {nl}, {nl}, ' ', '']"
    levels = [f"s0 AS (SELECT row_number() OVER () AS doc, {keys}, {text} AS whole, {text} AS t, 0 AS s, 0 AS lvl "
              f"FROM {src} WHERE {text} <> '')"]
    for k in range(4):
        levels.append(f"""c{k} AS (SELECT doc, s, t, CASE WHEN lvl <= 0 AND contains(t, {nl} || {nl}) THEN 0
                WHEN lvl <= 1 AND contains(t, {nl}) THEN 1 WHEN lvl <= 2 AND contains(t, ' ') THEN 2 ELSE 3 END AS c FROM s{k})""")
        levels.append(f"""q{k} AS (SELECT doc, s, c, unnest(range(1, len(ps) + 1)) AS j, unnest(ps) AS p FROM (
            SELECT doc, s, c, CASE WHEN c = 3 THEN string_split(t, '') ELSE list_filter(
                list_transform(string_split(t, {seps}[c + 1]), lambda x, i: CASE WHEN i = 1 THEN x ELSE {seps}[c + 1] || x END),
                lambda x: x <> '') END AS ps FROM c{k}))""")
        levels.append(f"""p{k} AS (SELECT doc, s AS seg, c, j, p, length(p) AS n, s + sum(length(p)) OVER w - length(p) AS beg,
            sum(CASE WHEN length(p) >= {size} THEN 1 ELSE 0 END) OVER w AS run
            FROM q{k} WINDOW w AS (PARTITION BY doc, s ORDER BY j))""")
        levels.append(f"s{k + 1} AS (SELECT doc, CAST(beg AS INTEGER) AS s, p AS t, c + 1 AS lvl FROM p{k} "
                      f"WHERE n >= {size} AND c < 3)")
    small = " UNION ALL ".join(f"SELECT doc, {k} AS lvl, seg, run, beg, n FROM p{k} WHERE n < {size}" for k in range(4))
    rest = "list_sum(list_transform(a.cur[m + 1:], lambda y: y.n))"
    fits = f"COALESCE({rest}, 0) <= {overlap} AND COALESCE({rest}, 0) + x.total <= {size}"
    drop = f"COALESCE(list_filter(range(0, len(a.cur)), lambda m: {fits})[1], len(a.cur))"
    packed = f"""list_reduce(l, lambda a, x: CASE WHEN a.total + x.total <= {size}
        THEN {{'cur': a.cur || x.cur, 'total': a.total + x.total, 'out': a.out}}
        ELSE {{'cur': a.cur[{drop} + 1:] || x.cur,
               'total': CAST(COALESCE(list_sum(list_transform(a.cur[{drop} + 1:], lambda y: y.n)), 0) + x.total AS BIGINT),
               'out': a.out || [{{'f': a.cur[1].beg, 't': a.cur[-1].beg + a.cur[-1].n}}]}} END)"""
    stripped = sql_strip("raw")
    left = f"ltrim(raw, {WS_CHARS_SQL})"
    return f"""(WITH {', '.join(levels)},
      small AS ({small}),
      runs AS (SELECT doc, lvl, seg, run, min(beg) AS beg, list({{'cur': [{{'beg': CAST(beg AS BIGINT), 'n': CAST(n AS BIGINT)}}],
                      'total': CAST(n AS BIGINT), 'out': CAST([] AS STRUCT(f BIGINT, t BIGINT)[])}} ORDER BY beg) AS l
               FROM small GROUP BY doc, lvl, seg, run),
      done AS (SELECT doc, beg, {packed} AS z FROM runs),
      spans AS (SELECT doc, beg, i, a.f AS f, a.t AS e FROM (SELECT doc, beg, unnest(range(1, len(o) + 1)) AS i, unnest(o) AS a FROM (
                  SELECT doc, beg, z.out || [{{'f': z.cur[1].beg, 't': z.cur[-1].beg + z.cur[-1].n}}] AS o FROM done))),
      cut AS (SELECT doc, beg, i, f, substring(whole, f + 1, e - f) AS raw, {keys} FROM spans JOIN s0 USING (doc))
      SELECT {keys}, row_number() OVER (PARTITION BY doc ORDER BY beg, i) - 1 AS chunk_ix,
             CAST(f + length(raw) - length({left}) AS INTEGER) AS chunk_start,
             CAST(f + length(raw) - length({left}) + length({stripped}) AS INTEGER) AS chunk_end, {stripped} AS chunk
      FROM cut WHERE {stripped} <> '')"""
