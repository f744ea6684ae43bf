"""Queries: file formats, sinks, upsert, streaming and corpus statistics
(S1, S2, S4, S8, S9, K1-K3, F13, F14, F20, F21, J7, Q6, T1-T3, T5, A4, A7,
A8, P9, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MASTER_INDEX_HEADER
from ..functions.chunking import chunk_fixed, chunk_id
from ..functions.filings import document_url, parse_filing_date
from ..functions.text import strip_ws
from ..operators import filings as fo
from ..session import scratch_path
from ..sinks import corpus as sc
from ..sinks import files as sf
from ..sources import files as src
from ..sources.landed import read_landed, write_landed
from ..sources.tables import read_table
from ..streaming.ingest_stream import chunk_stream, first_success
from . import derived as dv
from .q_filings import PAGE_ITEMS_SQL, SUB_FLAT_SQL, SUB_NAMES_SQL, page_items, submission_names
from .registry import CFG, register
from .sqlfrag import sql_fixed_chunks, sql_master_index_rows, sql_parse_date, sql_strip

# --- artifacts (K1, F21, S9, F13, F14) ----------------------------------------

def doc_artifacts(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    f = docs.select("doc_id", *[v.alias(k) for k, v in meta.items()], "text")
    f = fo.fill_company(f, submission_names(spark, d))
    f = f.withColumn("url", document_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")))
    return sf.artifact_frame(f, "text")


def _artifact_sql() -> str:
    m = dv.sql_doc_filing_meta("d.doc_id")
    company = f"""(CASE WHEN {m['company']} IS NULL OR {m['company']} = '' THEN
        {sql_strip("COALESCE(NULLIF(n.name, ''), 'CIK ' || " + m['cik'] + ")")} ELSE {m['company']} END)"""
    kept = f"regexp_replace({company}, '[^\\p{{L}}\\p{{N}}._\\- ]', '', 'g')"
    safe = f"substring({sql_strip(kept)}, 1, 80)"
    url = (f"('https://www.sec.gov/Archives/edgar/data/' || CAST(CAST({m['cik']} AS BIGINT) AS VARCHAR) || '/' || "
           f"replace({m['accessionNumber']}, '-', '') || '/' || {m['primaryDocument']})")
    name = (f"concat_ws('__', {m['filingDate']}, {m['cik']}, {safe}, replace({m['form']}, '/', '-'), "
            f"{m['accessionNumber']}) || '.txt'")
    text = (f"{company} || ' (CIK ' || {m['cik']} || ') | ' || {m['form']} || chr(10) || 'Filing Date: ' || "
            f"{m['filingDate']} || ' | Accession: ' || {m['accessionNumber']} || chr(10) || 'URL: ' || {url} || "
            f"chr(10) || chr(10) || '=== ITEM 1A. RISK FACTORS ===' || chr(10) || chr(10) || d.text")
    return f"""(SELECT d.doc_id, {name} AS artifact_name, {text} AS artifact_text
        FROM documents d LEFT JOIN {SUB_NAMES_SQL} n ON {m['cik']} = n.cik)"""


@register("artifact_render", f"SELECT doc_id, artifact_name, artifact_text FROM {_artifact_sql()}")
def q_artifact_render(spark, d):
    return doc_artifacts(spark, d).select("doc_id", "artifact_name", "artifact_text")


ART_RE2 = "^(\\d{4}-\\d{2}-\\d{2})__(\\d+)__(.+?)__(10-K(?:[/-]A)?)__([^/\\\\]+)\\.txt$"


@register(
    "artifact_parse",
    f"""SELECT doc_id, regexp_extract(artifact_name, '{ART_RE2}', 2) AS cik,
           regexp_extract(artifact_name, '{ART_RE2}', 3) AS company,
           regexp_extract(artifact_name, '{ART_RE2}', 4) AS form,
           regexp_extract(artifact_name, '{ART_RE2}', 1) AS filingDate,
           regexp_extract(artifact_name, '{ART_RE2}', 5) AS accessionNumber,
           CAST(substring(regexp_extract(artifact_name, '{ART_RE2}', 1), 1, 4) AS INTEGER) AS fiscalYear,
           {sql_strip("split_part(artifact_text, '=== ITEM 1A. RISK FACTORS ===', 2)")} AS body
        FROM {_artifact_sql()} WHERE regexp_matches(artifact_name, '{ART_RE2}')""",
)
def q_artifact_parse(spark, d):
    a = doc_artifacts(spark, d).select(
        "doc_id", src.parse_artifact(F.col("artifact_name"), F.col("artifact_text")).alias("a")
    )
    return a.where("a IS NOT NULL").select(
        "doc_id", "a.cik", "a.company", "a.form", "a.filingDate", "a.accessionNumber", "a.fiscalYear", "a.body"
    )


# --- manifest (F20, K2, S8, A3) ---------------------------------------------

@register(
    "manifest_json",
    f"""SELECT DISTINCT {dv.sql_doc_filing_meta('doc_id')['accessionNumber']} AS accessionNumber
        FROM documents WHERE doc_id % 9 NOT IN (0, 1, 2, 3)""",
)
def q_manifest_json(spark, d):
    """Manifest lines rendered as JSON (with bad lines mixed in) and read back
    to the seen set."""
    docs = read_table(spark, d, "documents", "doc_id")
    meta = dv.doc_filing_meta(F.col("doc_id"))
    rows = docs.select(
        "doc_id", meta["cik"].alias("cik"), meta["company"].alias("company"), meta["form"].alias("form"),
        meta["filingDate"].alias("filingDate"), meta["accessionNumber"].alias("accessionNumber"),
        F.lit("Item 1A").alias("section"), F.lit(CFG.embedding_model).alias("embedding_model"),
    )
    good = sf.manifest_json(rows.drop("doc_id"))
    k = F.col("doc_id") % 9
    line = (
        F.when(k == 0, F.lit("not json"))
        .when(k == 1, F.lit("[1,2]"))
        .when(k == 2, F.to_json(F.struct(F.col("cik"))))
        .when(k == 3, F.to_json(F.struct(F.lit("").alias("accessionNumber"))))
        .otherwise(good)
    )
    lines = rows.select(line.alias("value"))
    acc = src.parse_manifest_line(F.col("value"))["accessionNumber"]
    return fo.seen_accessions(lines.select(acc.alias("accessionNumber")))


# --- upsert (K3, J7, Q6) --------------------------------------------------------

def _chunk_versions(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "source", "text", "lang")
    old = chunk_fixed(docs.select("doc_id", "source", "text"), "text", CFG.chunk_size, CFG.chunk_overlap)
    old = old.select(
        chunk_id(F.col("doc_id"), F.col("source"), F.col("chunk_ix")).alias("chunk_id"), "doc_id",
        F.col("chunk_ix").cast("long"), F.length("chunk").cast("long").alias("chunk_len"),
        F.lit(1).cast("long").alias("version"),
    )
    fr = docs.where(F.col("lang") == "fr").select("doc_id", "source", "text")
    new = chunk_fixed(fr, "text", 2000, CFG.chunk_overlap).select(
        chunk_id(F.col("doc_id"), F.col("source"), F.col("chunk_ix")).alias("chunk_id"), "doc_id",
        F.col("chunk_ix").cast("long"), F.length("chunk").cast("long").alias("chunk_len"),
        F.lit(2).cast("long").alias("version"),
    )
    # The first chunk is sent twice in the batch; the later copy (v3) wins.
    again = new.where(F.col("chunk_ix") == 0).withColumn("chunk_len", F.lit(0).cast("long")).withColumn(
        "version", F.lit(3).cast("long")
    )
    return old, new.unionByName(again)


def _upsert_sql(replace: bool) -> str:
    old = sql_fixed_chunks("documents", "doc_id, source", "text", CFG.chunk_size, CFG.chunk_overlap)
    new = sql_fixed_chunks("(SELECT * FROM documents WHERE lang = 'fr')", "doc_id, source", "text", 2000,
                           CFG.chunk_overlap)
    ident = "sha1(CAST(doc_id AS VARCHAR) || '__' || source || '__' || CAST(chunk_ix AS VARCHAR))"
    cond = "o.doc_id NOT IN (SELECT doc_id FROM n)" if replace else "o.chunk_id NOT IN (SELECT chunk_id FROM n)"
    return f"""
    WITH o AS (SELECT {ident} AS chunk_id, doc_id, chunk_ix, CAST(length(chunk) AS BIGINT) AS chunk_len,
                      CAST(1 AS BIGINT) AS version FROM ({old})),
    n0 AS (SELECT {ident} AS chunk_id, doc_id, chunk_ix, CAST(length(chunk) AS BIGINT) AS chunk_len,
                  CAST(2 AS BIGINT) AS version FROM ({new})),
    n AS (SELECT chunk_id, doc_id, chunk_ix, CASE WHEN chunk_ix = 0 THEN 0 ELSE chunk_len END AS chunk_len,
                 CASE WHEN chunk_ix = 0 THEN 3 ELSE 2 END AS version FROM n0)
    SELECT chunk_id, doc_id, chunk_ix, chunk_len, version FROM o WHERE {cond}
    UNION ALL SELECT chunk_id, doc_id, chunk_ix, chunk_len, version FROM n"""


@register("upsert_merge", _upsert_sql(False))
def q_upsert_merge(spark, d):
    old, new = _chunk_versions(spark, d)
    return sc.upsert(old, new, key="chunk_id", order_col="version")


@register("upsert_replace", _upsert_sql(True))
def q_upsert_replace(spark, d):
    old, new = _chunk_versions(spark, d)
    return sc.upsert(old, new, key="chunk_id", order_col="version", replace_by=["doc_id"])


@register("upsert_roundtrip", _upsert_sql(True))
def q_upsert_roundtrip(spark, d):
    """Both batches stored (the second twice, as a replay would) and
    read back as the current view."""
    old, new = _chunk_versions(spark, d)
    store = scratch_path(spark, "upsert")
    sc.upsert_corpus(old, store, "1")
    sc.upsert_corpus(new, store, "2")
    sc.upsert_corpus(new, store, "2")
    return src.open_corpus(spark, store, ["doc_id"])


@register(
    "artifact_roundtrip",
    f"""SELECT artifact_name, {sql_strip("split_part(artifact_text, '=== ITEM 1A. RISK FACTORS ===', 2)")} AS body
        FROM {_artifact_sql()}""",
)
def q_artifact_roundtrip(spark, d):
    """K1: artifacts written twice (a repeated run) and read back once each."""
    path = scratch_path(spark, "artifacts")
    rows = doc_artifacts(spark, d)
    sf.write_artifacts(rows, path)
    sf.write_artifacts(rows, path)
    back = spark.read.parquet(path)
    parts = F.split("artifact_text", "\\Q=== ITEM 1A. RISK FACTORS ===\\E", 2)
    return back.select("artifact_name", strip_ws(F.get(parts, 1)).alias("body"))


@register(
    "manifest_roundtrip",
    f"""SELECT DISTINCT {dv.sql_doc_filing_meta('doc_id')['accessionNumber']} AS accessionNumber FROM documents""",
)
def q_manifest_roundtrip(spark, d):
    """Manifest lines appended twice are held once; read as the seen set."""
    path = scratch_path(spark, "manifest")
    docs = read_table(spark, d, "documents", "doc_id")
    rows = docs.select(*[v.alias(k) for k, v in dv.doc_filing_meta(F.col("doc_id")).items()])
    sf.append_manifest(rows, path)
    sf.append_manifest(rows, path)
    lines = spark.read.text(path)
    acc = src.parse_manifest_line(F.col("value"))["accessionNumber"]
    once = lines.groupBy(acc.alias("accessionNumber")).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return src.read_seen_accessions(spark, path).join(once, "accessionNumber").select("accessionNumber")


@register(
    "daily_index_files",
    f"""SELECT file_date, line_no, cik, company, form, date_filed, filename
        FROM {sql_master_index_rows(dv.sql_index_files(), MASTER_INDEX_HEADER)}
        WHERE form IN ('10-K', '10-K/A', '10-Q', '10-Q/A')
          AND file_date = (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE day(o_orderdate) <> 13
                           GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1)""",
)
def q_daily_index_files(spark, d):
    """The index file of the busiest order date that has a header, landed
    under its name and read by date (one date is the feature)."""
    days = read_table(spark, d, "orders", "o_orderdate").where(F.dayofmonth("o_orderdate") != 13).groupBy(
        F.col("o_orderdate").cast("date").alias("d")).count()
    last = days.orderBy(F.desc("count"), "d").first().d
    base = scratch_path(spark, "daily-index")
    day = dv.index_files(spark, d).where(F.col("file_date") == last.isoformat())
    day.select("text").write.text(src.daily_index_path(base, last))
    return src.read_daily_index(spark, base, last)


@register(
    "landed_index",
    f"""SELECT file_date, file_part, line_no, cik, company, form, date_filed, filename
        FROM {sql_master_index_rows(dv.sql_index_files(), MASTER_INDEX_HEADER)}""",
)
def q_landed_index(spark, d):
    """The index files of all order dates, landed by the committed writer
    in the layout of the real ones, read and parsed again."""
    base = scratch_path(spark, "landed-index")
    day = F.col("file_date").cast("date")
    files = dv.index_files(spark, d).select(
        F.concat(F.date_format(day, "yyyy"), F.lit("/QTR"), F.quarter(day).cast("string"), F.lit("/master."),
                 F.date_format(day, "yyyyMMdd"), F.lit(".idx/"), F.format_string("%09d.txt", "file_part")).alias("name"),
        "text")
    write_landed(files, base)
    part = F.regexp_extract("name", r"([0-9]+)\.txt$", 1).cast("long")
    return fo.parse_master_index(read_landed(spark, base).select("file_date", part.alias("file_part"), "text"))


# --- JSON sources (S1, S2/S3, S4) ----------------------------------------------

@register("company_list_json", "SELECT CAST(c_custkey AS VARCHAR) AS cik FROM customer")
def q_company_list_json(spark, d):
    """Company lists as JSON objects keyed by ordinal, one object per 1,000
    consecutive customer keys (bounded files, like the real list)."""
    c = read_table(spark, d, "customer", "c_custkey", "c_name")
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("key"),
        F.struct(F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("title")).alias("value"),
    )
    objs = c.groupBy(F.floor(F.col("c_custkey") / 1000).alias("_file")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text")
    )
    return objs.select(F.explode(src.parse_company_list(F.col("text"))).alias("cik"))


@register(
    "submissions_json",
    f"SELECT cik, name, pos, form, accessionNumber, primaryDocument, filingDate FROM {SUB_FLAT_SQL}",
)
def q_submissions_json(spark, d):
    """Submissions rendered as JSON files named CIK##########.json, read back
    with the explicit schema and flattened."""
    subs = dv.submissions(spark, d)
    files = subs.select(
        src.submissions_file_name(F.col("cik")).alias("file_name"),
        F.to_json(F.struct("name", "filings")).alias("text"),
    )
    j = F.from_json(F.col("text"), src.SUBMISSIONS)
    parsed = files.select(
        src.cik_from_submissions_name(F.col("file_name")).alias("cik"), j["name"].alias("name"),
        j["filings"].alias("filings"),
    )
    return fo.flatten_submissions(parsed)


@register(
    "filing_index_json",
    f"""
    SELECT h.filing, COALESCE(b.name, h.filing || '.xml') AS primary
    FROM (SELECT DISTINCT filing FROM {PAGE_ITEMS_SQL}) h
    LEFT JOIN (SELECT filing, name FROM {PAGE_ITEMS_SQL}
               WHERE (lower(name) LIKE '%.htm' OR lower(name) LIKE '%.html')
                 AND (contains(lower(name), '10-k') OR contains(lower(name), '10k'))
               QUALIFY row_number() OVER (PARTITION BY filing ORDER BY length(name), pos) = 1) b
      ON h.filing = b.filing
    """,
)
def q_filing_index_json(spark, d):
    """Directory listings rendered as index.json per filing, parsed (S4) and
    reduced to the main document (P4, O6)."""
    items = page_items(spark, d)
    listing = items.groupBy("filing").agg(
        F.to_json(
            F.struct(
                F.struct(
                    F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))),
                                lambda x: F.struct(x["name"].alias("name"))).alias("item")
                ).alias("directory")
            )
        ).alias("text")
    )
    parsed = listing.select("filing", F.posexplode(src.parse_filing_index(F.col("text"))).alias("pos", "name"))
    filings = listing.select("filing", F.concat(F.col("filing"), F.lit(".xml")).alias("primaryDocument"))
    best = fo.best_primary_doc(parsed, "filing")
    return fo.with_primary_doc(filings, best, "filing").select("filing", "primary")


# --- streaming (T1-T3, T5) ----------------------------------------------------

@register(
    "stream_ingest",
    f"""SELECT doc_id, chunk_ix, sha1(CAST(doc_id AS VARCHAR) || '__' || source || '__' || CAST(chunk_ix AS VARCHAR))
           AS chunk_id FROM ({sql_fixed_chunks('documents', 'doc_id, source', 'text', CFG.chunk_size, CFG.chunk_overlap)})""",
)
def q_stream_ingest(spark, d):
    """Landed documents chunked by an availableNow stream into a Parquet sink;
    the sink equals the batch result."""
    run = scratch_path(spark, "stream")
    docs = read_table(spark, d, "documents", "doc_id", "source", "text")
    docs.write.parquet(f"{run}/landing")
    out = chunk_stream(
        spark, f"{run}/landing", docs.schema, f"{run}/sink", f"{run}/checkpoint", key_cols=("doc_id", "source"))
    return out.select("doc_id", F.col("chunk_ix").cast("long"), "chunk_id")


@register(
    "stream_late_seen",
    f"""SELECT doc_id, chunk_ix, sha1(CAST(doc_id AS VARCHAR) || '__' || CAST(chunk_ix AS VARCHAR)) AS chunk_id
        FROM ({sql_fixed_chunks('(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))', 'doc_id',
                                'text', CFG.chunk_size, CFG.chunk_overlap)})""",
)
def q_stream_late_seen(spark, d):
    """Documents of the label table are seen already; other languages
    land late, after a first run, and a third run finds nothing new."""
    run = scratch_path(spark, "stream")
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang")
    seen = read_table(spark, d, "labels", "doc_id")
    late = F.coalesce(F.col("lang") != "en", F.lit(True))
    for part in (docs.where(~late), docs.where(late), None):
        if part is not None:
            part.select("doc_id", "text").write.mode("append").parquet(f"{run}/landing")
        out = chunk_stream(spark, f"{run}/landing", "doc_id bigint, text string", f"{run}/sink", f"{run}/checkpoint",
                           key_cols=("doc_id",), seen=seen.select(F.col("doc_id").alias("accessionNumber")),
                           seen_col="doc_id")
    return out.select("doc_id", F.col("chunk_ix").cast("long"), "chunk_id")


@register(
    "stream_first_success",
    """WITH e AS (SELECT *, event_id % 2 AS pass FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
        w AS (SELECT user_id, min(pass) AS pass FROM e WHERE event_type <> 'error' GROUP BY user_id),
        f AS (SELECT e.user_id, min_by(e.event_id, (e.ts, CAST(e.event_id AS VARCHAR))) AS event_id
              FROM e JOIN w ON w.user_id = e.user_id AND w.pass = e.pass WHERE e.event_type <> 'error' GROUP BY e.user_id)
        SELECT f.user_id, f.event_id, CAST((SELECT count(*) FROM e JOIN w ON w.user_id = e.user_id
          WHERE e.user_id = f.user_id AND e.pass <= w.pass AND (e.event_type = 'error' OR e.event_type IS NULL)) AS BIGINT) AS failures
        FROM f""",
)
def q_stream_first_success(spark, d):
    """Events as ingestion attempts of users, errors as failed ones; odd
    events land after a first pass, and a third pass finds nothing new. The
    earliest success of the first pass that has one is accepted."""
    run = scratch_path(spark, "stream")
    events = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    odd = F.col("event_id") % 2 == 1
    for part in (events.where(~odd), events.where(odd), None):
        if part is not None:
            part.write.mode("append").parquet(f"{run}/landing")
        out = first_success(spark, f"{run}/landing", events.schema, f"{run}/sink", f"{run}/checkpoint",
                            ok="event_type <> 'error'", key="user_id", attempt="event_id", event_col="ts", delay="3650 days",
                            keep_days=3650)
    return out.select(F.col("key").cast("long").alias("user_id"), F.col("attempt").cast("long").alias("event_id"), "failures")


# --- corpus statistics (A4, A7, A8, P9, U4) ------------------------------------

@register(
    "corpus_stats",
    f"""WITH s AS (SELECT cik, accessionNumber, {sql_parse_date('filingDate')} AS d FROM {SUB_FLAT_SQL})
        SELECT count(*) AS total_vectors, count(DISTINCT cik) AS companies,
               strftime(max(d), '%Y-%m-%d') AS last_update,
               CAST(sum(CASE WHEN d = (SELECT max(d) FROM s) THEN 1 ELSE 0 END) AS BIGINT) AS latest_batch
        FROM s""",
)
def q_corpus_stats(spark, d):
    """Total rows, companies, last filing date and its batch size.
    Two one-row aggregates (both partially aggregated before any shuffle),
    merged by a union and a global max (no join)."""
    rows = dv.submission_rows(spark, d).select("cik", parse_filing_date(F.col("filingDate")).alias("d"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.countDistinct("cik").alias("companies"),
        F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_update"),
    )
    latest = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("n", "d").cast("long").alias("latest_batch")
    )
    cols = ["total_vectors", "companies", "last_update", "latest_batch"]
    a = totals.withColumn("latest_batch", F.lit(None).cast("long"))
    b = latest.select(F.lit(None).cast("long").alias("total_vectors"), F.lit(None).cast("long").alias("companies"),
                      F.lit(None).cast("string").alias("last_update"), "latest_batch")
    return a.select(*cols).unionByName(b).agg(*[F.max(c).alias(c) for c in cols])


@register(
    "date_exists",
    f"""WITH checks AS (SELECT DISTINCT CASE WHEN day(l_shipdate) % 2 = 0 THEN strftime(l_shipdate, '%Y%m%d')
                                          ELSE strftime(l_shipdate, '%Y-%m-%d') END AS check_date FROM lineitem),
        dates AS (SELECT DISTINCT {sql_parse_date('filingDate')} AS d FROM {SUB_FLAT_SQL})
        SELECT check_date, {sql_parse_date('check_date')} IN (SELECT d FROM dates WHERE d IS NOT NULL) AS exists_flag
        FROM checks""",
)
def q_date_exists(spark, d):
    """A8 for many dates at once: does the corpus hold a filing of that date?
    Check dates come in both formats and are parsed before the semi join."""
    li = read_table(spark, d, "lineitem", "l_shipdate")
    checks = li.select(
        F.when(F.dayofmonth("l_shipdate") % 2 == 0, F.date_format("l_shipdate", "yyyyMMdd"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("check_date")
    ).distinct()
    dates = dv.submission_rows(spark, d).select(parse_filing_date(F.col("filingDate")).alias("d")).where(
        "d IS NOT NULL"
    ).distinct()
    c = checks.withColumn("_d", parse_filing_date(F.col("check_date")))
    return c.join(dates, c._d == dates.d, "left").select("check_date", F.col("d").isNotNull().alias("exists_flag"))
