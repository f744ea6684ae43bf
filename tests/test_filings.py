from pyspark.sql import functions as F

from corpusengine.config import MASTER_INDEX_HEADER
from corpusengine.operators import filings as fo
from corpusengine.plans import ingest as ing

HDR = MASTER_INDEX_HEADER


def test_master_index_golden(spark):
    text = "\n".join([
        "Description: Daily Index",
        "Last Data Received: x",
        "",
        "   " + HDR,
        "-" * 40,
        "1|Acme|10-K|2024-01-02|edgar/1.txt",
        " 2 | Beta Co |10-K/A| 2024-01-02 |edgar/2.txt ",
        "3|four|fields|only",
        "4|a|b|c|d|six",
        "",
    ])
    files = spark.createDataFrame([("f1", text), ("f2", "no header here\n1|a|b|c|d")], "file_date string, text string")
    rows = fo.parse_master_index(files).orderBy("line_no").collect()
    assert [(r.cik, r.company, r.form, r.date_filed, r.filename) for r in rows] == [
        ("1", "Acme", "10-K", "2024-01-02", "edgar/1.txt"),
        ("2", "Beta Co", "10-K/A", "2024-01-02", "edgar/2.txt"),
    ]
    assert all(r.file_date == "f1" for r in rows)


def test_form_filters(spark):
    df = spark.createDataFrame([(f,) for f in ["10-K", "10-K/A", "10-Q", "10-Q/A", "8-K"]], "form string")
    assert fo.filter_forms(df).count() == 4
    assert fo.filter_forms(df, ("10-K", "10-K/A")).count() == 2


def _subs(spark, rows):
    return spark.createDataFrame(rows, "cik string, pos long, form string, accessionNumber string, "
                                       "primaryDocument string, filingDate string")


def test_top_n_stable_and_short(spark):
    subs = _subs(spark, [
        ("1", 0, "10-K", "a0", "d", "2024-01-01"),
        ("1", 1, "10-K/A", "a1", "d", "2024-01-01"),
        ("1", 2, "10-Q", "a2", "d", "2025-01-01"),
        ("1", 3, "10-K", "a3", "d", "2023-01-01"),
        ("1", 4, "10-K", "a4", "d", "2022-01-01"),
        ("2", 0, "10-K", "b0", "d", "2020-01-01"),
    ])
    top = fo.top_n_filings(subs, 3).orderBy("cik", "rank").collect()
    assert [(r.cik, r.accessionNumber) for r in top] == [("1", "a0"), ("1", "a1"), ("1", "a3"), ("2", "b0")]


def test_history_no_10k(spark):
    subs = _subs(spark, [("1", 0, "10-Q", "a0", "d", "2024-01-01")])
    ciks = spark.createDataFrame([("1", 0), ("2", 1)], "cik string, pos long")
    names = spark.createDataFrame([("1", "One")], "cik string, name string")
    filings, none = ing.history_filings(ciks, subs, names)
    assert filings.count() == 0
    assert sorted((r.cik, r.reason) for r in none.collect()) == [("1", "no_10k_recent"), ("2", "no_10k_recent")]


def test_match_first_two_date_formats(spark):
    idx = spark.createDataFrame(
        [("d", 1, "1", "A", "10-K", "2024-12-23", "f"), ("d", 2, "1", "A", "10-K", "2024-12-24", "f")],
        "file_date string, line_no long, cik string, company string, form string, date_filed string, filename string",
    )
    subs = _subs(spark, [("1", 0, "10-K", "first", "p0", "20241223"), ("1", 1, "10-K", "second", "p1", "2024-12-23")])
    seen = spark.createDataFrame([("zzz",)], "accessionNumber string")
    out = fo.prepare_daily(fo.match_first_submission(idx, subs), seen).orderBy("line_no").collect()
    assert [(r.accessionNumber, r.reason) for r in out] == [("first", None), (None, "not_found_in_submissions_recent")]
    seen2 = spark.createDataFrame([("first",)], "accessionNumber string")
    out2 = fo.prepare_daily(fo.match_first_submission(idx, subs), seen2).orderBy("line_no").collect()
    assert out2[0].reason == "already_seen"


def test_main_document_choice(spark):
    items = spark.createDataFrame(
        [("a", 0, "R1.xml"), ("a", 1, "Form10-K.HTM"), ("a", 2, "x10k.htm"), ("a", 3, "y10k.htm"),
         ("b", 0, "ex21.htm")],
        "accessionNumber string, pos long, name string",
    )
    filings = spark.createDataFrame([("a", "def_a"), ("b", "def_b")], "accessionNumber string, primaryDocument string")
    best = fo.best_primary_doc(items, "accessionNumber")
    got = {r.accessionNumber: r.primary for r in fo.with_primary_doc(filings, best, "accessionNumber").collect()}
    assert got == {"a": "x10k.htm", "b": "def_b"}


def test_first_occurrence_rules(spark):
    batch = spark.createDataFrame(
        [(0, "A", None), (1, "A", None), (2, "B", "B:no_item_1a"), (3, "B", None), (4, "C", None)],
        "input_pos long, accessionNumber string, r string",
    )
    out = fo.first_occurrence_status(batch, F.col("r")).orderBy("input_pos").collect()
    assert [r.reason for r in out] == [None, "already_ingested:A", "B:no_item_1a", "B:no_item_1a", None]


def test_seen_manifest_lines(spark):
    from corpusengine.sources.files import parse_manifest_line

    lines = spark.createDataFrame(
        [('{"accessionNumber":"a1"}',), ("not json",), ("[1,2]",), ('{"cik":"1"}',), ('{"accessionNumber":""}',),
         ('{"accessionNumber":"a1"}',)],
        "value string",
    )
    seen = fo.seen_accessions(lines.select(parse_manifest_line(F.col("value"))["accessionNumber"].alias("accessionNumber")))
    assert [r.accessionNumber for r in seen.collect()] == ["a1"]


def test_ingest_duplicate_in_batch(spark):
    filings = spark.createDataFrame(
        [(0, "1", "acc-1", "p", "2024-01-01", "10-K", "X"), (1, "1", "acc-1", "p", "2024-01-01", "10-K", "X"),
         (2, "2", "acc-2", "p", "2024-01-01", None, None)],
        "input_pos long, cik string, accessionNumber string, primaryDocument string, filingDate string, "
        "form string, company string",
    )
    body = "Item 1A. Risk Factors\n" + "word " * 300 + "\nItem 2. Properties"
    raw = spark.createDataFrame([("acc-1", f"<p>{body}</p>")], "accessionNumber string, html string")
    seen = spark.createDataFrame([], "accessionNumber string")
    st = ing.ingest_filings(filings, raw, seen).orderBy("input_pos").collect()
    assert st[0].reason is None and st[0].chunks == 2
    assert st[1].reason == "already_ingested:acc-1"
    assert st[2].reason.startswith("error:") and st[2].form == "10-K" and st[2].company == "CIK 2"


def test_recursive_chunk_counts_match_corpus(spark):
    from support import SF001
    from corpusengine.plans import q_ingest as qi
    from corpusengine.plans.registry import CFG

    batch = qi.doc_ingest(spark, SF001, chunker="recursive")
    counts = {r.accessionNumber: r.chunks for r in ing.records(batch.status).collect()}
    chunks = ing.corpus_chunks(batch.parsed, CFG, chunker="recursive").groupBy("accessionNumber").count().collect()
    assert counts and counts == {r.accessionNumber: r["count"] for r in chunks}
