import datetime as dt
import json
import os

from corpusengine.plans.daily import CORPUS_KEY, date_in_corpus, run_daily
from corpusengine.sinks.corpus import read_corpus
from corpusengine.sources.files import daily_index_path, read_seen_accessions

BODY = "Item 1A. Risk Factors\n" + ("Risk words here. " * 120) + "\n7\nItem 1B. Unresolved\nItem 2. Properties"


def _land(root, day):
    idx = daily_index_path(os.path.join(root, "daily-index"), day)
    os.makedirs(os.path.dirname(idx))
    with open(idx, "w") as f:
        f.write("Description: x\n\nCIK|Company Name|Form Type|Date Filed|Filename\n----\n"
                f"42|Acme Corp|10-K|{day:%Y-%m-%d}|edgar/a.txt\n"
                f"43|Beta Inc|10-K/A|{day:%Y-%m-%d}|edgar/b.txt\n"
                f"44|Gamma|8-K|{day:%Y-%m-%d}|edgar/c.txt\n"
                f"45|Delta|10-K|{day:%Y-%m-%d}|edgar/d.txt\n")
    subs = os.path.join(root, "submissions", f"{day:%Y%m%d}")
    os.makedirs(subs)
    for cik, form, acc in (("42", "10-K", "0000000042-24-000001"), ("43", "10-K/A", "0000000043-24-000002")):
        rec = {"name": f"Co {cik}", "filings": {"recent": {
            "form": ["8-K", form], "accessionNumber": ["x-" + acc, acc],
            "primaryDocument": ["x.htm", "main.htm"], "filingDate": [f"{day:%Y-%m-%d}", f"{day:%Y%m%d}"]}}}
        with open(os.path.join(subs, f"CIK{int(cik):010d}.json"), "w") as f:
            json.dump(rec, f)
    docs = os.path.join(root, "filings", f"{day:%Y%m%d}")
    os.makedirs(os.path.join(docs, "0000000042-24-000001"))
    # An exhibit and a listing beside the main document.
    with open(os.path.join(docs, "0000000042-24-000001", "ex1.htm"), "w") as f:
        f.write("<p>Exhibit</p>")
    with open(os.path.join(docs, "0000000042-24-000001", "index.json"), "w") as f:
        json.dump({"directory": {"item": [{"name": "ex1.htm"}, {"name": "main.htm"}]}}, f)
    with open(os.path.join(docs, "0000000042-24-000001", "main.htm"), "w") as f:
        f.write("<html><body>" + "".join(f"<p>{ln}</p>\n" for ln in BODY.split("\n")) + "</body></html>")
    # 43's document is missing -> error reason, no record


def test_daily_run_end_to_end(spark, tmp_path):
    day = dt.date(2024, 12, 23)
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    _land(landing, day)
    s1 = run_daily(spark, landing, state, day)
    assert s1["found"] == 3  # the 8-K row is filtered out
    assert s1["prepared"] == 2 and s1["missed"] == 1
    assert s1["processed"] == 1 and s1["skipped"] == 1
    corpus = read_corpus(spark, os.path.join(state, "corpus"), CORPUS_KEY)
    assert corpus.count() == s1["total_chunks"] == s1["total_vectors"] > 0
    assert {r.accessionNumber for r in corpus.collect()} == {"0000000042-24-000001"}
    seen = read_seen_accessions(spark, os.path.join(state, "manifest"))
    assert [r[0] for r in seen.collect()] == ["0000000042-24-000001"]
    # re-run: already seen, corpus unchanged
    s2 = run_daily(spark, landing, state, day)
    assert s2["prepared"] == 1 and s2["missed"] == 2
    assert read_corpus(spark, os.path.join(state, "corpus"), CORPUS_KEY).count() == corpus.count()
    records = spark.read.parquet(os.path.join(state, "records")).collect()
    assert [r.accessionNumber for r in records] == ["0000000042-24-000001"]
    skipped = {r.reason for r in spark.read.parquet(os.path.join(state, "skips")).collect()}
    assert skipped == {"error:filing document not found", "not_found_in_submissions_recent", "already_seen"}
    # a day without an index file (weekend / holiday)
    s3 = run_daily(spark, landing, state, dt.date(2024, 12, 25))
    assert s3["found"] == 0 and s3["already_in_corpus"] is False
    assert date_in_corpus(spark, os.path.join(state, "corpus"), day) is True
    assert date_in_corpus(spark, os.path.join(state, "corpus"), dt.date(2024, 12, 25)) is False


def test_a_run_that_died_before_the_manifest_repeats_nothing(spark, tmp_path):
    """Artifacts and corpus of the first run stay single when it is run again."""
    day = dt.date(2024, 12, 23)
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    _land(landing, day)
    run_daily(spark, landing, state, day)
    n = read_corpus(spark, os.path.join(state, "corpus"), CORPUS_KEY).count()
    os.rename(os.path.join(state, "manifest"), os.path.join(state, "manifest-lost"))
    run_daily(spark, landing, state, day)
    assert spark.read.parquet(os.path.join(state, "artifacts")).count() == 1
    assert read_corpus(spark, os.path.join(state, "corpus"), CORPUS_KEY).count() == n


def test_only_the_days_files_are_opened(spark, tmp_path):
    """Another day's landed files (unreadable here) do not matter."""
    day = dt.date(2024, 12, 23)
    landing = str(tmp_path / "landing")
    _land(landing, day)
    other = os.path.join(landing, "submissions", "20241220")
    os.makedirs(other)
    with open(os.path.join(other, "CIK0000000042.json"), "w") as f:
        f.write('{"name": "Other", "filings": {"recent": {"form": ["10-K"], "accessionNumber": ["wrong"], '
                '"primaryDocument": ["x"], "filingDate": ["2024-12-23"]}}}')
    out = run_daily(spark, landing, str(tmp_path / "state"), day)
    assert out["processed"] == 1 and out["prepared"] == 2


def test_stored_dates_read_one_partition(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusengine.sinks import corpus as sc

    rows = spark.createDataFrame([("a", 2023, 1), ("b", 2024, 1)], "chunk_id string, fiscalYear int, version long")
    sc.upsert_corpus(rows, str(tmp_path / "c"), "1", partition_by=["fiscalYear"])
    sc.upsert_corpus(rows, str(tmp_path / "c"), "2", partition_by=["fiscalYear"])
    view = sc.read_corpus(spark, str(tmp_path / "c"), where=F.col("fiscalYear") == 2024)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(fiscalYear") >= 2
    assert [r.chunk_id for r in view.collect()] == ["b"]
