import datetime as dt
import json
import os

from pyspark.sql import functions as F

from support import SF01
from corpusengine.functions.chunking import chunk_fixed, chunk_id
from corpusengine.sinks import corpus as sc
from corpusengine.sinks import files as sf
from corpusengine.sources import files as src
from corpusengine.streaming.ingest_stream import chunk_stream


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc long, ix long, text string, version long")


def test_upsert_merge_replace(spark):
    old = _chunks(spark, [("a0", 1, 0, "old", 1), ("a1", 1, 1, "old", 1), ("a2", 1, 2, "old", 1),
                          ("b0", 2, 0, "keep", 1)])
    new = _chunks(spark, [("a0", 1, 0, "new", 2), ("a0", 1, 0, "newer", 3)])
    merged = {r.chunk_id: r.text for r in sc.upsert(old, new).collect()}
    assert merged == {"a0": "newer", "a1": "old", "a2": "old", "b0": "keep"}
    replaced = {r.chunk_id: r.text for r in sc.upsert(old, new, replace_by=["doc"]).collect()}
    assert replaced == {"a0": "newer", "b0": "keep"}
    # idempotent
    twice = sc.upsert(sc.upsert(old, new), new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, sc.upsert(old, new).collect()))


def test_new_columns_are_kept(spark):
    old = _chunks(spark, [("a0", 1, 0, "old", 1)])
    new = _chunks(spark, [("b0", 2, 0, "new", 2)]).withColumn("embedding", F.array(F.lit(1.0)))
    out = {r.chunk_id: r.embedding for r in sc.upsert(old, new).collect()}
    assert out == {"a0": None, "b0": [1.0]}


def test_stored_corpus(spark, tmp_path):
    base = str(tmp_path / "corpus")
    assert src.open_corpus(spark, base) is None
    sc.upsert_corpus(_chunks(spark, [("a0", 1, 0, "x", 1), ("a1", 1, 1, "x", 1), ("b0", 2, 0, "x", 1)]), base, "2024-01-01")
    for _ in range(2):  # a load that is sent again replaces itself
        sc.upsert_corpus(_chunks(spark, [("a1", 1, 1, "y", 2)]).withColumn("embedding", F.lit(0.5)), base, "2024-01-02")
    assert {r.chunk_id: r.text for r in src.open_corpus(spark, base).collect()} == {"a0": "x", "a1": "y", "b0": "x"}
    by_doc = src.open_corpus(spark, base, ["doc"])
    assert {r.chunk_id: r.embedding for r in by_doc.collect()} == {"a1": 0.5, "b0": None}
    assert "load" not in by_doc.columns
    # One scan a side, however many loads there are.
    assert by_doc._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert sc.batch_count(0, 10) == 0 and sc.batch_count(10001, 10000) == 2


def test_stream_equals_batch_and_late_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source", "text")
    land, sink, ck = (str(tmp_path / n) for n in ("landing", "sink", "ck"))
    parts = docs.withColumn("_p", F.col("doc_id") % 4)
    for p in range(3):
        parts.where(F.col("_p") == p).drop("_p").write.mode("append").parquet(land)
    schema = docs.schema
    out = chunk_stream(spark, land, schema, sink, ck, key_cols=("doc_id", "source"), max_files_per_trigger=2)
    n1 = out.count()
    again = chunk_stream(spark, land, schema, sink, ck, key_cols=("doc_id", "source"))
    assert again.count() == n1  # re-run is a no-op
    parts.where(F.col("_p") == 3).drop("_p").write.mode("append").parquet(land)  # late files
    final = chunk_stream(spark, land, schema, sink, ck, key_cols=("doc_id", "source"))
    batch = chunk_fixed(docs, "text", 1500, 200).select(
        "doc_id", "chunk_ix", chunk_id(F.col("doc_id"), F.col("source"), F.col("chunk_ix")).alias("chunk_id"))
    assert final.count() == batch.count() > n1
    assert final.select("doc_id", "chunk_ix", "chunk_id").exceptAll(batch).count() == 0


def test_stream_skips_seen(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a1", "text one"), (2, "a2", "text two")],
                                 "doc_id long, accessionNumber string, text string")
    land = str(tmp_path / "l")
    docs.write.parquet(land)
    seen = spark.createDataFrame([("a1",)], "accessionNumber string")
    out = chunk_stream(spark, land, docs.schema, str(tmp_path / "s"), str(tmp_path / "c"),
                       key_cols=("doc_id",), seen=seen)
    assert [r.doc_id for r in out.collect()] == [2]


def test_file_readers(spark, tmp_path):
    d = tmp_path
    (d / "tickers").mkdir()
    (d / "tickers" / "company_tickers.json").write_text(
        json.dumps({"0": {"cik_str": 320193, "ticker": "A", "title": "X"}, "1": {"cik_str": 5, "title": "Y"}}))
    assert sorted(r.cik for r in src.read_company_list(spark, str(d / "tickers")).collect()) == ["320193", "5"]

    (d / "subs").mkdir()
    (d / "subs" / "CIK0000000042.json").write_text(json.dumps(
        {"name": "Co", "filings": {"recent": {"form": ["10-K"], "accessionNumber": ["a"],
                                              "primaryDocument": ["d.htm"], "filingDate": ["2024-01-01"]}}}))
    row = src.read_submissions(spark, str(d / "subs")).first()
    assert row.cik == "42" and row.name == "Co"

    (d / "idx" / "0001-24-1").mkdir(parents=True)
    (d / "idx" / "0001-24-1" / "index.json").write_text(
        json.dumps({"directory": {"item": [{"name": "a.xml"}, {"name": "b10k.htm"}]}}))
    items = src.read_filing_index(spark, str(d / "idx" / "*" / "index.json")).collect()
    assert [(r.key, r.pos, r.name) for r in items] == [("0001-24-1", 0, "a.xml"), ("0001-24-1", 1, "b10k.htm")]

    day = dt.date(2024, 12, 23)
    path = src.daily_index_path(str(d / "daily"), day)
    os.makedirs(os.path.dirname(path))
    with open(path, "w") as f:
        f.write("pre\nCIK|Company Name|Form Type|Date Filed|Filename\n---\n1|A|10-K|2024-12-23|x\n2|B|8-K|2024-12-23|y\n")
    assert src.read_daily_index(spark, str(d / "daily"), day).count() == 1
    assert src.read_daily_index(spark, str(d / "daily"), dt.date(2024, 12, 24)).count() == 0

    (d / "manifest").mkdir()
    (d / "manifest" / "m.jsonl").write_text('{"accessionNumber":"a1"}\nnot json\n[1,2]\n{"x":1}\n')
    assert [r[0] for r in src.read_seen_accessions(spark, str(d / "manifest")).collect()] == ["a1"]
    assert src.read_seen_accessions(spark, str(d / "missing")).count() == 0

    (d / "art").mkdir()
    (d / "art" / "2024-01-02__42__Acme Co__10-K-A__0001-24-9.txt").write_text(
        "Acme Co (CIK 42) | 10-K/A\nFiling Date: x\nURL: u\n\n=== ITEM 1A. RISK FACTORS ===\n\n  body text \n")
    (d / "art" / "notes.txt").write_text("ignored")
    arts = src.read_artifacts(spark, str(d / "art")).collect()
    assert len(arts) == 1 and arts[0].body == "body text" and arts[0].fiscalYear == 2024


def test_artifact_render_roundtrip(spark):
    df = spark.createDataFrame(
        [("Ünï/Co, Inc.", "42", "10-K/A", "2024-01-02", "0001-24-9", "http://u", "risk text")],
        "company string, cik string, form string, filingDate string, accessionNumber string, url string, "
        "section string",
    )
    a = sf.artifact_frame(df).first()
    assert a.artifact_name == "2024-01-02__42__ÜnïCo Inc.__10-K-A__0001-24-9.txt"
    parsed = spark.createDataFrame([(a.artifact_name, a.artifact_text)], "n string, t string").select(
        src.parse_artifact(F.col("n"), F.col("t")).alias("p")).first().p
    assert parsed.body == "risk text" and parsed.form == "10-K-A" and parsed.cik == "42"


def test_index_stream_picks_up_late_days(spark, tmp_path):
    from corpusengine.streaming.ingest_stream import index_stream

    base = str(tmp_path / "daily-index")

    def land(day, n):
        path = src.daily_index_path(base, day)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("x\nCIK|Company Name|Form Type|Date Filed|Filename\n--\n")
            for i in range(n):
                f.write(f"{i}|Co {i}|10-K|{day:%Y-%m-%d}|f{i}\n")
            f.write("9|Other|8-K|x|y\n")

    land(dt.date(2024, 12, 20), 2)
    land(dt.date(2024, 12, 23), 3)
    sink, ck = str(tmp_path / "rows"), str(tmp_path / "ck")
    assert index_stream(spark, base, sink, ck).count() == 5
    assert index_stream(spark, base, sink, ck).count() == 5  # re-run adds nothing
    land(dt.date(2024, 12, 19), 4)  # a late day
    out = index_stream(spark, base, sink, ck)
    assert out.count() == 9
    assert {r.file_date for r in out.select("file_date").distinct().collect()} == {
        "2024-12-19", "2024-12-20", "2024-12-23"}


def test_bad_index_name_does_not_stop_the_stream(spark, tmp_path):
    from corpusengine.streaming.ingest_stream import index_stream

    base = tmp_path / "daily-index"
    base.mkdir()
    (base / "master.x.idx").write_text("CIK|Company Name|Form Type|Date Filed|Filename\n1|A|10-K|2024-01-02|f\n")
    (base / "master.20240103.idx").write_text("CIK|Company Name|Form Type|Date Filed|Filename\n2|B|10-K|2024-01-03|f\n")
    out = index_stream(spark, str(base), str(tmp_path / "rows"), str(tmp_path / "ck")).collect()
    assert {(r.file_date, r.error) for r in out} == {(None, "error:bad index name master.x.idx"), ("2024-01-03", None)}


def test_loads_write_only_their_partitions(spark, tmp_path):
    base = str(tmp_path / "pcorpus")
    rows = "chunk_id string, year int, text string, version long"
    first = spark.createDataFrame([("a", 2021, "x", 1), ("b", 2022, "x", 1), ("c", 2023, "x", 1)], rows)
    sc.upsert_corpus(first, base, "1", partition_by=["year"])
    sc.upsert_corpus(spark.createDataFrame([("b", 2022, "y", 2), ("d", 2022, "z", 2)], rows), base, "2", partition_by=["year"])
    assert [sorted(os.listdir(os.path.join(base, f"year={y}"))) for y in (2021, 2022, 2023)] == [
        ["load=1"], ["load=1", "load=2"], ["load=1"]]
    cur = sc.read_corpus(spark, base)
    assert {r.chunk_id: r.text for r in cur.collect()} == {"a": "x", "b": "y", "c": "x", "d": "z"}
    assert sorted(cur.columns) == ["chunk_id", "text", "version", "year"]


def test_late_filings_within_the_watermark_are_accepted_once(spark, tmp_path):
    from corpusengine.streaming.ingest_stream import fresh_filings, late_filings

    schema = "accessionNumber string, filed_at timestamp"
    landing, sink, check = (str(tmp_path / x) for x in ("landing", "sink", "check"))

    def land(*rows):
        df = spark.createDataFrame(rows, "accessionNumber string, day string")
        df.selectExpr("accessionNumber", "to_timestamp(day) AS filed_at").coalesce(1).write.mode("append").parquet(landing)

    def run():
        return sorted(r.accessionNumber for r in fresh_filings(spark, landing, schema, sink, check).collect())

    land(("a", "2024-01-01"), ("b", "2024-01-10"), ("b", "2024-01-10"))
    assert run() == ["a", "b"]
    # c comes late but within seven days of b, d does not; b is seen again.
    land(("c", "2024-01-05"), ("d", "2023-12-20"), ("b", "2024-01-10"))
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]  # nothing new landed: a restart adds nothing
    landed = spark.read.schema(schema).parquet(landing)
    late = late_filings(landed, spark.read.schema(schema).parquet(sink)).collect()
    assert [(r.accessionNumber, r.reason) for r in late] == [("d", "late")]


def test_first_success_across_passes(spark, tmp_path):
    from corpusengine.streaming.ingest_stream import first_success

    schema = "accessionNumber string, attempt string, filed_at timestamp, reason string, extra int"
    landing, sink, check = (str(tmp_path / x) for x in ("landing", "sink", "check"))

    def land(*rows):
        df = spark.createDataFrame(rows, "accessionNumber string, attempt string, day string, reason string")
        df.selectExpr("accessionNumber", "attempt", "to_timestamp(day) AS filed_at", "reason", "1 AS extra").coalesce(1).write.mode(
            "append").parquet(landing)

    def run():
        out = first_success(spark, landing, schema, sink, check, ok="reason IS NULL", keep_days=30)
        return sorted((r.key, r.attempt, str(r.filed_at)[:10], r.failures) for r in out.collect())

    hot = [("hot", f"h{i:05}", "2024-01-02", None if i % 2 else "error") for i in range(3000)]
    land(("a", "1", "2024-01-01", None), ("a", "0", "2024-01-02", None), ("b", "2", "2024-01-03", "error"),
         (None, "3", "2024-01-03", None), ("x", None, "2024-01-03", None), ("y", "4", None, None), *hot)
    first = [("a", "1", "2024-01-01", 0), ("hot", "h00001", "2024-01-02", 1500)]
    assert run() == first
    # b failed before and succeeds now; a and hot are known; old comes too late.
    land(("b", "5", "2024-01-06", None), ("b", "6", "2024-01-05", None), ("a", "7", "2024-01-06", None),
         ("old", "8", "2023-11-01", None), *hot)
    second = sorted([*first, ("b", "6", "2024-01-05", 1)])
    assert run() == second
    assert run() == second  # a restart with nothing new adds nothing
    # Beyond the time limit of the state a key is new again.
    land(("c", "9", "2024-04-01", None))
    assert run() == sorted([*second, ("c", "9", "2024-04-01", 0)])
    land(("a", "10", "2024-04-02", None))
    assert ("a", "10", "2024-04-02", 0) in run()
