"""Plan properties that matter at scale (checked on the physical plan)."""

from pyspark.sql import functions as F

from support import SF01
from corpusengine.operators import retrieval as rt
from corpusengine.plans import ingest as ing
from corpusengine.plans import q_filings as qf
from corpusengine.plans import q_ingest as qi
from corpusengine.plans.registry import CFG
from corpusengine.sources.tables import read_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_plan_has_no_pairs_and_one_exchange(spark):
    e = read_table(spark, SF01, "embeddings", "vec_id", "embedding", spread=False)
    qs = e.limit(3).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    p = plan_of(rt.knn(e, qs, 5, id_col="vec_id", vec_col="embedding"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert p.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in p and "MapInArrow" in p


def test_knn_scan_reads_only_needed_columns(spark):
    e = read_table(spark, SF01, "embeddings", spread=False)
    qs = e.limit(2).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    p = plan_of(rt.knn(e, qs, 5, id_col="vec_id", vec_col="embedding"))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p


def test_documents_are_not_broadcast_in_ingest(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # below the documents, above the key lists
    try:
        p = plan_of(qi.doc_status(spark, SF01))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    for part in p.split("BroadcastExchange")[1:]:
        assert not any("html" in ln for ln in part.split("\n")[:6])


def test_shuffle_joins_give_the_same_status(spark):
    filings, raw = qi.doc_batch(spark, SF01)
    seen = qf.labels_manifest(spark, SF01)
    cols = ("input_pos", "reason", "chunks")
    a = ing.ingest_filings(filings, raw, seen, CFG).select(*cols).collect()
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = ing.ingest_filings(filings, raw, seen, CFG).select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_only_the_chosen_document_counts(spark):
    html = "<p>Item 1A. Risk Factors</p>" + "<p>risk words here</p>" * 100 + "<p>Item 1B. x</p>"
    filings = spark.createDataFrame(
        [(1, "42", "A1", "main.htm", "2024-01-02", "10-K", "Co"), (2, "42", None, "m.htm", "2024-01-02", "10-K", "Co"),
         (3, "42", "A3", "main.htm", "soon", "10-K", "Co"), (4, "42", "A1", "main.htm", "20240102", None, "Co")],
        "input_pos int, cik string, accessionNumber string, primaryDocument string, filingDate string, form string, company string")
    raw = spark.createDataFrame([("A1", "main.htm", html), ("A1", "ex.htm", "<p>Exhibit</p>")],
                                "accessionNumber string, primary string, html string")
    none = spark.createDataFrame([], "accessionNumber string")
    out = {r.input_pos: (r.reason, r.chunks) for r in ing.ingest_filings(filings, raw, none, CFG).collect()}
    assert out == {1: (None, 2), 2: (ing.MISSING_ACCESSION, None), 3: (ing.BAD_DATE, None), 4: ("already_ingested:A1", None)}


def test_small_scans_are_spread_and_large_ones_are_not(spark, monkeypatch):
    from corpusengine.sources import tables

    assert "Exchange RoundRobin" in plan_of(read_table(spark, SF01, "documents", "doc_id", "text"))
    assert "Exchange" not in plan_of(read_table(spark, SF01, "documents", "doc_id"))
    monkeypatch.setattr(tables, "MAX_SPREAD_BYTES", 10)
    assert "Exchange" not in plan_of(read_table(spark, SF01, "documents", "doc_id", "text"))


def test_history_ordered_limit(spark):
    c = read_table(spark, SF01, "customer", "c_custkey")
    ciks = c.select(F.col("c_custkey").cast("string").alias("cik"), F.col("c_custkey").alias("pos"))
    filings, none = ing.history_filings(ciks, qf.flat_submissions(spark, SF01), qf.submission_names(spark, SF01),
                                        limit=7)
    got = {r.cik for r in filings.select("cik").union(none.select("cik")).collect()}
    assert got <= {str(i) for i in range(7)} and len(got) == 7


def test_top_n_keeps_partial_limit(spark):
    p = plan_of(qf.q_top_n_per_company(spark, SF01))
    assert "WindowGroupLimit" in p


def test_hot_key_operators_aggregate_before_shuffle(spark):
    # a third of the rows share one accession
    rows = [(i, "HOT" if i % 3 == 0 else f"a{i}", None) for i in range(300)]
    df = spark.createDataFrame(rows, "input_pos long, accessionNumber string, r string")
    from corpusengine.operators.filings import first_occurrence_status

    p = plan_of(first_occurrence_status(df, F.col("r")))
    # a partial aggregate runs before the exchange on the key
    assert "partial_min" in p and "partial_min_by" in p
    out = first_occurrence_status(df, F.col("r")).where("accessionNumber = 'HOT'")
    assert out.where("reason IS NULL").count() == 1 and out.count() == 100


def test_no_query_plans_a_cross_product(spark):
    from support import SF001
    from corpusengine.plans.catalog import QUERIES

    for name, fn in sorted(QUERIES.items()):
        p = plan_of(fn(spark, SF001))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


def test_pages_are_fetched_for_wanted_filings_alone(spark, tmp_path):
    """Order pages: the list of wanted filings meets the texts, each text once,
    and no page is made for an order that nobody asked for."""
    import datetime as dt

    from corpusengine.plans import q_ingest as qi

    day = dt.datetime(2021, 5, 6)
    orders = [(k, 7, day) for k in range(60)] + [(31, 7, day), (None, 7, day)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(
        f"{tmp_path}/orders.parquet")
    docs = [(1, "alpha"), (2, "beta"), (2, "gamma"), (None, "delta"), (9, "epsilon")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = spark.createDataFrame([(f"{7:010d}-21-{k:06d}", k) for k in (15, 31, 59, 200)], "accessionNumber string, n int")
    pages = qi.order_pages(spark, str(tmp_path))(wanted)
    got = sorted((r.n, r.accessionNumber[-2:], "beta" in r.html, "alpha" in r.html) for r in pages.collect())
    assert pages.columns == ["accessionNumber", "n", "html"]
    assert got == [(15, "15", False, True)] + [(31, "31", False, False)] * 2 + [(31, "31", True, False)] * 2
    # A short list is broadcast: no text is shuffled.
    assert "hashpartitioning(doc_id" not in pages._jdf.queryExecution().executedPlan().toString()


def test_a_fetching_function_gives_the_same_status(spark):
    page = "<html><body><p>Item 1A. Risk Factors</p><p>" + "We may fail. " * 400 + "</p><p>Item 1B. Other</p></body></html>"
    filings = spark.createDataFrame(
        [(i, "7", a, "d.htm", "2021-05-06", "10-K", "C") for i, a in enumerate(["a", "b", "a", "seen", "gone", None])],
        "input_pos int, cik string, accessionNumber string, primaryDocument string, filingDate string, form string, company string")
    raw = spark.createDataFrame([("a", page), ("b", "<p>nothing</p>"), ("seen", page)], "accessionNumber string, html string")
    seen = spark.createDataFrame([("seen",)], "accessionNumber string")
    asked = []

    def fetch(wanted):
        asked.extend(r.accessionNumber for r in wanted.collect())
        return wanted.join(raw, "accessionNumber")

    a, b = (sorted(map(str, ing.ingest_filings(filings, x, seen, CFG).collect())) for x in (raw, fetch))
    assert a == b and len(a) == 6 and sorted(asked) == ["a", "b", "gone"]
