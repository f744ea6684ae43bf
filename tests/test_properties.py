"""Property tests: Spark operators against direct Python statements of the
rules, on random batches with deliberately hot keys."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusengine.config import MASTER_INDEX_HEADER
from corpusengine.operators import filings as fo

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

batch = st.lists(
    st.tuples(st.sampled_from(["A", "B", "C", "D"]), st.booleans()), min_size=1, max_size=30
)


@SETTINGS
@given(batch)
def test_first_occurrence_matches_sequential_rules(spark, rows):
    # An accession's outcome is a property of its document, so every copy
    # would get the first copy's outcome; processing runs in input order with
    # a seen set that grows only when a filing succeeds.
    first_ok = {}
    for acc, ok in rows:
        first_ok.setdefault(acc, ok)
    data = [(i, acc, None if first_ok[acc] else f"{acc}:no_item_1a") for i, (acc, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "input_pos long, accessionNumber string, r string")
    got = [r.reason for r in fo.first_occurrence_status(df, F.col("r")).orderBy("input_pos").collect()]
    want = []
    state = set()
    for acc, _ in rows:
        if acc in state:
            want.append(f"already_ingested:{acc}")
        elif first_ok[acc]:
            state.add(acc)
            want.append(None)
        else:
            want.append(f"{acc}:no_item_1a")
    assert got == want


filings = st.lists(
    st.tuples(st.sampled_from(["1", "2"]), st.sampled_from(["10-K", "10-K/A", "10-Q"]),
              st.sampled_from(["2024-01-01", "2023-06-30", "2022-01-01", "20240101"])),
    min_size=0, max_size=25,
)


@SETTINGS
@given(filings)
def test_top_n_matches_stable_sort(spark, rows):
    data = [(cik, pos, form, f"a{pos}", "d", date) for pos, (cik, form, date) in enumerate(rows)]
    df = spark.createDataFrame(data, "cik string, pos long, form string, accessionNumber string, "
                                     "primaryDocument string, filingDate string")
    got = {}
    for r in fo.top_n_filings(df, 3).orderBy("cik", "rank").collect():
        got.setdefault(r.cik, []).append(r.accessionNumber)
    want = {}
    for cik in sorted({c for c, _, _ in rows}):
        mine = [(d, f"a{p}") for p, (c, f, d) in enumerate(rows) if c == cik and f in ("10-K", "10-K/A")]
        mine.sort(key=lambda x: x[0], reverse=True)  # stable
        if mine:
            want[cik] = [a for _, a in mine[:3]]
    assert got == want


def _word():
    return st.text(alphabet="ab1", min_size=0, max_size=3)


def _padded(fields):
    """A good line with padded fields, and the row it stands for."""
    return st.lists(st.sampled_from(["", " ", "  "]), min_size=10, max_size=10).map(
        lambda pads: ("|".join(pads[2 * i] + f + pads[2 * i + 1] for i, f in enumerate(fields)), tuple(fields)))


good_line = st.tuples(*[_word()] * 5).flatmap(_padded)
bad_line = st.one_of(st.just("-----"), st.just(""), st.lists(_word(), min_size=2, max_size=4).map("|".join),
                     st.lists(_word(), min_size=6, max_size=7).map("|".join)).map(lambda x: (x, None))
body = st.lists(st.one_of(good_line, bad_line), max_size=12)


@SETTINGS
@given(body, body, st.booleans())
def test_master_index_rows_come_after_the_header(spark, before, after, has_header):
    """Lines and expected rows are generated together: only good lines behind a
    header are rows."""
    lines = [x for x, _ in before] + ["   " + MASTER_INDEX_HEADER] * has_header + [x for x, _ in after]
    df = spark.createDataFrame([("f", "\n".join(lines))], "file_date string, text string")
    got = [(r.cik, r.company, r.form, r.date_filed, r.filename)
           for r in fo.parse_master_index(df).orderBy("line_no").collect()]
    assert got == ([row for _, row in after if row is not None] if has_header else [])
