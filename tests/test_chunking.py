from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from support import SF01
from corpusengine.functions.chunking import chunk_fixed, chunk_id, chunk_recursive, recursive_spans
from corpusengine.sources.tables import read_table

texts = st.text(alphabet=st.sampled_from(list("ab \n.é")), min_size=0, max_size=400)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(5, 60), st.integers(0, 20))
def test_recursive_spans_contract(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = recursive_spans(text, size, overlap)
    for s, e in spans:
        assert 0 <= s < e <= len(text)
        assert e - s <= size
        assert not text[s].isspace() and not text[e - 1].isspace()
    # chunks advance and never overlap more than `overlap`
    for (s1, e1), (s2, e2) in zip(spans, spans[1:]):
        assert s2 >= s1 and e2 >= e1
        assert max(0, e1 - s2) <= overlap
    # coverage: every non-space character lies in some chunk
    covered = [False] * len(text)
    for s, e in spans:
        for i in range(s, e):
            covered[i] = True
    assert all(covered[i] or text[i].isspace() for i in range(len(text)))


def fixed_py(text, size, overlap):
    step = size - overlap
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out, i = [], 0
    while True:
        out.append(text[i:i + size])
        if i + size >= len(text):
            return out
        i += step


def test_fixed_matches_python_on_documents(spark):
    docs = read_table(spark, SF01, "documents", "doc_id", "text")
    got = {}
    for r in chunk_fixed(docs, "text", 1500, 200).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_ix, r.chunk))
    for r in docs.collect():
        exp = fixed_py(r.text, 1500, 200)
        assert [c for _, c in sorted(got.get(r.doc_id, []))] == exp


def test_fixed_overlap_property(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 7)], "id long, text string")
    rows = sorted(chunk_fixed(df, "text", 20, 5).collect(), key=lambda r: r.chunk_ix)
    for a, b in zip(rows, rows[1:]):
        assert len(a.chunk) == 20 and a.chunk[-5:] == b.chunk[:5]


def test_recursive_udf_offsets_cover_documents(spark):
    docs = read_table(spark, SF01, "documents", "doc_id", "text")
    ch = chunk_recursive(docs, "text", 1000, 200, with_offsets=True)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in ch.collect():
        assert text[r.doc_id][r.chunk_start:r.chunk_end] == r.chunk
        assert len(r.chunk) <= 1000


def test_chunk_ids_stable_and_unique(spark):
    df = spark.createDataFrame([("320193", "0000320193-24-000123", i) for i in range(5)], "c string, a string, i int")
    ids = [r[0] for r in df.select(chunk_id(F.col("c"), F.col("a"), F.col("i"))).collect()]
    import hashlib

    assert ids[2] == hashlib.sha1(b"320193__0000320193-24-000123__2").hexdigest()
    assert len(set(ids)) == 5


def test_empty_and_null_text_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id long, text string")
    assert chunk_fixed(df, "text", 10, 2).count() == 0
    assert chunk_recursive(df, "text", 10, 2).count() == 0


def test_length_function_measures_the_chunks():
    words = lambda t: len(t.split())
    text = " ".join(f"w{i}" for i in range(50))
    spans = recursive_spans(text, 10, 2, length=words)
    assert all(words(text[s:e]) <= 10 for s, e in spans) and len(spans) >= 5
    assert spans != recursive_spans(text, 10, 2)
