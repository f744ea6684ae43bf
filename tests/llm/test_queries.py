"""Registered queries against their SQL, and what the others must hold."""

import duckdb
import pytest

from corpusengine.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    names = [c[0] for c in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df) == sorted(repr(tuple(r[i] for i in order)) for r in res.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, columns", [
    ("op1_simhash", ["doc_id", "fingerprint", "component_id"]),
    ("op3_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    ("op5_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op12_jaccard_join", ["doc_id", "n_shingles", "component_id"]),
    ("op7_hmm_lm", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
])
def test_columns_of_the_others(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == columns
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
