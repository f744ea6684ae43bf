import duckdb
import pytest

import __spark_entry__ as entry
from support import SF001
from corpusengine.sources.tables import TABLES


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "chunk_ix", "chunk_id", "chunk"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["html_to_text", "section_extract", "master_index_parse", "daily_match_first", "ingest_filings",
        "knn_exact", "rag_prompt", "upsert_replace", "history_append", "artifact_parse"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches_on_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = entry.queries()[name](spark, SF001)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)

    def norm(rows, names):
        idx = [names.index(c) for c in order]
        def cell(v):
            return "NULL" if v is None else repr(round(v, 6) if isinstance(v, float) else v)

        return sorted(tuple(cell(r[i]) for i in idx) for r in rows)

    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(res.fetchall(), cols)
