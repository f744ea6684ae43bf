"""The pipeline end to end, on a table with every planted case."""

import random

import pytest

import corpus_pipeline
from corpusengine.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "st", "or"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    items = [(i, prose(30)) for i in range(5)]
    docs = [(i, prose(120) + f" n={i * 7919 % 1000003}") for i in range(200)]
    docs += [(300, docs[0][1]), (301, docs[0][1].upper().lower()), (302, docs[1][1])]
    docs += [(400 + i, prose(100) + " " + items[i][1]) for i in range(5)]
    docs += [(500 + i, prose(80) + f" password=abcdef0123456789{i} " + prose(10)) for i in range(5)]
    docs += [(600 + i, " ".join(w + "%$" for w in prose(100).upper().split())) for i in range(5)]
    docs += [(700, None), (701, "")]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in docs]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(600, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(COLUMNS)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality_classifier"] == set(range(200)) | {300, 301, 302, 700, 701} | set(range(400, 405)) | set(range(500, 505))
    assert ids["simhash_near_dedup"] == ids["quality_classifier"] - {300, 301, 302, 701}
    assert ids["benchmark_decontamination"] == ids["simhash_near_dedup"] - set(range(400, 405))
    assert ids["secret_scans"] == ids["benchmark_decontamination"] == ids["best_fit_packing"]
    redacted = {r.doc_id: r for r in seen["secret_scans"].filter("doc_id BETWEEN 500 AND 504").collect()}
    assert all("password" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text) for r in redacted.values())
    fps = [simhash.simhash64(r.text) for r in seen["simhash_near_dedup"].collect()]
    assert len(fps) == len(set(fps))


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.select("doc_id").distinct().count() == 200 + 5 + 1


# Every column name that an operator makes for itself.
INTERNAL = ["_lp", "_chars", "_ppl", "_limit", "_rep", "_rep_limit", "_keep", "_kn_id", "_kn_bits", "_kn_band", "_kn_l", "_kn_uid",
            "g", "ctx", "_simhash_fp", "_simhash_id", "_simhash_key", "_simhash_n", "fp", "root", "_own_id", "_bad_id", "_id", "_h1",
            "_uid", "_found", "_spans", "_owner", "_repo", "found", "start", "w", "token", "in0", "in3"]


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_keep_clashing_columns(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40 OR doc_id BETWEEN 500 AND 504")
    if not rows:
        docs = docs.limit(0)
    extra = docs.selectExpr("*", *[f"'{c} of ' || doc_id AS `{c}`" for c in INTERNAL])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, folder)
        assert out.columns == extra.columns
        kept = out.collect()
        assert all(r[c] == f"{c} of {r.doc_id}" for r in kept for c in INTERNAL), name
        assert len(kept) >= 40 * rows
