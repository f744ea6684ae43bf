"""SimHash groups against a quadratic brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusengine.llm import simhash
from corpusengine.llm.common import Scratch


def brute_fingerprint(text, shingle=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    cut = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    if words and not cut:
        cut = [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(c, 42) for c in cut]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits):
    """{fingerprint: smallest fingerprint of its component}."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints(docs_rows):
    for _, text, *_ in docs_rows:
        assert simhash.simhash64(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, bits):
    rng = random.Random(bits)
    centres = [rng.getrandbits(63) for _ in range(25)]
    fps = set(centres)
    for c in centres:
        for _ in range(12):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))))
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = simhash.hamming_links(df, scratch, bits, 5)
    assert all(bin(r.u ^ r.v).count("1") <= max(bits, 0) for r in links.collect())
    roots = {r.node: r.root for r in simhash.connected_components(links, scratch).collect()}
    assert {f: roots.get(f, f) for f in fps} == brute_groups(fps, bits)


def test_dense_ball_stays_bounded(spark):
    """All 65 + 2,016 values within two bits: one component, no group over 65."""
    centre = 0x0F0F_1234_5678_9ABC
    fps = {centre} | {centre ^ (1 << i) for i in range(63)} | {centre ^ (1 << i) ^ (1 << j) for i in range(63) for j in range(i)}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    scratch = Scratch(spark, "test")
    roots = simhash.connected_components(simhash.hamming_links(df, scratch), scratch)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps)


def test_chain_is_one_component(spark):
    """A path of links is followed to its end (pointer jumping)."""
    path = [0]
    for b in range(0, 62, 2):
        path.append(path[-1] ^ (3 << b))
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(f,) for f in path], "fp bigint")
    roots = simhash.connected_components(simhash.hamming_links(df, scratch), scratch)
    assert {r.root for r in roots.collect()} == {0} and roots.count() == len(path)


def test_rows_nulls_and_repeats(docs, docs_rows):
    out = simhash.near_duplicate_groups(docs).collect()
    assert len(out) == len(docs_rows)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    same = brute_groups([brute_fingerprint(t) for _, t, *_ in docs_rows], 2)
    for i, text, *_ in docs_rows:
        f = brute_fingerprint(text)
        ids = [j for j, t, *_ in docs_rows if j is not None and same[brute_fingerprint(t)] == same[f]]
        assert got[i, f"{f:016x}"] == min(ids)
    # Null, empty and blank texts share fingerprint zero.
    assert {got[i, "0" * 16] for i in (4, 5, 6)} == {4}


def test_empty_table(empty_docs):
    assert simhash.near_duplicate_groups(empty_docs).count() == 0
    assert simhash.drop_near_duplicates(empty_docs).count() == 0


def test_drop_keeps_one_row_of_each_group(docs, docs_rows):
    extra = docs.withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    kept = simhash.drop_near_duplicates(extra)
    assert kept.columns == extra.columns
    same = brute_groups([brute_fingerprint(t) for _, t, *_ in docs_rows], 2)
    groups = {same[brute_fingerprint(t)] for _, t, *_ in docs_rows}
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert {same[brute_fingerprint(r.text)] for r in rows} == groups
    assert {r.doc_id for r in rows} >= {1, 4, 8} and None not in {r.doc_id for r in rows}


def test_drop_without_any_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z w q")], "doc_id bigint, text string")
    assert simhash.drop_near_duplicates(df).count() == 2


def test_what_grows_with_the_corpus_is_not_broadcast(spark, docs):
    """Spark takes an exploded scan for as small as its file and would broadcast it."""
    rows = spark.range(500).select(F.col("id").alias("fp"), F.explode(F.array([F.lit(s) for s in range(5)])).alias("s"))
    shared = simhash._shared(rows.withColumn("key", F.col("fp") % 300))
    assert "Broadcast" not in shared._jdf.queryExecution().executedPlan().toString()
    assert {(r.s, r.fp) for r in shared.collect()} == {(s, f) for s in range(5) for f in range(500) if f < 200 or f >= 300}
    kept = simhash.drop_near_duplicates(docs)
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
