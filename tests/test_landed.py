"""The landed-files data source: pruned reading, committed writing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from corpusengine.config import MASTER_INDEX_HEADER
from corpusengine.operators.filings import parse_master_index
from corpusengine.sources import files as src
from corpusengine.sources import landed

DAYS = [dt.date(2023, 12, 29), dt.date(2024, 1, 2), dt.date(2024, 3, 29), dt.date(2024, 4, 1), dt.date(2024, 12, 31)]


def put(base, name, text):
    path = os.path.join(base, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def day_text(d):
    return f"preamble\n{MASTER_INDEX_HEADER}\n-----\n1|A é {d}|10-K|{d}|edgar/a.txt\nbad|line\n2|B|10-Q|{d}|edgar/b.txt\n"


@pytest.fixture()
def tree(tmp_path):
    base = str(tmp_path / "landing")
    for d in DAYS:
        put(base, landed.index_name(d), day_text(d))
    put(base, "2024/QTR1/readme.txt", "no index")
    put(base, "2024/QTR1/_master.20240103.idx", "hidden")
    put(base, "2024/QTR2/master.20240402.idx/part-0.txt", day_text(dt.date(2024, 4, 2)))
    put(base, "2024/QTR2/master.20240402.idx/_SUCCESS", "")
    return base


def opened(base, *filters, batch=1):
    reader = landed.LandedReader(base, "index", batch)
    left = list(reader.pushFilters(list(filters)))
    return [p for part in reader.partitions() for _, p in part.files], left, reader


@pytest.mark.parametrize("filters, expected", [
    ([EqualTo(("file_date",), "2024-01-02")], ["master.20240102.idx"]),
    ([In(("file_date",), ("2023-12-29", "2024-04-01", "1999-01-01"))], ["master.20231229.idx", "master.20240401.idx"]),
    ([GreaterThan(("file_date",), "2024-01-02"), LessThanOrEqual(("file_date",), "2024-04-01")],
     ["master.20240329.idx", "master.20240401.idx"]),
    ([EqualTo(("file_date",), "2024-01-03")], []),
])
def test_only_the_asked_days_are_opened(tree, filters, expected):
    paths, left, _ = opened(tree, *filters)
    assert [os.path.basename(p) for p in paths] == expected and left == []


def test_other_quarters_are_not_listed(tree, monkeypatch):
    seen = []
    selector = landed.fs.FileSelector
    monkeypatch.setattr(landed.fs, "FileSelector", lambda path, **k: seen.append(path) or selector(path, **k))
    opened(tree, EqualTo(("file_date",), "2024-01-02"))
    assert [os.path.relpath(p, tree) for p in seen] == [".", "2024", "2024/QTR1"]


def test_filters_it_cannot_answer_are_left_to_spark(tree):
    other = [EqualTo(("name",), "x"), StringContains(("file_date",), "2024"), EqualTo(("file_date",), None)]
    paths, left, _ = opened(tree, *other)
    assert left == other and len(paths) == 6


def test_small_files_share_a_task(tree):
    assert len(opened(tree, batch=1)[2].partitions()) == 6
    assert len(opened(tree, batch=1 << 20)[2].partitions()) == 1


def test_one_day_equals_the_file_reader(spark, tree):
    for d in (*DAYS, dt.date(2024, 4, 2), dt.date(2024, 5, 1)):
        day = landed.read_landed(spark, tree).where(F.col("file_date") == d.isoformat()).select("file_date", "text")
        got = parse_master_index(day)
        want = src.read_daily_index(spark, tree, d)
        assert sorted(map(tuple, got.where("form = '10-K' OR form = '10-Q'").collect())) == sorted(map(tuple, want.collect()))


def test_filter_reaches_the_source_through_the_parser(spark, tree):
    """Days that are not asked for are not opened, so a broken one does no harm."""
    os.remove(f"{tree}/2023/QTR4/master.20231229.idx")
    os.symlink("/nowhere/at/all", f"{tree}/2023/QTR4/master.20231229.idx")
    rows = parse_master_index(landed.read_landed(spark, tree)).where("file_date >= '2024-01-01' AND form = '10-K'")
    assert rows.count() == 5
    names = landed.read_landed(spark, tree).where("file_date >= '2024-04-01' OR name LIKE '%QTR1%'")
    assert names.count() == 5


def test_missing_folder_and_odd_bytes(spark, tmp_path):
    assert landed.read_landed(spark, str(tmp_path / "none")).count() == 0
    put(str(tmp_path), "2024/QTR1/master.20240102.idx", b"caf\xe9")
    put(str(tmp_path), "2024/QTR1/master.20240104.idx", b"")
    assert [r.text for r in landed.read_landed(spark, str(tmp_path)).orderBy("file_date").collect()] == ["caf�", ""]


def artifacts(spark, n, text="body"):
    return spark.range(n, numPartitions=3).select(
        F.format_string("2024-01-%02d__%d__Co__10-K__acc-%d.txt", F.col("id") % 28 + 1, "id", "id").alias("name"),
        F.when(F.col("id") != 5, F.concat(F.lit(text), F.col("id").cast("string"))).alias("text"), F.lit(1).alias("extra"))


def test_artifacts_round_trip(spark, tmp_path):
    base = str(tmp_path / "artifacts")
    landed.write_landed(artifacts(spark, 40), base, "a")
    landed.write_landed(artifacts(spark, 30, "new"), base, "a")  # the load replaces itself
    landed.write_landed(artifacts(spark, 0), base, "empty")
    got = {os.path.basename(r.name): r.text for r in landed.read_landed(spark, base, "artifact").collect()}
    assert got == {r.name: r.text or "" for r in artifacts(spark, 30, "new").collect()}
    # Spark's own text reader passes over the one empty file.
    assert src.read_artifacts(spark, f"{base}/load=a/part-*").count() == 29
    day = landed.read_landed(spark, base, "artifact").where("file_date = '2024-01-02'")
    assert sorted(r.text for r in day.collect()) == ["new1", "new29"]
    landed.write_landed(artifacts(spark, 3), base, "b", "overwrite")
    assert landed.read_landed(spark, base, "artifact").count() == 3
    assert not [n for n in os.listdir(base) if n.startswith("_")]


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    base = str(tmp_path / "artifacts")
    landed.write_landed(artifacts(spark, 6), base, "a")
    bad = artifacts(spark, 40).withColumn("name", F.when(F.col("text") == "body39", F.lit("../out.txt")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a relative file name"):
        landed.write_landed(bad, base, "a")
    assert landed.read_landed(spark, base, "artifact").count() == 6
    assert sorted(os.listdir(base)) == ["load=a"] and not os.path.exists(tmp_path / "out.txt")


@pytest.mark.parametrize("name", [None, "", "/etc/x", "a/../b", "a//b", "_hidden", ".x", "a/"])
def test_names_stay_inside(name):
    with pytest.raises(ValueError):
        landed.checked_name(name)
