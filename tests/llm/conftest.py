import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with the awkward cases: null and empty texts, null ids, repeats."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards boil strange soup in old iron pots tonight".split()
    base = " ".join(words)
    near = " ".join([*words[:-1], "today"])
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base.upper(), "en", "b", len(base)),
        (3, near, "en", "a", len(near)),
        (4, None, "en", "a", None),
        (5, "", "de", None, 0),
        (6, " \n\t ", None, "b", 4),
        (7, "été ÉTÉ über 日本語 " + base, "fr", "c", 30),
        (8, "one two", "en", "c", 7),
        (8, "one two", "en", "c", 7),
        (None, base, "en", "a", len(base)),
        (9, ("alpha beta gamma " * 4000).strip(), "en", "a", 67999),
    ]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).withColumnRenamed("n_chars", "n_chars").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
