from pyspark.sql import functions as F

from support import one_col
from corpusengine.functions.sections import extract_section

L = "x" * 50


def sections(spark, texts, min_chars=40):
    df = one_col(spark, texts)
    return [r[0] for r in df.select(extract_section(F.col("x"), min_chars=min_chars)).collect()]


def test_golden_cases(spark):
    cases = [
        (f"Item 1A. Risk Factors\nItem 1B. None\nItem 1A. Risk Factors\n{L}\n12\nrest\nItem 2. Props",
         f"Item 1A. Risk Factors\n{L}\nrest"),
        (f"Item 1. Business\n{L}", None),
        (f"ITEM\n1A\n.\nRisk Factors\n{L}\nitem\n1c\nz", f"ITEM\n1A\n.\nRisk Factors\n{L}"),
        (f"Item 1A— {L}", f"Item 1A— {L}"),
        ("Item 1A\nab\nItem 3", None),
        (f"Item 1A.\nTable of Contents\n{L}\nItem 1A (continued)\n{L}\nItem 7", f"Item 1A (continued)\n{L}"),
        (f"Item 1A {L}\nItem 20 zz", f"Item 1A {L}"),
        (f"see Item 1A {L}", None),
    ]
    got = sections(spark, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_nbsp_heading(spark):
    got = sections(spark, [f"Item 1A. Risk Factors\n{L}"])
    assert got == [f"Item 1A. Risk Factors\n{L}"]


def test_equal_length_first_wins(spark):
    a, b = "a" * 45, "b" * 45
    got = sections(spark, [f"Item 1A {a}\nItem 2\nItem 1A {b}\nItem 3"])
    assert got == [f"Item 1A {a}"]


def test_length_checked_before_page_numbers(spark):
    # 40 characters only with the page-number line; kept, then cleaned.
    body = "Item 1A " + "y" * 28 + "\n123"
    assert len(body) >= 40
    assert sections(spark, [body]) == ["Item 1A " + "y" * 28]


def test_null_text(spark):
    assert sections(spark, [None]) == [None]


def test_unicode_page_numbers_and_line_breaks(spark):
    # Arabic-Indic digits are digits for the original rule; U+2028 splits lines
    body = f"Item 1A {L}\n١٢\nend more\nItem 2"
    got = sections(spark, [body])
    assert got == [f"Item 1A {L}\nend\nmore"]
