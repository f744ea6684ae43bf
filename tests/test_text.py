from pyspark.sql import functions as F

from support import one_col
from corpusengine.functions.filings import cik10, company_or_default, fiscal_year, parse_filing_date
from corpusengine.functions.text import html_to_text, safe_name, strip_ws


def run(spark, fn, values, typ="string"):
    df = one_col(spark, values, typ=typ)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_html_golden(spark):
    cases = {
        "<p>a</p><noscript>hidden</noscript><p>b</p>": "a\nb",
        "<SCRIPT type='x'>var a = '</p>';</SCRIPT><P>kept</P>": "kept",
        "<p>x&nbsp;&nbsp;y</p>": "x y",
        "<p>&amp;lt;tag&amp;gt;</p>": "&lt;tag&gt;",
        "one<!-- c -->two": "one\ntwo",
        "line<br>next": "line\nnext",
        "<style>p{}</style><p>a\t\tb   c</p>\n\n\n\n<p>d</p>": "a b c\n\n\nd".replace("\n\n\n", "\n\n"),
        "&quot;q&quot; &#39;s&#39;": "\"q\" 's'",
        "": "",
    }
    got = run(spark, html_to_text, list(cases))
    assert got == list(cases.values())


def test_html_script_with_embedded_close_tag(spark):
    got = run(spark, html_to_text, ['<script>var t="</p>";x()</script><p>ok</p>'])
    assert got == ["ok"]


def test_safe_name(spark):
    long = "A" * 79 + " B" + "C" * 10
    got = run(spark, safe_name, ["Ünïcode Co., Inc./&", long, "  a/b  ", "x" * 79 + " y"])
    assert got[0] == "Ünïcode Co. Inc."
    assert got[1] == ("A" * 79 + " ")
    assert got[2] == "ab"
    assert got[3] == "x" * 79 + " "


def test_strip_ws(spark):
    assert run(spark, strip_ws, ["\n\t a b \r\n", None]) == ["a b", None]


def test_cik_pad(spark):
    assert run(spark, cik10, ["1", "1234567890", "12345678901"]) == ["0000000001", "1234567890", "12345678901"]


def test_dates_two_formats(spark):
    got = run(spark, parse_filing_date, ["2024-12-23", "20241223", "", None, "2024-13-01", "x"])
    assert got[0] == got[1] and str(got[0]) == "2024-12-23"
    assert got[2:] == [None, None, None, None]


def test_fiscal_year(spark):
    assert run(spark, fiscal_year, ["2023-01-02", "20210101", None, ""]) == [2023, 2021, None, None]


def test_company_default(spark):
    df = spark.createDataFrame([("  ACME ", "1"), ("", "2"), (None, "3"), ("   ", "4")], "n string, c string")
    got = [r[0] for r in df.select(company_or_default(F.col("n"), F.col("c"))).collect()]
    assert got == ["ACME", "CIK 2", "CIK 3", ""]


def test_python_whitespace_parity(spark):
    vals = [" x　", "\x1c y \x85", "​z"]
    assert run(spark, strip_ws, vals) == [v.strip() for v in vals]
    html = ["<p>  word  </p>"]
    assert run(spark, html_to_text, html) == ["word"]


def test_less_than_in_text_is_not_a_tag(spark):
    assert run(spark, html_to_text, ["<p>a < b and c > d</p><!DOCTYPE x><?xml v?>"]) == ["a < b and c > d"]


def test_character_references(spark):
    import html

    cases = ["&copy; 2024 &middot; A&amp;B", "&#8217;s &#x2014; &#169;", "&amp;lt;p&amp;gt;", "&unknown; &#0; &#xD800;",
             "caf&#233; &#128512;"]
    got = run(spark, html_to_text, [f"<p>{c}</p>" for c in cases])
    assert got[0] == "© 2024 · A&B"
    assert got[1] == "’s — ©"
    assert got[2] == "&lt;p&gt;"
    assert got[3] == "&unknown; � �"
    assert got[4] == html.unescape("caf&#233; &#128512;")
