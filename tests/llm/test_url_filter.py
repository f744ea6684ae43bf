"""The automaton against regular expressions, the rules against plain Python."""

import random
import re

from corpusengine.llm import url_filter as uf


def as_regex(glob):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": b"[\x00-\xff]*".decode("latin1"), "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part.encode().decode("latin1"))
    return re.compile(out, re.S)


def test_automaton_like_regular_expressions():
    rng = random.Random(5)
    globs = ["", "*", "**", "?", "a", "a*", "*a", "a?b", "**/x", "*.com/**", "a**b*c", "??*", "é*", "x" * 130, "*" + "ab" * 70 + "**"]
    globs += ["".join(rng.choices(["a", "b", "/", "*", "**", "?", "."], k=rng.randint(1, 9))) for _ in range(120)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["", "a", "/", "ab" * 80, "x" * 130, "éa", "a/b/c", "q.com/x"]
    texts += ["".join(rng.choices("ab/.é", k=rng.randint(0, 12))) for _ in range(300)]
    hit = uf.WildcardAutomaton([uf.glob_symbols(g) for g in globs]).match([t.encode() for t in texts])
    for j, g in enumerate(globs):
        rx = as_regex(g)
        assert [bool(x) for x in hit[:, j]] == [bool(rx.fullmatch(t.encode().decode("latin1"))) for t in texts], g


def test_no_texts():
    assert uf.WildcardAutomaton([uf.glob_symbols("a*")]).match([]).shape == (0, 1)


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in uf.BASE_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.name) > len(best.name):
                best = r
    blocked = any(as_regex(g).fullmatch((host + path).encode().decode("latin1")) for g in uf.BLOCK_GLOBS)
    return host, path, best.name if best else None, best.verdict if best else "block" if blocked else "allow"


def test_rules(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "notexample.com", "EXAMPLE.com", "Ünï.net", "net", "x.net",
             "spam-farm.example.org", "cheap-pills.org", "", "u@example.com", "example.com:80", "x.example.com.", "a.xxx"]
    paths = ["", "/", "/en", "/en/", "/en/5", "/EN/5", "/es/x", "/fr/", "/x/example.com/en/", "/a/wp-login.php", "/f.exe", "/cgi-bin/a"]
    urls = [None, "", "://", "http://", "no scheme/com/", "mailto:x@com/", "a://b://c.net/es/", "http://\nx.com/en/", "http://" + "a" * 5000 + ".com/en/"]
    urls += [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in rng.sample(["", "?q=/en/", "#/es/", "?x#y"], 2)]
    rows = list(enumerate(urls)) + [(None, "http://example.com/en/"), (1, urls[1])]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, host string, rule string").repartition(3)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in rows), key=str)


def test_empty_table(spark):
    assert uf.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
