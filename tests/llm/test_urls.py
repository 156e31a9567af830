"""op11: globs against a backtracking matcher, host rules against their definition, edges."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import queries_urls
from quern.llm.url_filter import GLOB_RULES, HOST_RULES, GlobRule, HostRule, Judge, allowed_pages, judge_urls
from quern.llm.url_globs import GlobAutomaton, quoted


def brute(glob, text):
    if not glob:
        return not text
    if glob.startswith("**"):
        return any(brute(glob[2:], text[i:]) for i in range(len(text) + 1))
    if glob[0] == "*":
        run = re.match(r"[^/?]*", text).end()
        return any(brute(glob[1:], text[i:]) for i in range(run + 1))
    if not text:
        return False
    if glob[0] == "[":
        end = glob.index("]", 2 + (glob[1] == "!"))
        return re.fullmatch(re.sub(r"^\[!", "[^", glob[: end + 1]).replace("[[", r"[\["), text[0]) is not None and brute(glob[end + 1 :], text[1:])
    return (text[0] not in "/?" if glob[0] == "?" else text[0] == glob[0]) and brute(glob[1:], text[1:])


PARTS = st.sampled_from(["*", "**", "?", "a", "b", "/", "é", "[ab]", "[!a]", "[a-c]", "[?]", "[*]", "."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=7).map("".join), min_size=1, max_size=30), st.lists(st.text("abc/?é.*", max_size=9), max_size=6))
def test_globs_as_backtracking_finds_them(globs, texts):
    found = GlobAutomaton(globs).matches(texts)
    assert found.tolist() == [[brute(glob.replace("***", "**").replace("***", "**"), text) for glob in globs] for text in texts]


def test_globs_over_many_words():
    """Patterns lie across word borders, and lengths of texts differ widely."""
    draw = random.Random(3)
    globs = [quoted("".join(draw.choices("ab*?[", k=draw.randint(1, 150)))) for _ in range(40)]
    texts = ["".join(p[1] if len(p) > 1 else p for p in re.findall(r"\[.\]|.", g)) for g in globs]
    texts += [t[:-1] for t in texts] + ["", "a" * 70000]
    assert GlobAutomaton(globs).matches(texts).tolist() == [[brute_text == t for brute_text in texts[:40]] for t in texts]


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_host_rules_as_defined():
    draw = random.Random(5)
    rules = [HostRule(draw.choice(["allow", "block"]), draw.choice(["org", "a.org", "b.a.org", "com"]), p) for p in ("", "/", "/x", "/x/", "/x/y", "/*", "/[") for _ in range(2)]
    rules = list({r.name: r for r in rules}.values())
    judge = Judge(rules)
    for _ in range(3000):
        host = ".".join(draw.choices(["a", "b", "org", "com", "a.org"], k=draw.randint(1, 3)))
        path = draw.choice(["", "/", "/x", "/x/yz", "/xx", "/*/", "/[", "/.a.org/x", "/z/a.org/x/"])
        query = draw.choice(["", "?", "?a.org/x", "?/x.org/"])
        best = sorted((r for r in rules if fits(r, host, path)), key=lambda r: (-r.weight, r.action != "block", r.name))
        assert next(iter(judge.decide([host + path + query]))) == (best[0] if best else None)


EDGES = [
    (1, None, "", "", None, "allow"),
    (2, "", "", "", None, "allow"),
    (3, "no scheme/at/all", "", "", None, "allow"),
    (4, "http://EXAMPLE.Org/es/Ü?q#f", "example.org", "/es/Ü", "example.org/es/", "block"),
    (4, "http://EXAMPLE.Org/es/Ü?q#f", "example.org", "/es/Ü", "example.org/es/", "block"),
    (5, "https://a.example.org/en/10", "a.example.org", "/en/10", "example.org/en/1", "block"),
    (6, "https://a.example.org/en/20", "a.example.org", "/en/20", "org/", "allow"),
    (7, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (8, "https://example.org", "example.org", "", None, "allow"),
    (9, "https://x.com/fr/a://b.org/de/", "x.com", "/fr/a://b.org/de/", "com/fr/", "allow"),
    (10, "https://x.com#/de/", "x.com", "", None, "allow"),
    (11, "https://x.com?y=/de/", "x.com", "", None, "allow"),
    (12, "https://x.net/a.com/de/", "x.net", "/a.com/de/", None, "allow"),
    (13, "https://com/de/\n1", "com", "/de/\n1", "com/de/", "block"),
    (14, "https://é.com/FR/", "é.com", "/FR/", None, "allow"),
    (15, "https://x.net/login?next=/", "x.net", "/login", None, "block"),
    (16, "https://x.net/a/login/help/1", "x.net", "/a/login/help/1", None, "allow"),
    (17, "https://x.net/loginx", "x.net", "/loginx", None, "allow"),
    (18, "https://x.net/" + "a/" * 30000 + "cart/1", "x.net", "/" + "a/" * 30000 + "cart/1", None, "block"),
    (None, "https://ads.x.net/a", "ads.x.net", "/a", None, "block"),
]


def test_edges(spark):
    """Nulls, texts without ://, repeated rows, very long URLs, and columns that clash with those of the result."""
    pages = spark.createDataFrame([(i, url, "x", "y", "z") for i, url, *_ in EDGES], "page_id long, url string, host string, rule string, d string")
    rows = judge_urls(pages).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(((i, h, p, r, v) for i, _, h, p, r, v in EDGES), key=str)
    assert all((r["rule"] is None) or (r["pattern"] is None) for r in rows)
    assert judge_urls(pages.limit(0)).count() == 0
    kept = allowed_pages(pages)
    assert kept.columns == pages.columns and kept.count() == sum(e[-1] == "allow" for e in EDGES)


def test_sql_at_edges(spark):
    import duckdb

    pages = spark.createDataFrame([(i, url) for i, url, *_ in EDGES], "page_id long, url string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?)", [[i, url] for i, url, *_ in EDGES])
    result = duck.execute(queries_urls.ORACLE)
    names = [d[0] for d in result.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in judge_urls(pages).collect()))) == sorted(map(str, result.fetchall()))


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Judge([GlobRule("maybe", "*")])
    with pytest.raises(ValueError):
        Judge([GlobRule("allow", "[ab")])
    assert next(iter(Judge([]).decide(["x"]))) is None
    assert len({r.name for r in (*HOST_RULES, *GLOB_RULES)}) == len(HOST_RULES) + len(GLOB_RULES)
