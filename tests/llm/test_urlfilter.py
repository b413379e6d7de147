import random
from urllib.parse import urldefrag, urljoin

import duckdb

from jobweave.llm import queries
from jobweave.llm import urlfilter as U

RULES = queries.URL_RULES


def verdicts(spark, pages, rules=RULES, redirects=None):
    frame = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, verdict string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "source string, target string")
    return sorted(tuple(r) for r in U.judged(frame, rules, redirects).collect())


def test_rules(spark):
    pages = ["http://WWW.Example.com/en/1?x=/fr/", "http://a.example.com/en/", "http://example.com/de", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://x.org/es/", "http://x.com", "http://x.com#a", None, "no scheme", "http://", ""]
    got = [(h, p, r, v) for _, h, p, r, v in verdicts(spark, [(u, None) for u in pages])]
    assert got == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/de", "com/", "allow"), ("x.net", "/es/1", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"), ("xnet", "/fr/", None, "allow"), ("x.org", "/es/", None, "allow"), ("x.com", "", None, "allow"), ("x.com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]


def pages():
    link = lambda u: f'<head><LINK data-x="1" rel="canonical" href="{u}"></head>'
    return [
        ("http://a.org/1", link("http://b.org/1")),
        ("http://b.org/1#top", '<meta http-equiv="refresh" content="0; url=http://spam.net/es/9">'),
        ("http://c.org/1", link("http://ok.com/1")),
        ("http://c.org/2", '<meta http-equiv=refresh content="1;URL=http://c.org/1"><link rel=canonical href=http://spam.net/es/9>'),
        ("http://spam.net/es/9", None),
        ("http://ok.com/1", link("http://spam.net/fr/1")),
        ("http://d.org/x/1", link("../y")),
        ("http://e.org/1", "<a href='http://spam.net/es/9'>no edge</a>"),
        ("http://e.org/1", None),
    ]


def test_aliases(spark):
    got = {(i, v) for i, *_, v in verdicts(spark, pages())}
    # All but d and e meet at spam.net/es/9 and ok.com/1: an explicit allow, so undecided members are allowed; blocked ones stay.
    assert got == {(0, "allow"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow")}
    only = [p for p in pages() if "ok.com" not in p[0] + (p[1] or "")]
    assert [v for *_, v in verdicts(spark, only)][:4] == ["block", "block", "block", "block"]


def test_redirect_table(spark):
    got = verdicts(spark, [("http://a.org/1", None), ("http://b.org/", None)], redirects=[("http://A.org/1", "http://x.net/es/"), (None, "http://b.org/"), ("http://b.org/", "http://b.org/#z")])
    assert [v for *_, v in got] == ["block", "allow"]


def test_relative_links(spark):
    got = verdicts(spark, [("http://q.org/a/b", '<link rel="canonical" href="/bad/1">'), ("http://q.org/a/c?x", '<link rel="canonical" href="d?y=1&amp;z=2">')], rules=[("block", "q.org", "/bad/"), ("block", "q.org", "/a/d")])
    assert [v for *_, v in got] == ["block", "block"]


def test_sql(spark):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages()) if "#" not in u and "../" not in (h or "")], "page_id long, url string, html string")
    connection = duckdb.connect()
    connection.register("pages", frame.toPandas())
    expected = sorted(tuple(r) for r in connection.sql(queries.ORACLE_SQL["op8_urlfilter"]).fetchall())
    assert sorted(tuple(r) for r in U.judged(frame, RULES).collect()) == expected


def test_empty(spark):
    assert verdicts(spark, []) == []


def named_edges(spark, pages):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return sorted(tuple(r) for r in U.edges(frame).collect())


def test_references_as_urljoin_has_them(spark):
    hrefs = ["../y", "./y", "y/../z?q=1", "../../../up", "/a/./b/../c", "//h.net/es/1", "?x=1", "https://K.org/p#f", "/go?u=http://spam.net/es/1", "d/", "..", ".", "mailto:a@b.c", "javascript:void(0)", "HTTP://x.net/a/b", "a;b/c", "x:y"]
    bases = ["http://q.org/a/b/c?d=e", "http://q.org", "http://q.org/", "https://q.org/a/"]
    pages = [(b, f"<link rel='canonical' href='{h}'>") for b in bases for h in hrefs]
    expected = set()
    for b in bases:
        for h in hrefs:
            if "://" in (target := urldefrag(urljoin(b, h))[0]):
                scheme, rest = target.split("://", 1)
                site, slash, tail = rest.partition("/")
                target = f"{scheme.lower()}://{site.lower()}{slash}{tail}"
                target = f"{target}/" if not slash and "?" not in target else target.replace("q.org?", "q.org/?")
                if target not in (b, b + "/"):
                    expected.add((b, target))
    got = {(a, b) for a, b in named_edges(spark, pages) if b not in (a, a + "/")}
    assert got == expected


def test_tags(spark):
    pages = [
        ("http://a.org/1", '<link rel="alternate canonical" href="http://b.org/1"><link rel="noncanonical" href="http://no.org/"><link rel="canonical-x" href="http://no.org/2">'),
        ("http://a.org/2", "<link rel=canonical href=http://b.org/2><LINK HREF='http://b.org/3' REL='Canonical prev'>"),
        ("http://a.org/3", '<base target="_top" href="http://c.org/x/"><link href="y" rel="canonical"><meta http-equiv="Refresh" content="0;URL=z">'),
        ("http://a.org/4", '<link rel="canonical"><link rel="canonical" href=""><meta http-equiv="refresh" content="5">'),
        (None, '<link rel="canonical" href="http://b.org/9">'),
    ]
    assert named_edges(spark, pages) == [("http://a.org/1", "http://b.org/1"), ("http://a.org/2", "http://b.org/2"), ("http://a.org/2", "http://b.org/3"), ("http://a.org/3", "http://c.org/x/y"), ("http://a.org/3", "http://c.org/x/z")]


def test_sql_on_chains_and_hubs(spark):
    """The registered SQL over a table of chains, a hub and loops, with rules at some ends."""
    rng, pages = random.Random(3), []
    link = lambda u: f'<link rel="next canonical" href="{u}">'
    for chain in range(30):
        for i in range(rng.randrange(2, 9)):
            pages.append((f"http://c{chain}.org/{i}", link(f"http://c{chain}.org/{i + 1}") + (f'<meta http-equiv=refresh content="0;url=http://HUB.org/">' if rng.random() < 0.03 else "")))
        pages.append((f"http://c{chain}.org/end", link(rng.choice([f"http://c{chain}.org/1", "http://spam.net/es/1", "http://ok.com/", f"http://c{chain}.org/end"]))))
    pages += [(f"http://h{i}.org/", link("http://hub.org/")) for i in range(200)] + [("http://hub.org/", link("http://spam.net/fr/")), ("http://spam.net/fr/", None), ("http://www.example.com/en/1", link("http://c1.org/0"))]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    connection = duckdb.connect()
    connection.register("pages", frame.toPandas())
    expected = sorted(connection.sql(queries.ORACLE_SQL["op8_urlfilter"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in U.judged(frame, RULES).collect()), key=str)
    assert got == expected and sum(r[-1] == "block" for r in got) > 150 and len({r[-1] for r in got if r[3] is None}) == 2


def test_empty_redirects_and_long_pages(spark):
    none = spark.createDataFrame([], "source string, target string")
    frame = spark.createDataFrame([(1, "http://a.org/1", "x" * 2_000_000 + '<link rel="canonical" href="http://spam.net/es/1">')], "page_id long, url string, html string")
    assert U.judged(frame, RULES, none).first().verdict == "block"
    assert U.judged(frame.limit(0), RULES, none).count() == 0
