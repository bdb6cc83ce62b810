import re

import pytest

from tracewright.llm import urlfilter

ROWS = [
    (1, "http://a.Example.COM/en/7?x", "h"), (2, "https://example.com/en/8", "h"), (3, "http://x.net/de/", "h"), (4, "http://example.net/de/88/q", "h"),
    (5, "http://notexample.com/en/71", "h"), (6, None, "h"), (7, "no scheme", "h"), (8, "", "h"), (1, "http://a.Example.COM/en/7?x", "h"),
    (9, "http://com/en/", "h"), (10, "http://com./en/", "h"), (11, "x://y.org#/es/", "h"), (None, "http://y.org/es/", "h"), (12, "http://xcom/en/", "h"),
    (13, "a://b.com/en/://c.net/de/", "h"), (14, "http://É.com/en/\n7", "h"), (15, "http://example.com:80/en/7", "h"), (16, "http://..com/en/" + "z" * 50000, "h"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("most", [100_000, 0])
def test_against_brute_force(spark, most):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, host string")
    got = [tuple(r) for r in urlfilter.judge(pages, urlfilter.rule_table(spark), broadcast_rules=most).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(u)) for i, u, _ in ROWS], key=str)


def test_empty(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, host string")
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urlfilter.judge(pages, none, default="block").collect()} == {"block"}


def test_many_shapes(spark):
    """Rules of a thousand shapes, against brute force."""
    rules = [("block" if i % 3 else "allow", ".".join(["a"] * (i % 20) + ["net"]), "/" * (1 + i // 20)) for i in range(1000)]
    pages = [(i, "x://" + ".".join(["a"] * (i % 25) + ["net"]) + "/" * (i % 60)) for i in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), urlfilter.rule_table(spark, rules)).collect()}
    for i, u in pages:
        host, path = u[4:].split("/", 1)[0], u[4 + len(u[4:].split("/", 1)[0]) :]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow")), u
