"""The URL filter against a plain comparison of every URL with every rule, and against SQL."""

from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tenure.llm import urls

SMALL = "/root/testdata/sf0.001"


def plain(rules, url, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h), len(p), v == "block", h + p, v) for v, h, p in ((v, h, p or "") for v, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


RULES = [
    ("allow", "com", "/"), ("block", "com", None), ("block", "a.com", "/en"), ("allow", "a.com", "/en/x"), ("block", "a.com", "/en/x"),
    ("allow", "b.a.com", "/en/x/"), ("block", "net", "//"), ("allow", "net", "/q/r"), ("allow", "b.net", ""), ("block", "x:80", "/"),
    *[("block", "many.org", f"/{i}") for i in range(9)], ("allow", "many.org", "/1/2"), ("allow", "org", "/12"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "HTTP://A.COM/en", "http://a.com/english?x=/en/x", "http://xa.com/en", "ftp://b.a.com/en/x/#y", "http://b.a.com/en/x",
    "http://.com/", "http://com./", "http://net//", "http://c.net/q/r/s", "http://b.net?x", "http://b.net#/", "http://x:80/", "http://many.org/12/3", "http://many.org/1/2", "a://b://com/",
    "http://many.org/" + "7" * 300_000, "http://" + "a." * 50_000 + "com/", "http://a.com/en\n/x", "http://É.com/É", "http://a.com/en", "http://a.com/en",
]


@pytest.mark.parametrize("per_trie", [1 << 18, 3])
@pytest.mark.parametrize("as_table", [False, True])
def test_rules_equal_a_plain_version(spark, monkeypatch, per_trie, as_table):
    monkeypatch.setattr(urls, "RULES_PER_TRIE", per_trie)
    df = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, __found string, verdict string")
    rules = spark.createDataFrame(RULES + RULES[:3], "verdict string, host string, path string") if as_table else RULES
    got = urls.judge(df, rules)
    assert got.columns == ["page_id", "url", "__found", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows] == [(i, *plain(RULES, u)) for i, u in [*enumerate(URLS), (None, None)]]
    assert rows[0]["__found"] == "kept"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.from_regex(r"(a\.|b\.)?[ab]", fullmatch=True), st.text("/ab", max_size=5)), max_size=12),
    st.from_regex(r"([ab.]{0,5})", fullmatch=True), st.text("/ab", max_size=6),
)
def test_longest_rule(rules, host, path):
    path = path and "/" + path
    found = urls.longest(urls.trie(rules), host, path)
    assert (found and (found[0] + found[1], found[2]) or (None, "allow")) == plain(rules, f"x://{host}{path}")[2:]


def test_bad_rules_are_errors():
    for rule in (("deny", "com", "/"), ("block", "", "/"), ("block", None, "/"), ("block", "com", "/" * urls.RULE_CHARS)):
        with pytest.raises(ValueError):
            urls.trie([rule])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urls.judge(one, [], default="block").first().asDict() == {"page_id": 1, "url": "http://a.com/", "host": "a.com", "path": "/", "rule": None, "verdict": "block"}


def test_query_equals_sql(spark):
    got = entry.queries()["op13_urls"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = con.execute(entry.oracle_sql()["op13_urls"]).fetchall()
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(want)
