"""URL filters against a plain reading of the lists, with odd addresses."""

import datetime as dt
import random
import re

import pytest

from speechlake.llm import url_filter

DEEP = ".".join(f"l{k}" for k in range(20)) + ".example.com"
FOLDERS = "/".join(f"f{k}" for k in range(20))


def plain(url, day, events):
    """The lists that hold the address on this day."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:\[]+)[^/?#]*([^?#]*)", url or "")
    if not m or day is None:
        return None
    host, path = m[1].lower(), m[2]
    state = {}
    for name, kind, pattern, action, dated in sorted(events, key=lambda e: (e[4], e[3] == "add")):
        if dated > day:
            continue
        if kind == "domain":
            p = pattern.lower()
            hit = host == p or host.endswith("." + p)
        else:
            at = (pattern + "/").index("/")
            p = pattern[:at].lower() + pattern[at:]
            hit = host + path == p or p.endswith("/") and (host + path).startswith(p)
        if hit:
            state[name, kind, p] = action == "add"
    return sorted({k[0] for k, on in state.items() if on})


def run(spark, captures, events):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    e = spark.createDataFrame(events, "list string, kind string, pattern string, action string, dated date")
    return {r.page_id: list(r.lists) for r in url_filter.filter_urls(c, e).collect()}


@pytest.mark.parametrize("most", [200_000, 0])
def test_odd_addresses(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    day = dt.date(2024, 1, 1)
    events = [
        ("case", "prefix", "Example.com/Path/", "add", day), ("labels", "domain", DEEP, "add", day), ("folders", "prefix", f"deep.org/{FOLDERS}/", "add", day),
        ("single", "domain", "LocalHost", "add", day), ("six", "domain", "[::1]", "add", day), ("page", "prefix", "one.net/A?no", "add", day), ("page", "prefix", "one.net/A", "add", day), ("top", "domain", "museum", "add", day),
    ]
    urls = {
        "http://EXAMPLE.com/Path/x": ["case"], "http://example.com/path/x": [], "http://example.com/Path": [], f"http://a.{DEEP.upper()}/": ["labels"], f"http://{DEEP[3:]}/": [],
        f"http://deep.org/{FOLDERS}/more/and/more?q": ["folders"], f"http://deep.org/{FOLDERS}": [], "http://localhost:8080/x": ["single"], "http://u:p@localhost": ["single"],
        "http://[::1]:80/": ["six"], "http://[::2]/": [], "http://one.net/A#b": ["page"], "http://one.net/A/": [], "http://art.museum/": ["top"], "museum": [], "": [],
    }
    captures = [(k, u, day) for k, u in enumerate(urls)] + [(100, None, day), (101, "http://localhost/", None), (102, "http://localhost/", dt.date(2023, 12, 31))]
    found = run(spark, captures, events)
    assert {u: found[k] for k, u in enumerate(urls)} == urls
    assert found[100] == found[101] == found[102] == []


def test_dated_entries_by_brute_force(spark):
    rng = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(40)]
    hosts = ["a.b.Com", "b.com", "com", "x.a.b.com", "localhost", "[fe80::1]", "c.org"]
    paths = ["", "/", "/A/", "/A/b", "/A/b/", "/a/b/c"]
    events = [(rng.choice("pqr"), k, rng.choice(hosts) + (rng.choice(paths) if k == "prefix" else ""), rng.choice(["add", "add", "remove"]), rng.choice(days)) for k in rng.choices(["domain", "prefix"], k=150)]
    captures = [(k, rng.choice(["http://", "HTTPS://me@", "ftp://"]) + rng.choice(hosts) + rng.choice(["", ":81"]) + rng.choice(paths) + rng.choice(["", "?q=/A/", "#/a/"]), rng.choice(days)) for k in range(400)]
    found = run(spark, captures, events)
    assert found == {k: plain(u, d, events) for k, u, d in captures}
    assert sum(map(bool, found.values())) > 100


def test_empty_lists_and_tables(spark):
    day = dt.date(2024, 1, 1)
    assert run(spark, [(1, "http://a.com", day)], []) == {1: []}
    assert run(spark, [], [("l", "domain", "a.com", "add", day)]) == {}


def test_addresses_that_mean_the_same_host(spark):
    day = dt.date(2024, 1, 1)
    events = [("l", "domain", "Example.COM.", "add", day), ("p", "prefix", "ex%61mple.org/Dir/", "add", day)]
    urls = [
        "http://example.com./a", "http://u:p@ss@example.com/", "http://example.com\\a", "//example.com/a", "http:\\\\example.com", "http://ex%61mple.com/", " http://www.example.com:80?x", "http://example\u3002com/", "http://example.com..:8080#a",
        "http://u@a@example.org./Dir/x", "http://example.org\\Dir\\x",
    ]
    found = run(spark, [(k, u, day) for k, u in enumerate(urls)], events)
    assert [found[k] for k in range(len(urls))] == [["l"]] * 9 + [["p"]] * 2
    others = ["http://example.com@other.net/", "http://other.net/?//example.com/", "http://other.net/example.com", "http://example.com%zz/", "http://notexample.com/", "example.com/a", "http://example.org/dir/x", "http:///example.com", "http://[example.com]/"]
    found = run(spark, [(k, u, day) for k, u in enumerate(others)], events)
    assert [found[k] for k in range(len(others))] == [[]] * len(others)
