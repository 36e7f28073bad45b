import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from rulemesh.operators.index import build_rule_index
from rulemesh.operators.redirects import Side, capture_heads, resolve_both, resolve_platform, resolve_redirects

SCHEMA = "url string, http_code int, headers string, body string, error string, short_error string"


def capture(url, code=200, location=None, error=None):
    headers = "HTTP/1.1 x\r\n" + (f"Location: {location}\r\n" if location is not None else "") + "\r\n"
    return (url, code, headers, "body", error, "short" if error else None)


def resolve(spark, captures, starts, index=None, rulesets=None, platform=None, **options):
    heads = capture_heads(spark.createDataFrame(captures, SCHEMA))
    begun = [(s, platform or "default") for s in starts]
    frame = spark.createDataFrame(begun, "start_url string, platform string")
    result = resolve_redirects(frame, heads, index, rulesets, **options)
    return {r.start_url: r for r in result.collect()}


def chain(length):
    """Captures c0 -> c1 -> ... -> c<length>, the last one final."""
    moved = [capture(f"http://h/c{i}", 302, f"/c{i + 1}") for i in range(length)]
    return moved + [capture(f"http://h/c{length}")]


@pytest.mark.parametrize("depth, ok", [(9, True), (10, False)])
def test_depth_of_ten(spark, depth, ok):
    row = resolve(spark, chain(depth), ["http://h/c0"])["http://h/c0"]
    if ok:
        assert (row.final_url, row.http_code, row.hops, row.error) == ("http://h/c9", 200, 9, None)
    else:
        assert (row.http_code, row.error, row.is_cycle) == (None, "Too many redirects", False)


def test_depth_of_one(spark):
    got = resolve(spark, chain(1), ["http://h/c0", "http://h/c1"], max_depth=1)
    assert got["http://h/c0"].error == "Too many redirects"
    assert got["http://h/c1"].error is None


def test_ends(spark):
    captures = [
        capture("http://h/permanent", 308, "/x"),
        capture("http://h/loop", 301, "/loop2"),
        capture("http://h/loop2", 301, "/loop"),
        capture("http://h/lost", 301, "/nowhere"),
        capture("http://h/bare", 303),
        capture("http://h/zero", 0),
        capture("http://h/dead", 0, error="(6) Could not resolve host: h"),
        capture("http://h/todead", 307, "http://h/dead"),
        capture("http://h/foreign", 301, "ftp://h/x"),
    ]
    starts = [c[0] for c in captures] + ["http://h/absent"]
    got = {url: (r.http_code, r.error, r.is_cycle) for url, r in resolve(spark, captures, starts).items()}
    assert got == {
        "http://h/permanent": (308, None, False),
        "http://h/loop": (None, "Too many redirects", True),
        "http://h/loop2": (None, "Too many redirects", True),
        "http://h/lost": (None, "no capture", False),
        "http://h/bare": (None, "missing Location", False),
        "http://h/zero": (None, "fetch failed", False),
        "http://h/dead": (None, "Could not resolve host", False),
        "http://h/todead": (None, "Could not resolve host", False),
        "http://h/foreign": (None, "no capture", False),  # plain: no rules, no scheme check
        "http://h/absent": (None, "no capture", False),
    }


def test_locations_are_rewritten_and_carry_the_platform(spark, make_corpus):
    corpus = make_corpus(
        {"s.xml": {"targets": ["s.com"], "rules": [("^http:", "https:")]}}, {"s.xml": "cacert"}
    )
    captures = [
        capture("https://h/a", 301, "http://s.com/b"),
        capture("https://s.com/b", 200),
        capture("https://h/c", 301, "http://s.com/d"),
        capture("https://s.com/d", 301, "http://h/e"),
        capture("http://h/e", 200),
        capture("https://h/foreign", 301, "ftp://h/x"),
    ]
    starts = ["https://h/a", "https://h/c", "https://h/foreign"]
    index = build_rule_index(corpus)
    got = resolve(spark, captures, starts, index, corpus.rulesets, "firefox")
    assert (got["https://h/a"].final_url, got["https://h/a"].platform) == ("https://s.com/b", "cacert")
    # the second hop is rewritten by nobody: the start's platform holds again
    assert (got["https://h/c"].final_url, got["https://h/c"].platform) == ("http://h/e", "firefox")
    assert got["https://h/foreign"].error == "Unknown scheme 'ftp' in 'ftp://h/x'"
    fixed = resolve(
        spark, captures, starts, index, corpus.rulesets, "firefox", static_platform="static"
    )
    assert {r.platform for r in fixed.values()} == {"static"}


def test_one_target_of_most_redirects(spark):
    captures = [capture(f"http://h/p{i}", 302, "/login") for i in range(60)]
    captures += [capture("http://h/login", 302, "/form"), capture("http://h/form")]
    starts = [f"http://h/p{i}" for i in range(60)]
    got = resolve(spark, captures, starts, hot_rows=5)
    assert len(got) == 60
    assert {(r.final_url, r.hops) for r in got.values()} == {("http://h/form", 2)}


def test_international_location(spark):
    captures = [
        capture("http://h/a", 301, "http://bücher.de/x"),
        capture("http://xn--bcher-kva.de/x"),
    ]
    assert resolve(spark, captures, ["http://h/a"])["http://h/a"].error is None
    # a start is looked up in its punycode form too
    assert resolve(spark, captures, ["http://bücher.de/x"])["http://bücher.de/x"].http_code == 200


def test_platforms(spark):
    rulesets = spark.createDataFrame(
        [("a", "cacert"), ("b", "odd"), ("c", "default")], "ruleset_id string, platform string"
    )
    sets = [("default", "mozilla"), ("cacert", "both")]
    platforms = spark.createDataFrame(sets, "platform string, ca_set string")
    got = {r.ruleset_id: r.ca_set for r in resolve_platform(rulesets, platforms).collect()}
    assert got == {"a": "both", "b": "mozilla", "c": "mozilla"}
    static = resolve_platform(rulesets, platforms, "only").collect()
    assert {r.ca_set for r in static} == {"only"}
    with pytest.raises(ValueError):
        resolve_platform(rulesets, platforms.filter("platform = 'cacert'"))


def walked(captures, start, max_depth):
    """The same by following one hop after the other."""
    moved = {c[0]: c[2].split("Location: ")[1].split("\r")[0] for c in captures if "Location" in c[2]}
    known = {c[0] for c in captures}
    seen, current = [start], start
    while True:
        if current not in known:
            return current, None, len(seen) - 1, "no capture", False
        if current not in moved:
            return current, 200, len(seen) - 1, None, False
        if len(seen) == max_depth:
            return current, None, len(seen) - 1, "Too many redirects", False
        current = moved[current]
        if current in seen:
            return current, None, len(seen), "Too many redirects", True
        seen.append(current)


@pytest.mark.parametrize("max_depth", [1, 2, 3, 6, 8, 10, 14])
def test_random_graphs_with_cycles(spark, max_depth):
    draw = random.Random(max_depth)
    names = [f"http://h/{i}" for i in range(90)]
    captures = []
    for i, name in enumerate(names):
        kind = draw.random()
        if kind < 0.12:
            captures.append(capture(name))
        elif kind < 0.95:  # mostly to the next, so that chains get long
            captures.append(capture(name, 302, names[(i + 1) % 90] if draw.random() < 0.8 else draw.choice(names)))
    captures += [capture("http://h/self", 301, "http://h/self"), capture("http://h/toself", 301, "http://h/self")]
    starts = [*names, "http://h/self", "http://h/toself"]
    for options in ({}, {"hot_rows": 2}):
        got = resolve(spark, captures, starts, max_depth=max_depth, **options)
        for url in starts:
            row = got[url]
            assert (row.final_url, row.http_code, row.hops, row.error, row.is_cycle) == walked(captures, url, max_depth)


def test_a_location_the_rules_fail_on_may_close_a_cycle(spark, make_corpus):
    corpus = make_corpus({"s.xml": {"targets": ["s.com"], "rules": [("^http://s\\.com/(b)", "http://s.com/$2")]}})
    rules = corpus.rules.withColumn("error", F.lit("No group 2"))
    index = build_rule_index(dataclasses.replace(corpus, rules=rules))
    captures = [
        capture("http://s.com/a", 301, "http://h/mid"),
        capture("http://h/mid", 301, "http://s.com/a"),
        capture("http://h/x", 301, "http://h/y"),
        capture("http://h/y", 301, "http://s.com/q"),
    ]
    got = resolve(spark, captures, ["http://s.com/a", "http://h/mid", "http://h/x"], index, corpus.rulesets)
    # The rules fail on s.com, but a URL seen before is a cycle first of all.
    assert (got["http://s.com/a"].error, got["http://s.com/a"].hops) == ("Too many redirects", 2)
    assert (got["http://h/mid"].final_url, got["http://h/mid"].hops, got["http://h/mid"].error) == ("http://s.com/a", 1, "No group 2")
    assert (got["http://h/x"].hops, got["http://h/x"].error) == (2, "No group 2")


def test_both_sides_in_one_pass(spark, make_corpus):
    corpus = make_corpus(
        {"s.xml": {"targets": ["s.com"], "rules": [("^http:", "https:")]}}, {"s.xml": "cacert"}
    )
    index = build_rule_index(corpus)
    captures = [
        capture("http://h/a", 301, "http://s.com/b"),
        capture("http://s.com/b", 302, "/c"),
        capture("http://s.com/c"),
        capture("https://s.com/b", 302, "http://h/d"),
        capture("http://h/d", 404),
        capture("http://h/f", 301, "ftp://h/x"),
    ]
    heads = capture_heads(spark.createDataFrame(captures, SCHEMA))
    starts = spark.createDataFrame([(c[0], "firefox") for c in captures], "start_url string, platform string")
    plain, rewritten = Side(starts.select("start_url")), Side(starts, index, corpus.rulesets)
    (first, found), (second, _) = resolve_both(plain, rewritten, heads)
    assert found["rows"] == 2 * len(captures)
    for got, side in ((first, plain), (second, rewritten)):
        alone = resolve_redirects(side.starts, heads, side.index, side.rulesets)
        assert sorted(map(str, got.collect())) == sorted(map(str, alone.select(*got.columns).collect()))
    ends = {r.start_url: (r.final_url, r.platform) for r in second.collect()}
    assert ends["http://h/a"] == ("http://h/d", "firefox")
