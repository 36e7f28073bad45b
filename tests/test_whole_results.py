"""Rows that size, faults or repeats in the input must not lose or multiply."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulemesh.operators.compare import copied_distance, markup_distance, novelty_distance, verdict
from rulemesh.operators.coverage import corpus_lint
from rulemesh.operators.index import build_rule_index
from rulemesh.operators.redirects import capture_heads, pair_captures, resolve_redirects
from rulemesh.operators.rewrite import apply_ruleset, match_targets, not_excluded
from rulemesh.session import shared_folder
from rulemesh.sources.rulesets import load_rulesets, malformed_rulesets, parse_rulesets

CAPTURE = "url string, http_code int, headers string, body string, error string, short_error string"


def filler(n):
    return [(f"^http://no{i}\\.com/", "https://no/") for i in range(n)] + [("^http:", "https:")]


@pytest.mark.parametrize("rules", [10, 300])
@pytest.mark.parametrize("broadcast_bytes, hot_rows", [(1 << 26, 10**6), (0, 10**6), (0, 1)])
def test_equal_rows_stay_however_many_rules(spark, make_corpus, rules, broadcast_bytes, hot_rows):
    corpus = make_corpus({"a": {"targets": ["x.com", "x.com"], "rules": filler(rules)}})
    index = build_rule_index(corpus, broadcast_bytes, hot_rows)
    rows = spark.createDataFrame([("a", "http://x.com/")] * 2 + [("b", "http://y.com/")], "ruleset_id string, url string")
    assert not_excluded(rows, index).count() == 3
    got = Counter((r.ruleset_id, r.new_url, r.rule_pos) for r in apply_ruleset(rows, index).collect())
    assert got == {("a", "https://x.com/", rules): 2, ("b", "http://y.com/", None): 1}


def test_a_target_of_a_broken_rule_is_reported(spark, make_corpus):
    corpus = make_corpus({"a": {"targets": ["x.com"], "rules": [("^http:", "https:$2")]}})
    rules = corpus.rules.withColumn("error", F.lit("invalid group reference 2"))
    lint = corpus_lint(corpus.__class__(corpus.rulesets, corpus.targets, rules, corpus.exclusions, corpus.tests), build_rule_index(corpus.__class__(corpus.rulesets, corpus.targets, rules, corpus.exclusions, corpus.tests)))
    assert [(r.kind, r.subject) for r in lint.collect()] == [("unrewritten_target", "http://x.com/")]


def test_a_fault_of_the_rules_within_a_chain_is_an_error(spark, make_corpus):
    corpus = make_corpus({"b": {"targets": ["b.com"], "rules": [("^http:", "https:")]}})
    rules = corpus.rules.withColumn("error", F.lit("invalid group reference 2"))
    corpus = corpus.__class__(corpus.rulesets, corpus.targets, rules, corpus.exclusions, corpus.tests)
    captures = spark.createDataFrame(
        [("http://a.com/", 200, "", "x", None, None), ("https://a.com/", 301, "Location: http://b.com/\r\n", "", None, None)], CAPTURE
    )
    heads = capture_heads(captures)
    starts = spark.createDataFrame([("https://a.com/",)], "start_url string")
    got = resolve_redirects(starts, heads, build_rule_index(corpus), corpus.rulesets)
    assert [(r.start_url, r.error, r.http_code) for r in got.collect()] == [("https://a.com/", "invalid group reference 2", None)]
    tests = spark.createDataFrame(
        [("a", "http://a.com/", "https://a.com/", "default", None)], "ruleset_id string, url string, new_url string, platform string, regex_error string"
    )
    plain = resolve_redirects(spark.createDataFrame([("http://a.com/",)], "start_url string"), heads)
    results = verdict(pair_captures(tests, plain, got)).collect()
    assert [(r.result, r.details) for r in results] == [("error", "fetch-error invalid group reference 2")]
    nothing = pair_captures(tests, plain, got.limit(0))
    assert [r.result for r in verdict(nothing).collect()] == ["error"]


def test_repeated_captures_give_one_row(spark):
    chain = [
        ("http://a.com/", 301, "Location: /b\r\n", "", None, None),
        ("http://a.com/b", 301, "Location: /c\r\n", "", None, None),
        ("http://a.com/c", 200, "", "", None, None),
        ("http://a.com/c", 500, "", "", None, None),
        ("http://a.com/c", 0, "", "", "boom", None),
    ]
    heads = capture_heads(spark.createDataFrame(chain * 2, CAPTURE))
    starts = spark.createDataFrame([("http://a.com/",)], "start_url string")
    got = resolve_redirects(starts, heads).collect()
    assert [(r.final_url, r.http_code, r.hops) for r in got] == [("http://a.com/c", 200, 2)]
    unread = resolve_redirects(starts, heads, max_depth=0).collect()
    assert [(r.http_code, r.error) for r in unread] == [(None, "Too many redirects")]


def test_captures_are_found_by_their_punycode(spark):
    heads = capture_heads(spark.createDataFrame([("http://b\u00fccher.de/", 200, "", "", None, None)], CAPTURE))
    starts = spark.createDataFrame([("http://b\u00fccher.de/",), ("http://xn--bcher-kva.de/",)], "start_url string")
    assert [r.http_code for r in resolve_redirects(starts, heads).collect()] == [200, 200]


@pytest.mark.parametrize("distance", [markup_distance, novelty_distance, copied_distance])
def test_every_pair_gets_a_distance(spark, distance):
    pages = spark.createDataFrame(
        [("l", "<p>a b c</p>"), ("r", "<p>a b c</p>"), ("r", "<p>a b c</p>")], "url string, body string"
    )
    pairs = spark.createDataFrame(
        [(1, "l", "r"), (2, "l", "r"), (3, "l", "gone"), (4, "gone", "r"), (5, None, "r")], "n int, left_url string, right_url string"
    )
    got = {r.n: r.distance for r in distance(pairs, pages).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_one_page_in_many_pairs(spark, monkeypatch):
    from rulemesh.operators import compare

    monkeypatch.setattr(compare.keyed_join, "__defaults__", ("inner", False, 10, None, None))
    pages = spark.range(300).select(F.concat(F.lit("p"), "id").alias("url"), F.lit("<p>a</p>").alias("body"))
    pairs = spark.range(300).select(F.concat(F.lit("p"), "id").alias("left_url"), F.lit("p0").alias("right_url"))
    assert novelty_distance(pairs, pages).filter("distance = 0").count() == 300
    assert copied_distance(pairs, pages).filter("distance = 0").count() == 300


def test_files_of_any_name_and_encoding(spark, tmp_path):
    for place, data in {
        "b.rules": b"<ruleset name='b'/>",
        "y/c.xml": "<?xml version='1.0' encoding='ISO-8859-1'?><ruleset name='\u00fc'/>".encode("latin-1"),
        "z/c.xml": b"<ruleset name='\xfc'/>",
    }.items():
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_bytes(data)
    files = load_rulesets(spark, [str(tmp_path / p) for p in ("b.rules", "y/c.xml", "z/c.xml")])
    parsed = parse_rulesets(files)
    assert {r.ruleset_id: r.ruleset and r.ruleset["_name"] for r in parsed.collect()} == {
        "b.rules": "b", "y/c.xml": "\u00fc", "z/c.xml": None,
    }
    assert [r.ruleset_id for r in malformed_rulesets(parsed).collect()] == ["z/c.xml"]


class _Elsewhere:
    """A session of a cluster without any shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"
        applicationId = "app"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(_Elsewhere())


def covers(target, host):
    own, labels = target.split(".")[::-1], host.split(".")[::-1]
    same = all(t in ("*", h) for t, h in zip(own, labels))
    longer = len(own) >= 3 and own[-1] == "*" and len(labels) >= len(own)
    return same and (len(own) == len(labels) or longer)


def test_hosts_walk_where_shapes_are_many(spark, make_corpus):
    draw = random.Random(9)
    name = lambda most, words: ".".join(draw.choices(words, k=draw.randint(1, most)))
    targets = sorted({name(9, ["a", "b", "*"]) for _ in range(900)} - {"*"})
    index = build_rule_index(make_corpus({f"r{i}": {"targets": [t], "rules": []} for i, t in enumerate(targets)}))
    assert index.shapes is None  # more than the plan takes
    hosts = sorted({name(9, "ab") for _ in range(150)} | {"c.a", "*.a.b"})
    got = match_targets(spark.createDataFrame([(h,) for h in hosts], "host string"), index)
    expected = {(h, f"r{i}") for i, t in enumerate(targets) for h in hosts if covers(t, h)}
    assert {tuple(r) for r in got.select("host", "ruleset_id").collect()} == expected
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
