import random
from dataclasses import replace

import pytest

from rulemesh.operators.index import build_rule_index
from rulemesh.operators.rewrite import match_targets, target_hierarchy


def covers(target: str, host: str) -> bool:
    """Descent label by label from the top level, as the definition has it."""
    want, have = target.split(".")[::-1], host.split(".")[::-1]

    def descend(depth: int) -> bool:
        if depth == len(want):
            at_leaf = depth == len(have)
            return at_leaf or (depth >= 3 and want[-1] == "*")
        if depth == len(have):
            return False
        return want[depth] in ("*", have[depth]) and descend(depth + 1)

    return descend(0)


CASES = [
    ("*.example.com", "a.b.example.com", True),
    ("*.example.com", "a.example.com", True),
    ("*.example.com", "example.com", False),
    ("*.com", "b.com", True),
    ("*.com", "a.b.com", False),
    ("google.*", "google.com", True),
    ("google.*", "google.co.uk", False),
    ("www.*.example.com", "www.x.example.com", True),
    ("www.*.example.com", "www.x.y.example.com", False),
    ("a.com", "a.com:8080", False),
    ("a.com", "a.com", True),
    ("localhost", "localhost", True),
]


def matched(spark, index, hosts):
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {(r.host, r.ruleset_id) for r in match_targets(frame, index).collect()}


def test_named_cases(spark, make_corpus):
    for target, host, expected in CASES:
        assert covers(target, host) is expected
    index = build_rule_index(make_corpus({t: {"targets": [t]} for t, _, _ in CASES}))
    got = matched(spark, index, {h for _, h, _ in CASES})
    for target, host, expected in CASES:
        assert ((host, target) in got) is expected, (target, host)


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "salted", "shapes joined"])
def test_random_hosts_against_the_definition(spark, make_corpus, way):
    rng = random.Random(7)
    labels = ["a", "b", "com", "www"]

    def name(alphabet):
        return ".".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))

    targets = sorted({name(labels + ["*", "*"]) for _ in range(80)})
    hosts = sorted({name(labels) for _ in range(200)})
    corpus = make_corpus({f"r{i}": {"targets": [t]} for i, t in enumerate(targets)})
    index = build_rule_index(corpus)
    if way == "shuffle":
        index = replace(index, fits=False)
    elif way == "salted":
        index = replace(index, fits=False, hot_rows=3)
    elif way == "shapes joined":
        index = replace(index, fits=False, shapes=None, hot_rows=20)
    expected = {(h, f"r{i}") for h in hosts for i, t in enumerate(targets) if covers(t, h)}
    assert expected
    assert matched(spark, index, hosts) == expected


def test_hierarchy(spark, make_corpus):
    corpus = make_corpus({"x": {"targets": ["*.a.com", "a.com"]}, "y": {"targets": ["a.com"]}})
    got = {tuple(r) for r in target_hierarchy(corpus.targets).collect()}
    assert got == {
        ("", "com", "domain", 1),
        ("com", "a.com", "domain", 2),
        ("a.com", "*.a.com", "domain", 3),
        ("*.a.com", "x", "ruleset", 4),
        ("a.com", "x", "ruleset", 3),
        ("a.com", "y", "ruleset", 3),
    }
