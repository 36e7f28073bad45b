import pytest

from rulemesh.operators.corpus import derive_tests
from rulemesh.operators.coverage import (
    corpus_lint,
    coverage_gate,
    coverage_problems,
    needed_tests,
    what_applies,
)
from rulemesh.operators.index import build_rule_index


def needed(corpus, **options):
    return {(r.ruleset_id, r.kind, r.pos): r.needed for r in needed_tests(corpus, **options).collect()}


@pytest.mark.parametrize(
    "pattern, count",
    [
        ("a", 1),
        ("a?b+", 2),  # one for +; the ? is taken off again
        ("(?:a)", 0),  # the group opener counts twice against
        ("(?:a|b|c)", 2),
        (r"a\+", 2),  # escapes are not understood
        ("(?!x)(?=y)a*", 0),
    ],
)
def test_needed_for_a_rule(spark, make_corpus, pattern, count):
    corpus = make_corpus({"r": {"rules": [(pattern, "x")]}})
    assert needed(corpus) == {("r", "rule", 0): count}


def test_needed_for_an_exclusion_looks_at_the_last_rule(spark, make_corpus):
    corpus = make_corpus(
        {
            "r": {"rules": [("a???", "x"), ("b?", "x")], "exclusions": ["c?d+|e"]},
            "lone": {"exclusions": ["c?d+"]},
        }
    )
    assert needed(corpus)["r", "exclusion", 0] == 3  # 1 + 3 - the one ? of rule 1
    assert needed(corpus)["lone", "exclusion", 0] == 3  # no rule, nothing taken off
    assert needed(corpus, own_pattern=True)["lone", "exclusion", 0] == 2


def test_coverage(spark, make_corpus):
    corpus = make_corpus(
        {
            "r.xml": {
                "targets": ["r.com", "*.r.com", "r.com"],
                "rules": [("^http://r\\.com/", "https://r.com/"), ("^http:.*x$", "https:$1")],
                "exclusions": ["/skip"],
                "tests": ["http://r.com/skip", "http://elsewhere/"],
            }
        }
    )
    tests = derive_tests(corpus)
    assert sorted(r.url for r in tests.collect()) == [
        "http://elsewhere/", "http://r.com/", "http://r.com/", "http://r.com/skip",
    ]
    applied = what_applies(tests, build_rule_index(corpus))
    problems = coverage_problems(corpus, applied)
    assert {r.message for r in problems.collect()} == {
        "r.xml: No rule or exclusion applies to test URL http://elsewhere/",
        r"r.xml: Not enough tests (0 vs 2) for <Rule from '^http:.*x$' to 'https:\g<1>'>",
    }
    assert tuple(coverage_gate(problems).first()) == (2, 1)
    assert tuple(coverage_gate(problems.filter("false")).first()) == (0, 0)


def test_lint(spark, make_corpus):
    corpus = make_corpus(
        {
            "a": {"targets": ["a.com", "intranet", "*.com"], "rules": [("^http://a", "https://a")]},
            "b": {"targets": ["a.com"], "rules": [("^http:", "https:")]},
        }
    )
    found = {tuple(r) for r in corpus_lint(corpus, build_rule_index(corpus)).collect()}
    assert found == {
        ("unrewritten_target", "http://intranet/", "a", 1),
        ("shared_host", "a.com", "a", 2),
        ("shared_host", "a.com", "b", 2),
        ("incomplete_host", "intranet", "a", 1),
    }
