import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rulemesh.functions.patterns import java_template, necessary_literal
from rulemesh.operators.corpus import usable_elements, validate_rules
from rulemesh.operators.coverage import what_applies
from rulemesh.operators.index import CHUNK, build_rule_index
from rulemesh.operators.rewrite import apply_ruleset, not_excluded, transform_urls

SETS = {
    "a.xml": {
        "targets": ["01.org", "*.01.org"],
        "rules": [(r"^http://(www\.)?01\.org/", "https://$101.org/")],
        "exclusions": [r"/skip", r"[?&]x="],
    },
    "b.xml": {
        "targets": ["b.com", "www.b.com"],
        "rules": [("^https:", "https:"), ("b", "B"), ("^http:", "https:")],
    },
    "c.xml": {"targets": ["*.b.com"], "rules": [("^http:", "https:")]},
}


def rows(frame, *columns):
    return {tuple(r) for r in frame.select(*columns).collect()}


def test_template_digits(spark):
    cases = {
        "https://$101.org/": "https://$1\\01.org/",
        "$b": "\\$b",
        "$$1": "\\$$1",
        "a\\1": "a\\\\1",
        "$0": "$0",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.j for r in frame.select("t", java_template(F.col("t")).alias("j")).collect()}
    assert got == cases


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "salted"])
def test_apply_ruleset(spark, make_corpus, way):
    index = build_rule_index(make_corpus(SETS))
    if way != "broadcast":
        index = replace(index, fits=False, hot_rows=1 if way == "salted" else index.hot_rows)
    pairs = spark.createDataFrame(
        [
            ("a.xml", "http://www.01.org/x"),
            ("a.xml", "http://01.org/x"),
            ("a.xml", "http://01.org/skip"),
            ("a.xml", "http://01.org/y?x=1"),
            ("a.xml", "http://other.org/"),
            ("b.xml", "https://b.com/b"),
            ("b.xml", "http://c.com/"),
            ("none.xml", "http://b.com/"),
        ],
        "ruleset_id string, url string",
    )
    assert rows(apply_ruleset(pairs, index), "url", "new_url", "rule_pos") == {
        ("http://www.01.org/x", "https://www.01.org/x", 0),  # $101: group 1, then 01
        ("http://01.org/x", "https://01.org/x", 0),  # a group that took no part is empty
        ("http://01.org/skip", "http://01.org/skip", None),
        ("http://01.org/y?x=1", "http://01.org/y?x=1", None),
        ("http://other.org/", "http://other.org/", None),
        # rule 0 matches but changes nothing, so rule 1 wins, and replaces everywhere
        ("https://b.com/b", "https://B.com/B", 1),
        ("http://c.com/", "https://c.com/", 2),
        ("http://b.com/", "http://b.com/", None),
    }
    assert pairs.count() - not_excluded(pairs, index).count() == 2


@pytest.mark.parametrize("way", ["in place", "broadcast", "shuffle", "salted"])
def test_transform_urls(spark, make_corpus, way):
    index = build_rule_index(make_corpus(SETS))
    assert index.by_target is not None
    if way != "in place":
        index = replace(index, by_target=None)
    if way in ("shuffle", "salted"):
        index = replace(index, fits=False, hot_rows=1 if way == "salted" else index.hot_rows)
    urls = spark.createDataFrame(
        [
            (1, "http://www.b.com/x"),
            (2, "http://sub.b.com/x"),
            (3, "http://b.com:80/x"),
            (4, "file:///x"),
            (5, "http://deep.www.01.org/x"),
            (6, "http://www.b.com/x"),
            (7, None),
            (8, "http://WWW.01.org/"),
        ],
        "id int, url string",
    )
    result = transform_urls(urls, index)
    assert transform_urls(urls.unionByName(urls), index).count() == 16  # a row for each row
    assert rows(result, "id", "new_url", "ruleset_id", "rule_pos", "ambiguous", "error") == {
        (1, "http://www.B.com/x", "b.xml", 1, True, None),  # b.xml before c.xml
        (6, "http://www.B.com/x", "b.xml", 1, True, None),
        (2, "https://sub.b.com/x", "c.xml", 0, False, None),
        (3, "http://b.com:80/x", None, None, False, None),
        (4, None, None, None, False, "Unknown scheme 'file' in 'file:///x'"),
        (5, "http://deep.www.01.org/x", None, None, False, None),
        (7, None, None, None, False, "Unknown scheme"),
        (8, "http://WWW.01.org/", None, None, False, None),  # host folds, pattern does not
    }


def test_international_host_reaches_its_rules(spark, make_corpus):
    index = build_rule_index(
        make_corpus({"i.xml": {"targets": ["xn--bcher-kva.de"], "rules": [("^http:", "https:")]}})
    )
    urls = spark.createDataFrame([("http://bücher.de/",)], "url string")
    assert rows(transform_urls(urls, index), "new_url") == {("https://bücher.de/",)}


def test_many_rules_are_kept_in_several_lists(spark, make_corpus):
    many = 3 * CHUNK + 5
    rules = [(f"^http://never{i}/", "https://x/") for i in range(many - 1)] + [("^http:", "https:")]
    exclusions = [f"/no{i}$" for i in range(CHUNK + 3)]
    sets = {"m.xml": {"targets": ["m.com"], "rules": rules, "exclusions": exclusions}}
    index = build_rule_index(make_corpus(sets))
    assert not index.one_list
    last_exclusion = f"http://m.com/no{CHUNK + 2}"
    urls = spark.createDataFrame(
        [(0, "http://m.com/"), (1, last_exclusion), (2, "http://never300/")], "id int, url string"
    )
    pairs = urls.withColumn("ruleset_id", F.lit("m.xml"))
    assert rows(apply_ruleset(pairs, index), "id", "new_url", "rule_pos") == {
        (0, "https://m.com/", many - 1),
        (1, last_exclusion, None),
        (2, "https://x/", 300),
    }
    assert rows(what_applies(pairs, index), "id", "kind", "element_pos") == {
        (0, "rule", many - 1),
        (1, "exclusion", CHUNK + 2),
        (2, "rule", 300),
    }
    assert rows(transform_urls(urls, index), "id", "new_url") == {
        (0, "https://m.com/"),
        (1, last_exclusion),
        (2, "http://never300/"),
    }


def test_invalid_elements(spark, make_corpus):
    corpus = make_corpus(
        {
            "ok.xml": {"rules": [("(a)", "$1")], "exclusions": ["x"]},
            "group.xml": {"rules": [("^http:", "https:"), ("^ftp:(a)", "$2")]},
            "pattern.xml": {"rules": [("(", "y")], "exclusions": ["z"]},
            "excl.xml": {"rules": [("a", "b")], "exclusions": ["[z"]},
            "class.xml": {"rules": [(r"[(](\()", "$1$0")]},
            "class2.xml": {"rules": [(r"[(]\(", "$1")]},
        }
    )
    checked = rows(validate_rules(corpus).filter("NOT valid"), "ruleset_id", "kind", "pos", "error")
    assert checked == {
        ("group.xml", "rule", 1, "template names a missing group"),
        ("class2.xml", "rule", 0, "template names a missing group"),
        ("pattern.xml", "rule", 0, "pattern does not compile"),
        ("excl.xml", "exclusion", 0, "pattern does not compile"),
    }
    usable, _ = usable_elements(corpus)
    assert rows(usable.rulesets, "ruleset_id") == {
        ("ok.xml",), ("group.xml",), ("class.xml",), ("class2.xml",)
    }
    pairs = spark.createDataFrame(
        [("group.xml", "http://x/"), ("group.xml", "ftp:b")], "ruleset_id string, url string"
    )
    applied = apply_ruleset(pairs, build_rule_index(usable))
    assert rows(applied, "url", "new_url", "regex_error") == {
        ("http://x/", "https://x/", None),  # rule 0 changes it before the bad rule is reached
        ("ftp:b", None, "template names a missing group ^ftp:(a)"),
    }


def test_necessary_literals(spark):
    cases = {
        r"^http://(www\.)?example\.com/": "example.com/",
        r"^https?://abc\.org/": "://abc.org/",
        r"^http://(?:a|bc)\.net/path": ".net/path",
        "a|bcd": "",
        "(a|bcd)+": "",
        r"ab[c\]d]ef+g": "ab",
        "abc*de": "ab",
        "abc+?d": "abc",
        r"ab{0,3}cd": "cd",
        r"x(a(b(c))d)y+": "x",
        r"(((((a)))))bc": "",
        r"(?i)abc": "",
        r"abc(?=d)": "",
        r"\Qa.b\E": "",
        r"\bfoo\d\\bar\$": "\\bar$",
        r"\/a\-b\:c": "/a-b:c",
        r"[a[bc]]de": "",
        r"[]a]bc": "",
        "": "",
        ".": "",
        "x": "",
        r"a.b": "a",
        r"grüße\?x": "grüße?x",
    }
    frame = spark.createDataFrame([(c,) for c in [*cases, None]], "p string")
    got = {r.p: r.l for r in frame.select("p", necessary_literal(F.col("p")).alias("l")).collect()}
    assert got == {**cases, None: ""}


def random_pattern(draw, depth=0):
    parts = []
    for _ in range(draw.randrange(1, 6)):
        kind = draw.random()
        if kind < 0.55:
            part = draw.choice(["a", "b", "ab", "ba.", r"\.", "/", r"\?", "ü", r"\/", r"\\"])
        elif kind < 0.7:
            part = draw.choice(["[ab]", "[^a]", r"\w", r"\d", ".", r"[a\]]", r"[(]", "^", "$", r"\b"])
        elif depth < 3:
            part = draw.choice(["(%s)", "(?:%s)"]) % random_pattern(draw, depth + 1)
        else:
            part = "a"
        if part[-1] not in "^$" and draw.random() < 0.25:
            part += draw.choice(["*", "+", "?", "{0,2}", "{2}", "+?", "*?"])
        parts.append(part)
    out = "".join(parts)
    return f"{out}|{random_pattern(draw, depth + 1)}" if draw.random() < 0.12 and depth < 3 else out


def test_a_match_holds_the_necessary_literal(spark):
    draw = random.Random(3)
    patterns = [random_pattern(draw) for _ in range(400)]
    texts = ["".join(draw.choices("ab./?ü\\x1", k=draw.randrange(0, 14))) for _ in range(300)]
    pairs = spark.createDataFrame([(p,) for p in patterns], "p string").withColumn(
        "l", necessary_literal(F.col("p"))
    ).crossJoin(spark.createDataFrame([(t,) for t in texts], "t string"))
    found = pairs.filter(F.rlike("t", F.col("p")))
    assert found.filter("l <> ''").count() > 1000
    assert found.filter(~F.contains("t", F.col("l"))).count() == 0


def test_literals_spare_patterns_and_change_nothing(spark, make_corpus):
    """300 rules: equal results, a tenth of the pattern runs at most."""
    draw = random.Random(11)
    hosts = [f"site{i}.com" for i in range(300)]
    rules = [(f"^http://(www\\.)?{h[:-4]}\\.com/", f"https://{h}/") for h in hosts[:-4]]
    rules += [("^http://(a|b)", "https://$1"), ("/old[0-9]+/", "/new/"), ("x?y?z", "w"), ("q(?=r)", "s")]
    exclusions = [f"/skip{i}\\?" for i in range(300)]
    index = build_rule_index(make_corpus({"m.xml": {"targets": ["*.com"], "rules": rules, "exclusions": exclusions}}))
    urls = [
        f"http://{draw.choice(['', 'www.', 'a.'])}{draw.choice(hosts)}/{draw.choice(['', 'old7/', 'z', 'qr', 'skip9?', 'skip99?x'])}"
        for _ in range(200)
    ]
    pairs = spark.createDataFrame([("m.xml", u) for u in urls], "ruleset_id string, url string")
    blank = F.transform("items", lambda x: x.withField("literal", F.lit("")))
    without = replace(
        index, rules=index.rules.withColumn("items", blank), exclusions=index.exclusions.withColumn("items", blank)
    )
    names = ["url", "new_url", "rule_pos"]
    assert rows(apply_ruleset(pairs, index), *names) == rows(apply_ruleset(pairs, without), *names)
    tried = pairs.join(index.rules, "ruleset_id").select(
        F.size("items").alias("all"),
        F.size(F.filter("items", lambda x: F.contains(F.col("url"), x["literal"]))).alias("run"),
    )
    total = tried.agg(F.sum("all"), F.sum("run")).first()
    assert total[1] * 10 <= total[0]
