import hashlib
import json
import xml.etree.ElementTree

import pytest
from pyspark.sql import functions as F

from rulemesh.operators.compare import verdict
from rulemesh.operators.corpus import active_rulesets, derive_tests
from rulemesh.operators.index import build_rule_index
from rulemesh.operators.report import disable_failing, json_lines, results_by_class, run_summary
from rulemesh.operators.rewrite import not_excluded
from rulemesh.plans.check import check_corpus, load_corpus, tested_pairs
from rulemesh.sources.captures import load_captures
from rulemesh.sources.lists import load_skiplist, load_url_list
from rulemesh.sources.rulesets import load_rulesets
from rulemesh.sources.sinks import append_results, write_disabled, write_json_document, write_json_report

FILES = {
    "One.xml": """<!-- a -- first comment -->
<ruleset name="One" platform="cacert">
  <target host="one.com" />
  <target host="*.one.com" />
  <!-- <rule from="^dead:" to="x:" /> -->
  <exclusion pattern=" x|/skip" />
  <test url="http://www.one.com/?a=1&amp;b=2" />
  <rule from="^http://(www\\.)?one\\.com/" to="https://$1one.com/" />
  <rule from="^http:" to="https:" />
</ruleset>
""".replace("a -- first", "a first"),
    "Off.xml": '<ruleset name="Off" default_off="broken"><target host="off.com" /><rule from="a" to="b" /></ruleset>',
    "Empty.xml": '<ruleset name="Empty" default_off=""><target host="empty.com" /><rule from="^http:" to="https:" /></ruleset>',
    "Idn.xml": '<ruleset name="Idn"><target host="bücher.de" /><rule from="^http:" to="https:" /></ruleset>',
    "Broken.xml": '<ruleset name="Broken"><target host="b.com">',
    "Known.xml": '<ruleset name="Known"><target host="known.com" /><rule from="^http:" to="https:" /></ruleset>',
    "Pattern.xml": '<ruleset name="Pattern"><target host="p.com" /><rule from="(" to="b" /></ruleset>',
    "notes.txt": "no rule set",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("rules")
    for name, text in FILES.items():
        (path / name).write_text(text, encoding="utf-8")
    digest = hashlib.sha256(FILES["Known.xml"].encode()).hexdigest()
    (path / "skiplist").write_text(f"{digest.upper()} Known.xml\n{'0' * 64} other\n")
    return path


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return load_corpus(spark, str(folder), load_skiplist(spark, str(folder / "skiplist")))


def ids(frame):
    return {r.ruleset_id for r in frame.collect()}


def test_corpus_from_files(loaded):
    corpus = loaded.corpus
    assert ids(corpus.rulesets) == {"One.xml", "Empty.xml", "Idn.xml"}
    assert ids(loaded.malformed) == {"Broken.xml"}
    assert ids(loaded.rejected) == {"Pattern.xml"}
    one = corpus.rulesets.filter("name = 'One'").first()
    assert one.platform == "cacert" and one.default_off is None
    assert one.file_sha256 == hashlib.sha256(FILES["One.xml"].encode()).hexdigest()
    assert corpus.rulesets.filter("name = 'Empty'").first().default_off == ""
    hosts = {(r.ruleset_id, r.pos, r.host) for r in corpus.targets.collect()}
    assert hosts == {
        ("One.xml", 0, "one.com"), ("One.xml", 1, "*.one.com"),
        ("Empty.xml", 0, "empty.com"), ("Idn.xml", 0, "xn--bcher-kva.de"),
    }
    rules = [(r.pos, r.from_pattern, r.to_java) for r in corpus.rules.filter("ruleset_id = 'One.xml'").orderBy("pos").collect()]
    assert rules == [(0, r"^http://(www\.)?one\.com/", "https://$1one.com/"), (1, "^http:", "https:")]
    assert corpus.exclusions.first().pattern == " x|/skip"  # blanks are kept
    assert {r.url for r in corpus.tests.collect()} == {"http://www.one.com/?a=1&b=2"}


def test_explicit_files_and_default_off(spark, folder):
    files = [str(folder / "Off.xml"), str(folder / "Empty.xml")]
    assert load_rulesets(spark, files).count() == 2
    everything = load_corpus(spark, files, include_default_off=True).corpus
    assert ids(everything.rulesets) == {"Off.xml", "Empty.xml"}
    assert ids(active_rulesets(everything.rulesets)) == {"Empty.xml"}


CAPTURES = [
    ("http://one.com/", 200, "", "<p>plain</p>", None),
    ("https://one.com/", 200, "", "<div><ul><li>quite</li><li>other</li></ul></div>", None),
    ("http://www.one.com/?a=1&b=2", 200, "", "<p>x</p>", None),
    ("https://www.one.com/?a=1&b=2", 404, "", "", None),
    ("http://empty.com/", 200, "", "<p>x</p>", None),
    ("https://empty.com/", 0, "", "", "(7) Failed to connect to empty.com -- Connection refused"),
    ("http://xn--bcher-kva.de/", 200, "", "<p>b</p>", None),
    ("https://xn--bcher-kva.de/", 301, "Location: /home\r\n", "", None),
    ("https://xn--bcher-kva.de/home", 200, "", "<p>b</p>", None),
]


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("captures") / "table")
    schema = "url string, http_code int, headers string, body string, error string"
    spark.createDataFrame(CAPTURES, schema).write.parquet(path)
    return load_captures(spark, path)


def test_whole_check(spark, loaded, captures, tmp_path):
    assert captures.filter("short_error IS NOT NULL").count() == 0  # a column the table lacks
    run = check_corpus(loaded.corpus, captures)
    results = {r.url: (r.result, r.details, r.fname) for r in run.results.collect()}
    assert results == {
        "http://one.com/": ("success", "", "One.xml"),
        "http://www.one.com/?a=1&b=2": ("error", "non-2xx http code", "One.xml"),
        "http://empty.com/": ("error", "fetch-error connection refused", "Empty.xml"),
        "http://xn--bcher-kva.de/": ("success", "", "Idn.xml"),
    }
    assert [r.url for r in run.distances.collect()] == ["http://one.com/"]
    assert run.gate.first().exit_code == 1
    assert {(r.ruleset_id, r.actual, r.needed) for r in run.coverage.collect()} == {("One.xml", 0, 1), ("One.xml", 0, 2)}
    assert {r.result: r.n for r in results_by_class(run.results).collect()} == {"success": 2, "error": 2}

    tests = not_excluded(derive_tests(loaded.corpus), build_rule_index(loaded.corpus))
    assert tuple(run_summary(loaded.files, tests, 1.5).first()) == (len(FILES) - 2, 4, 1.5)

    # sinks
    append_results(run.results, str(tmp_path / "results"))
    append_results(run.results, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 8
    write_json_report(run.results, run.coverage, str(tmp_path / "lines"))
    sections = {p.name for p in (tmp_path / "lines").iterdir() if p.is_dir()}
    assert sections == {"section=error", "section=success", "section=coverage"}
    write_json_document(run.results, run.coverage, str(tmp_path / "document"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "document").glob("part-*")))
    document = json.loads(text)
    assert {k: len(v) for k, v in document.items()} == {"coverage": 2, "error": 2, "success": 2}
    assert {e["url"] for e in document["error"]} == {"http://www.one.com/?a=1&b=2", "http://empty.com/"}
    assert "https_url" in document["error"][0] and "https_url" not in document["success"][0]
    assert all("Not enough tests" in m for m in document["coverage"])

    failures = run.results.filter("returned").select(F.col("fname").alias("ruleset_id"), "message")
    write_disabled(loaded.files, failures, str(tmp_path / "disabled"))
    parts = {p.parent.name: p for p in (tmp_path / "disabled").glob("*/part-*")}
    assert set(parts) == {"ruleset_id=One.xml"}  # Empty.xml names default_off already; one file
    document = parts["ruleset_id=One.xml"].read_text()
    assert document.startswith(
        "\n<!--\nDisabled by rule checker because:\nNon-2xx HTTP code: http://www.one.com/?a=1&b=2 (200) => "
    )
    assert "<ruleset name=\"One\" platform=\"cacert\" default_off='failed ruleset test'>" in document


def test_listed_urls_take_the_place_of_the_tests(spark, loaded, captures, tmp_path):
    (tmp_path / "urls").write_text("http://one.com/ \nhttp://one.com/\t\nhttp://nobody.com/\nftp://x/\n")
    listed = load_url_list(spark, str(tmp_path / "urls"))
    assert listed.count() == 3
    index = build_rule_index(loaded.corpus)
    rows = {r.url: (r.result, r.fname) for r in verdict(tested_pairs(loaded.corpus, captures, index, url_list=listed)).collect()}
    assert rows == {
        "http://one.com/": ("success", "One.xml"),
        "http://nobody.com/": ("error", None),  # no capture
        "ftp://x/": ("regex_error", None),
    }


def test_disabled_text(spark):
    files = spark.createDataFrame(
        [("a.xml", "<ruleset name='a'>\n</ruleset>"), ("b.xml", "<!-- old -->\n<ruleset name='b'>")],
        "ruleset_id string, content string",
    )
    problems = spark.createDataFrame(
        [("a.xml", "second -- problem"), ("a.xml", "first"), ("b.xml", "only"), ("gone.xml", "x")],
        "ruleset_id string, message string",
    )
    lines = disable_failing(files, problems).orderBy("part", "text").collect()
    assert len(lines) == 7
    assert {i: "\n".join(r.text for r in lines if r.ruleset_id == i) for i in ("a.xml", "b.xml")} == {
        "a.xml": "\n<!--\nDisabled by rule checker because:\nfirst\nsecond - - problem\n\n-->\n"
        "<ruleset name='a' default_off='failed ruleset test'>\n</ruleset>",
        "b.xml": "\n<!--\nDisabled by rule checker because:\nonly\n old -->\n"
        "<ruleset name='b' default_off='failed ruleset test'>",
    }


def test_json_of_equal_rows_and_no_rows(spark):
    schema = "result string, details string, fname string, url string, https_url string"
    twice = spark.createDataFrame([("error", "d", "f", "u", None)] * 2, schema)
    nothing = spark.createDataFrame([], "message string")
    from rulemesh.operators.report import json_document

    def whole(results, problems):
        lines = json_document(results, problems).orderBy("part", "section", "line", "text").collect()
        return json.loads("".join(r.text for r in lines))

    assert whole(twice, nothing) == {"coverage": [], "error": [{"details": "d", "fname": "f", "url": "u"}] * 2}
    quoted = spark.createDataFrame([('say "x"\n',)], "message string")
    assert whole(twice.limit(0), quoted) == {"coverage": ['say "x"\n']}
    assert json_lines(twice, quoted).count() == 3


def disabled(spark, content):
    files = spark.createDataFrame([("a.xml", content)], "ruleset_id string, content string")
    problems = spark.createDataFrame([("a.xml", "bad")], "ruleset_id string, message string")
    lines = disable_failing(files, problems).orderBy("part", "text").collect()
    return "\n".join(r.text for r in lines) if lines else None


@pytest.mark.parametrize("content", [
    "<ruleset\n name='x'\n>\n</ruleset>",
    "<ruleset name='a>b'></ruleset>",
    "<ruleset name = \"it's\"\tplatform='c > d'/>",
    "<!-- default_off=\"no\" <ruleset name='c' default_off='x'> -->\n<ruleset name='x'><!-- default_off='y' --></ruleset>",
    "<ruleset></ruleset>",
    "<ruleset/>",
    "﻿<?xml version='1.0' encoding='UTF-16'?>\n<!-- a --><!-- b -->\n<ruleset name='x'>\n</ruleset>",
    "<?xml version='1.0'?><!DOCTYPE ruleset [<!ENTITY e '>'>]><ruleset f='x default_off=\"1\"' name='n'></ruleset>",
    "  \n" * 5000 + "<ruleset name='x'>" + "<rule from='a' to='b'/>" * 5000 + "</ruleset>",
])
def test_disabled_files_are_disabled(spark, content):
    text = disabled(spark, content)
    root = xml.etree.ElementTree.fromstring(text.strip())
    before = xml.etree.ElementTree.fromstring(content.removeprefix("﻿").replace(" encoding='UTF-16'", "").strip())
    assert root.tag == "ruleset" and root.attrib.pop("default_off") == "failed ruleset test"
    assert root.attrib == before.attrib and len(root) == len(before)
    assert disabled(spark, text) is None  # once


@pytest.mark.parametrize("content", [
    "<ruleset name='x' default_off='why'/>", "<ruleset default_off=''></ruleset>", "<!-- c --><ruleset\n default_off = \"a 'quoted' one\"\n name='x'></ruleset>",
])
def test_switched_off_files_are_left_out(spark, content):
    assert disabled(spark, content) is None


def test_a_repeated_run_leaves_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda *n: spark.createDataFrame([(i, "x") for i in n], "n int, t string")
    append_results(rows(1, 2, 2), path, "first")
    append_results(rows(7), path, "second")
    append_results(rows(1, 2, 2), path, "first")  # tried again
    got = spark.read.parquet(path).select("run", "n").collect()
    assert sorted(map(tuple, got)) == [("first", 1), ("first", 2), ("first", 2), ("second", 7)]
