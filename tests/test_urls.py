from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from rulemesh.functions import urls

BASE = "http://a/b/c/d;p?q"


def one(spark, row: dict, expression):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expression).first()[0]


NORMAL = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x",
    "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g",
    "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y",
    "../../../g", "../../../../g", "http://other.example/x",
]


def test_absolutize_agrees_with_the_rfc_examples(spark):
    rows = spark.createDataFrame([(r,) for r in NORMAL], "ref string")
    got = {
        r.ref: r.url
        for r in rows.select(
            "ref", urls.absolutize(F.lit(BASE), F.col("ref")).alias("url")
        ).collect()
    }
    assert got == {ref: urljoin(BASE, ref) for ref in NORMAL}


@pytest.mark.parametrize(
    "ref, expected",
    [
        ("/../g", "http://a/g"),  # leading dots of an absolute path go
        ("/./g", "http://a/g"),
        ("/x/../g", "http://a/x/../g"),  # inner ones stay
        ("http://h/../../g?x#y", "http://h/g?x#y"),
        ("http://h/..", "http://h/"),
        ("http:g", "http://a/b/c/g"),  # same scheme without a host is relative
        ("//h/../g", "http://h/g"),
    ],
)
def test_absolutize_dot_segments(spark, ref, expected):
    assert one(spark, {"r": ref}, urls.absolutize(F.lit(BASE), F.col("r"))) == expected


def test_absolutize_from_an_empty_path(spark):
    assert one(spark, {"r": "g"}, urls.absolutize(F.lit("http://a"), F.col("r"))) == "http://a/g"


HOSTS = ["bücher.example", "straße.example", "ДОМ.рф", "plain.example", "a.com:80", "例え.テスト", "Upper.example"]


def test_idn_ascii_agrees_with_the_python_codec(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "h string")
    got = {r.h: r.a for r in rows.select("h", urls.idn_ascii(F.col("h")).alias("a")).collect()}
    assert got == {h: h.encode("idna").decode() for h in HOSTS}


def test_idn_ascii_gives_null_for_an_impossible_host(spark):
    assert one(spark, {"h": "a..bé"}, urls.idn_ascii(F.col("h"))) is None


def test_idn_url_touches_the_authority_only(spark):
    url = "http://bücher.example/ü?q=ß"
    assert one(spark, {"u": url}, urls.idn_url(F.col("u"))) == "http://xn--bcher-kva.example/ü?q=ß"


@pytest.mark.parametrize(
    "url, host",
    [
        ("http://A.com:8080/x", "a.com:8080"),
        ("http://User@A.com?x", "user@a.com"),
        ("https://a.com", "a.com"),
        ("mailto:x@a.com", ""),
        ("http://a.com#f/g", "a.com"),
    ],
)
def test_host_key(spark, url, host):
    assert one(spark, {"u": url}, urls.host_key(F.col("u"))) == host


@pytest.mark.parametrize(
    "url, accepted",
    [("http://a", True), ("HTTPS://a", True), ("file:///x", False), ("a.com/x", False), ("", False)],
)
def test_accepted_scheme(spark, url, accepted):
    assert one(spark, {"u": url}, urls.accepted_scheme(F.col("u"))) is accepted


def test_null_url_is_not_accepted(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS u").select(
        urls.accepted_scheme(F.col("u")), urls.scheme_error(F.col("u"))
    ).first()
    assert row[0] is False and row[1] is not None


@pytest.mark.parametrize("code, followed", [(301, True), (302, True), (303, True), (307, True), (308, False), (200, False)])
def test_is_redirect(spark, code, followed):
    assert one(spark, {"c": code}, urls.is_redirect(F.col("c"))) is followed


@pytest.mark.parametrize("code, group", [(0, 0), (199, 1), (204, 2), (404, 4)])
def test_status_class(spark, code, group):
    assert one(spark, {"c": code}, urls.status_class(F.col("c"))) == group


@pytest.mark.parametrize(
    "headers, location",
    [
        ("HTTP/1.1 301\r\nLocation: /a\r\nLOCATION: /b\r\n\r\n", "/b"),
        ("X-Location: /no\r\n", None),
        ("Location: \r\n", None),
        ("Location: /unterminated", None),
        ("Location: http://h/x: y\r\n", "http://h/x: y"),
    ],
)
def test_last_location(spark, headers, location):
    assert one(spark, {"h": headers}, urls.last_location(F.col("h"))) == location
