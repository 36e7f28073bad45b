import random

import pytest

from rulemesh.functions.errors import ERROR_CLASSES, error_category
from rulemesh.functions.markup import outline_distance, page_outline
from rulemesh.operators.compare import big_distance, page_distance, verdict
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "html, outline",
    [
        ("<html><head><title>x</title></head><body><p>a</p></body></html>",
         "html ( head ( title ) body ( p ) )"),
        ("<p>a<br>b</p>", "html ( body ( p ( br ) ) )"),
        ("<ul><li>a<li>b</ul>", "html ( body ( ul ( li li ) ) )"),
        ("<p>a<p>b", "html ( body ( p p ) )"),
        ("<!-- c --><title>t</title><div><!-- <b> --><script>'<i>'</script></div>",
         "html ( head ( title ) body ( div ( script ) ) )"),
        ("<table><tr><td>1<td>2<tr><td>3</table>",
         "html ( body ( table ( tr ( td td ) tr ( td ) ) ) )"),
        ("<div/><span></span></b>", "html ( body ( div span ) )"),
        ("only text", None),
        ("", None),
        (None, None),
    ],
)
def test_outline(html, outline):
    assert page_outline(html) == outline


def test_deep_page():
    assert page_outline("<div>" * 3000).count("div") == 3000


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_distance_against_the_plain_recurrence():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abc()") for _ in range(rng.randint(1, 90))]
        b = [rng.choice("abc()") for _ in range(rng.randint(1, 90))]
        expected = 1 - 2 * slow_lcs(a, b) / (len(a) + len(b))
        assert outline_distance(" ".join(a), " ".join(b)) == pytest.approx(expected, abs=1e-12)


def test_substitution_costs_two():
    # one of three tokens differs: 1 - 2*2/6, not 1 - 2/3 by edit distance over length
    assert outline_distance("a b c", "a x c") == pytest.approx(1 / 3)


PAGES = {
    "p": "<p>one two three four five</p>",
    "same": "<p>one two three four five</p>",
    "shape": "<p>six seven</p>",
    "other": "<div><p>one two three four five</p></div>",
    "empty": "",
    "text": "no markup here",
}


def distances(spark, metric, pairs):
    pages = spark.createDataFrame(list(PAGES.items()), "url string, body string")
    frame = spark.createDataFrame(pairs, "left_url string, right_url string")
    got = page_distance(metric, frame, pages)
    return {(r.left_url, r.right_url): r.distance for r in got.collect()}


def test_markup_distance(spark):
    pairs = [("p", "same"), ("p", "shape"), ("p", "other"), ("p", "empty"), ("empty", "empty"), ("text", "p")]
    got = distances(spark, "markup", pairs)
    # html ( body ( p ) ) against html ( body ( div ( p ) ) ): 7 of 7 and 10 tokens
    assert got == {
        ("p", "same"): 0.0,
        ("p", "shape"): 0.0,
        ("p", "other"): pytest.approx(1 - 14 / 17),
        ("p", "empty"): 1.0,
        ("empty", "empty"): 0.0,
        ("text", "p"): 1.0,
    }


def test_novelty_distance(spark):
    got = distances(spark, "bsdiff", [("p", "same"), ("p", "other"), ("p", "shape"), ("shape", "p"), ("empty", "empty")])
    assert got["p", "same"] == 0.0 and got["empty", "empty"] == 0.0
    assert got["p", "shape"] == got["shape", "p"] == 1.0
    assert got["p", "other"] == 1.0  # both runs of four words hold a tag
    assert distances(spark, "bsdiff", [("text", "p")])["text", "p"] == 1.0


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        page_distance("other", None, None)


def test_threshold_is_inclusive(spark):
    rows = [("a", 10, 0.1), ("b", 10, 0.0999), ("c", 0, 1.0)]
    frame = spark.createDataFrame(rows, "id string, left_length int, distance double")
    assert [r.id for r in big_distance(frame, 0.1).collect()] == ["a"]


def test_verdicts(spark):
    rows = [
        ("lost", 200, 404, None, None),
        ("both lost", 404, 404, None, None),
        ("plain failed", None, 404, None, None),
        ("failed", 200, None, "connection refused", None),
        ("bad rule", None, None, None, "template names a missing group x"),
        ("fine", 204, 200, None, None),
        ("moved", 200, 308, None, None),
    ]
    frame = spark.createDataFrame(
        rows, "url string, plain_code int, new_code int, new_error string, regex_error string"
    ).select("*", F.lit("f.xml").alias("ruleset_id"), F.concat(F.lit("https:"), "url").alias("new_url"))
    got = {r.url: r for r in verdict(frame).collect()}
    assert {u: (r.result, r.details, r.https_url, r.returned) for u, r in got.items()} == {
        "lost": ("error", "non-2xx http code", "https:lost", True),
        "both lost": ("success", "", None, False),
        "plain failed": ("success", "", None, False),
        "failed": ("error", "fetch-error connection refused", "https:failed", True),
        "bad rule": ("regex_error", "template names a missing group x", None, False),
        "fine": ("success", "", None, False),
        "moved": ("error", "non-2xx http code", "https:moved", True),
    }
    assert got["lost"].message == "Non-2xx HTTP code: lost (200) => https:lost (404)"
    assert got["failed"].message == "Fetch error: failed => https:failed: connection refused"


def test_error_classes(spark):
    texts = [
        ("Resolving timed out after 1 ms", "Resolving timeout"),
        ("x does not match target host name 'y' ... SSL: certificate subject name", "ssl: certificate subject mismatch"),
        ("Failed to connect to 1.2.3.4: Connection refused", "connection refused"),
        ("gnutls_handshake() failed: Error in the pull function.", "gnutls: handshake fail in pull"),
        ("Empty reply from server", "empty reply"),
        ("Could not resolve host; Empty reply from server", "Could not resolve host"),
        ("strange", "Fetcher subprocess error: short\nstrange"),
    ]
    frame = spark.createDataFrame(texts, "full string, expected string")
    got = frame.select("expected", error_category(F.lit("short"), F.col("full")).alias("got")).collect()
    assert all(r.got == r.expected for r in got)
    assert len(ERROR_CLASSES) == 16
