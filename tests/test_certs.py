import base64
import hashlib
import random

import pytest

from rulemesh.operators import certs
from rulemesh.operators.certs import _bucketed, trusted_closure, unique_certs
from rulemesh.sources.certs import load_certs, with_digest


def pem(data: bytes) -> str:
    body = base64.encodebytes(data).decode()
    return f"-----BEGIN CERTIFICATE-----\n{body}-----END CERTIFICATE-----\n"


def test_certificate_files(spark, tmp_path):
    files = {"b.pem": pem(b"x" * 100), "a.pem": pem(b"x" * 100), "c.pem": pem(b"y"), "bad.pem": "junk",
             "link.pem": pem(b"z"), "notes.txt": pem(b"n")}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    links = load_certs(spark, str(tmp_path)).filter("path LIKE '%link.pem'").select("path")
    certs = with_digest(load_certs(spark, str(tmp_path), links))
    rows = {r.path.rsplit("/", 1)[1]: r for r in certs.collect()}
    assert set(rows) == set(files) - {"notes.txt"}
    assert rows["a.pem"].der_sha256 == hashlib.sha256(b"x" * 100).hexdigest()
    assert rows["bad.pem"].der_sha256 is None and rows["bad.pem"].error
    unique = {r.path.rsplit("/", 1)[1] for r in unique_certs(certs).collect()}
    assert unique == {"a.pem", "c.pem"}  # first name per digest, links skipped
    taken = certs.filter("path LIKE '%c.pem' OR path LIKE '%link.pem'")
    assert [r.path.rsplit("/", 1)[1] for r in unique_certs(certs, taken).collect()] == ["a.pem"]


def test_closure_stops_and_survives_cycles(spark):
    edges = [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("c", "c"), ("a", "refused"), ("refused", "under")]
    issues = spark.createDataFrame(edges, "issuer_sha256 string, subject_sha256 string")
    roots = spark.createDataFrame([("r",)], "der_sha256 string")
    candidates = spark.createDataFrame(
        [(n,) for n in "a b c x y under".split()], "der_sha256 string"
    )
    got = {(r.der_sha256, r.round) for r in trusted_closure(roots, candidates, issues).collect()}
    assert got == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}


def test_closure_below_one_large_issuer(spark):
    edges = [("r", f"s{i}") for i in range(200)] + [("s7", "t")]
    issues = spark.createDataFrame(edges, "issuer_sha256 string, subject_sha256 string")
    roots = spark.createDataFrame([("r",)], "der_sha256 string")
    candidates = issues.selectExpr("subject_sha256 AS der_sha256")
    assert trusted_closure(roots, candidates, issues, hot_rows=10).count() == 202


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_closure_of_random_graphs(spark, hot_rows):
    draw = random.Random(hot_rows)
    nodes = [f"n{i}" for i in range(120)]
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(150)] + [("n0", n) for n in nodes[::4]]
    edges += [(None, "n1"), ("n1", None), ("n2", "n2")] * 2
    allowed = set(draw.sample(nodes, 100))
    expected, frontier, step = {"n0": 0, "n1": 0}, {"n0", "n1"}, 0
    while frontier:
        step += 1
        frontier = {b for a, b in edges if a in frontier and b in allowed and b not in expected}
        expected.update(dict.fromkeys(frontier, step))
    issues = spark.createDataFrame(edges, "issuer_sha256 string, subject_sha256 string")
    roots = spark.createDataFrame([("n0",), ("n1",), ("n0",)], "der_sha256 string")
    candidates = spark.createDataFrame([(n,) for n in sorted(allowed)] * 2, "der_sha256 string")
    tables = len(spark.catalog.listTables())
    got = [(r.der_sha256, r["round"]) for r in trusted_closure(roots, candidates, issues, hot_rows).collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert len(spark.catalog.listTables()) == tables
    assert trusted_closure(roots.limit(0), candidates, issues).count() == 0


def test_edges_do_not_move_in_a_round(spark):
    issues = spark.range(2000).selectExpr("CAST(id % 50 AS STRING) AS issuer_sha256", "CAST(id % 2 AS INT) AS part", "CAST(id AS STRING) AS subject_sha256")
    edges, name, rows = _bucketed(issues, 6, "issuer_sha256", "part")
    frontier = spark.range(9).selectExpr("CAST(id AS STRING) AS issuer_sha256", "CAST(id % 2 AS INT) AS part").hint("merge")
    joined = edges.join(frontier, ["issuer_sha256", "part"], "left_semi")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert (rows, joined.count()) == (2000, 9 * 40)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the frontier alone
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("sent_bytes, hot_rows", [(0, 10**6), (0, 8), (2000, 8), (10**6, 8)])
def test_used_edges_are_not_dealt_out(spark, monkeypatch, sent_bytes, hot_rows):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    pairs = [("r", f"s{i}") for i in range(20)] + [(f"s{i}", f"t{i * 7 + j}") for i in range(20) for j in range(9)]
    pairs += [(f"t{i}", f"u{i % 11}") for i in range(140)] + [("u3", "v"), ("v", "r"), ("u3", "no"), ("no", "below")]
    issues = spark.createDataFrame([(digest(a), digest(b)) for a, b in pairs], "issuer_sha256 string, subject_sha256 string")
    nodes = sorted({b for _, b in pairs} - {"no"})
    candidates = spark.createDataFrame([(digest(n),) for n in nodes], "der_sha256 string")
    roots = spark.createDataFrame([(digest("r"),)], "der_sha256 string")
    written = []

    def recorded(table, *args, **options):
        found = _bucketed(table, *args, **options)
        if "issuer_sha256" in found[0].columns:
            written.append(found[2])
        return found

    monkeypatch.setattr(certs, "_bucketed", recorded)
    monkeypatch.setattr(certs, "SENT_BYTES", sent_bytes, raising=False)
    got = [(r.der_sha256, r["round"]) for r in trusted_closure(roots, candidates, issues, hot_rows).collect()]
    rounds = {"r": 0, "s": 1, "t": 2, "u": 3, "v": 4}
    assert sorted(got) == sorted((digest(n), rounds[n[0]]) for n in {*nodes, "r"} - {"below"})
    # dealt out before the first round that does not fit, without the edges of those before it
    times = 2 if hot_rows == 8 else 1  # with large issuers, once more by their parts
    assert written == {0: [len(pairs)] * times, 2000: [len(pairs) - 200], 10**6: []}[sent_bytes]


@pytest.mark.parametrize("sent_bytes", [0, 10**6])
def test_any_text_is_a_digest(spark, monkeypatch, sent_bytes):
    monkeypatch.setattr(certs, "SENT_BYTES", sent_bytes, raising=False)
    low = "0a" * 32
    nodes = [low, low.upper(), low[:-1] + "\n", low + "\n", bytes.fromhex(low).decode(), "", "\x00" * 33, "é" * 32, "x"]
    issues = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "issuer_sha256 string, subject_sha256 string")
    roots = spark.createDataFrame([(low,), (None,)], "der_sha256 string")
    candidates = spark.createDataFrame([(n,) for n in nodes], "der_sha256 string")
    got = {r.der_sha256: r["round"] for r in trusted_closure(roots, candidates, issues).collect()}
    assert got == {**{n: i for i, n in enumerate(nodes)}, None: 0}
