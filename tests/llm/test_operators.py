"""The operators, queries and pipeline stages on small tables with every odd row."""

import hashlib
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rulemesh.llm import bpe, decontaminate, fingerprint, langid, minhash, pii, queries, secrets, token_store, toxicity, warc

DRAW = random.Random(23)
SAY = {
    "en": lambda n: " ".join(DRAW.choices("the of and house river stone bright walking thought under".split(), k=n)),
    "de": lambda n: " ".join(DRAW.choices("der die und häuser flüsse steine größer gehend gedanke unter".split(), k=n)),
    "fr": lambda n: " ".join(DRAW.choices("le la et maison rivière pierre brillé marchant pensée sous".split(), k=n)),
}


def passage(n):
    return " ".join(f"{DRAW.choice('bcdfg')}{DRAW.randrange(400)}" for _ in range(n))


def edit(text, changes):
    own = text.split()
    for _ in range(changes):
        own[DRAW.randrange(len(own))] = "edited"
    return " ".join(own)


def documents():
    """doc_id, text, lang, source, n_chars, with nulls, ties, long and repeated rows."""
    rows = []
    base = [passage(60) for _ in range(4)]
    for i in range(240):
        lang = DRAW.choice(list(SAY))
        text = SAY[lang](DRAW.choice([3, 8, 40])) + f" {i}"
        if i % 6 == 0:
            text = edit(base[i % 4], DRAW.choice([0, 0, 1, 2, 3]))
        if i % 8 == 1:
            text += " you filthy rotten thing"
        if i % 9 == 2:
            text += ' mail a.b@c.org or +49 (30) 1234-567, token = "abcdefgh12" 4111 1111 1111 1111'
        rows.append((i, text, lang, "hot" if i % 3 else "s", len(text)))
    rows += [
        (500, None, None, None, None), (501, "", "en", None, 0), (502, " \n ", None, "s", 3), (503, "a", "en", "s", 1),
        (504, "123 !!", "en", "s", 6), (505, base[0] + " " + SAY["en"](20000), "en", "s", 0),
        (None, "no id at all", "en", "s", 12), (506, "Same Row", "en", "s", 8), (506, "Same Row", "en", "s", 8),
    ]
    return rows


ROWS = documents()
TEXTS = {r[0]: r[1] for r in ROWS if r[0] is not None}
ITEMS = {1: passage(25), 2: " ".join(TEXTS[0].split()[:30]), 3: "", 4: None, 5: "filthy rotten"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("rotten" in (r[1] or ""))) for r in ROWS] + [(7, None, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    body = "<p>" + "é" * 60 + "</p>"
    pages = [(i, f"http://h{i % 3}.org/{i % 2}", body if i % 2 else f"<p>{i}</p>") for i in range(40)]
    pages += [(90, None, None), (91, "x\r\ny", ""), (92, "http://a/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (None, "http://a/", body), (92, "http://a/", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return str(path), pages


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder[0]}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.doc_id, []).append(row)
    assert sum(map(len, out.values())) == len(ROWS)
    assert {k: len(v) for k, v in out.items()} == {k: sum(r[0] == k for r in ROWS) for k in {r[0] for r in ROWS}}
    return {k: v[0] for k, v in out.items() if k is not None}


def test_decontamination(spark, folder):
    got = by_id(queries.op1_decontamination(spark, folder[0]))
    items = {k: v or "" for k, v in ITEMS.items()}
    for doc, row in got.items():
        expected = plain.leaks(TEXTS[doc], items)
        assert sorted(row.item_ids) == sorted(expected) and row.contaminated == bool(expected)
        assert row.similarity == pytest.approx(max(expected.values())) if expected else row.similarity is None


def test_items_in_blocks(spark, folder, docs):
    items = spark.read.parquet(f"{folder[0]}/benchmark.parquet")
    whole = decontaminate.matches(docs, items).select("doc_id", "leaks")
    blocks = decontaminate.matches(docs, items, block_bytes=80).select("doc_id", "leaks")
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_fingerprints(spark, docs):
    rows = fingerprint.with_next(docs, 5).collect()
    assert len(rows) == len(ROWS)
    order = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in ROWS), key=lambda r: (-r[0], r[1]))
    successor = {a: b[1] for a, b in zip(order, order[1:] + order[:1])}
    fingerprints = {}
    for row in rows:
        text = TEXTS.get(row.doc_id, "no id at all") or ""
        following = successor[(row.doc_id if row.doc_id is not None else -1, text)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert row.n_chars == len(text)
        if row.doc_id != 506:  # of two equal rows each may come first
            assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert fingerprints.setdefault(text, row.fingerprint) == row.fingerprint
        assert fingerprints.setdefault(changed, row.edited_fingerprint) == row.edited_fingerprint or row.doc_id == 506


def test_fingerprints_need_no_shared_shuffle(spark):
    docs = spark.range(3000).selectExpr("(id * 7919) % 3000 AS doc_id", "CONCAT('text ', id) AS text").repartition(9)
    docs = docs.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'none' AS text"))
    for reuse, adaptive in (("true", "true"), ("false", "true"), ("false", "false")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            rows = fingerprint.with_next(docs, 40).collect()
        finally:
            spark.conf.set("spark.sql.exchange.reuse", "true")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        texts = {r.doc_id: r.text for r in docs.collect()}
        order = [*sorted((i for i in texts if i is not None), reverse=True), None]
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in order)
        following = dict(zip(order, [*order[1:], order[0]], strict=True))
        for row in rows:
            expected = fingerprint.edited(texts[row.doc_id].encode(), texts[following[row.doc_id]].encode())[1]
            assert row.edited_sha256 == hashlib.sha256(expected).hexdigest()


@pytest.mark.parametrize("bounds", [[], [5], [1, 2], list(range(10, 400, 7))])
def test_range_of_ids(spark, bounds):
    ids = [None, -1, *range(0, 420)]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.part for r in frame.select("doc_id", fingerprint.range_of(F.col("doc_id"), bounds).alias("part")).collect()}
    assert got == {i: len(bounds) if i is None else sum(b > i for b in bounds) for i in ids}


def test_fingerprint_of_one_text_and_none(spark, nothing):
    (row,) = fingerprint.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.with_next(nothing).count() == 0


def test_web_archive(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)  # several runs
    rows = queries.op3_web_archive(spark, folder[0]).collect()
    pages = folder[1]
    assert sorted(str(r.page_id) for r in rows) == sorted(str(p[0]) for p in pages)
    first = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    contents = {p[0]: p[2] or "" for p in pages}
    for row in rows:
        html = contents[row.page_id]
        response = first.get(html, row.page_id)
        assert row.payload_bytes == len(html.encode()) and row.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert row.record_type == ("response" if response == row.page_id else "revisit")
        assert row.refers_to == (None if response == row.page_id else response)
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(rows)))
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in ordered]
    assert keys == sorted(keys)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(empty).count() == 0


def test_near_duplicates(spark, folder, nothing):
    got = by_id(queries.op4_near_duplicates(spark, folder[0]))
    expected = plain.components(TEXTS)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == expected
    assert all(r.kept == (k == expected[k][1]) for k, r in got.items())
    assert minhash.near_duplicates(nothing).count() == 0


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark, folder, nothing):
    got = by_id(queries.op5_language(spark, folder[0]))
    held_out = {k for k in got if zlib.crc32(str(k).encode()) % 4 == 2}
    assert {k for k, r in got.items() if r.held_out} == held_out
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {500, 501, 502, 504}
    prose = [r for r in ROWS if r[0] in held_out and r[0] < 240 and r[0] % 6]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in prose]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    model = langid.fit(nothing, ~langid.held_out())
    assert model.languages == []
    one = langid.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_toxicity(spark, folder, docs, nothing):
    got = by_id(queries.op6_toxicity(spark, folder[0]))
    assert {k for k, r in got.items() if r.held_out} == {k for k in got if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([got[k].predicted == int("rotten" in (t or "")) for k, t in TEXTS.items()]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    unlearnt = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs.select("doc_id", "text"), unlearnt).collect()} == {0.5}
    assert toxicity.score(nothing, unlearnt).count() == 0


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe(spark, folder, docs):
    for doc, row in by_id(queries.op7_bpe(spark, folder[0])).items():
        ids = ids_of(TEXTS[doc])
        decoded = TOKENIZER.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER)
    for row in encoded.collect():
        assert row.ids == ids_of(row.text) and row.decoded == TOKENIZER.decode(row.ids, skip_special_tokens=False)


def test_personal_data_and_secrets(spark, folder):
    for query, rules, order in (
        (queries.op8_personal_data, plain.PERSONAL, pii.BASE), (queries.op9_secrets, plain.SECRETS, secrets.BASE),
    ):
        for doc, row in by_id(query(spark, folder[0])).items():
            base = plain.spans(TEXTS[doc] or "", rules, order)
            assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [row[f"n_{k}"] for k in order] == [sum(x.startswith(k + ":") for x in base) for k in order]
            assert set(base) <= set(row.spans.split(","))


def test_token_store(spark, docs, nothing, tmp_path):
    path = str(tmp_path / "tokens")
    token_store.write(docs, path, queries.TOKENIZER, 2, files=4)
    rows = sorted(token_store.summary(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in rows] == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    place = 0
    for row in rows:
        ids = [*ids_of(TEXTS.get(row.doc_id, "no id at all")), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (place, len(ids), zlib.crc32(as_bytes(ids)))
        place += len(ids)
    some = token_store.read_range(spark, path, 10, 20)
    assert sorted(r.doc_id for r in some.collect()) == list(range(10, 21))
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ids:array" not in plan.split("ReadSchema")[-1]
    token_store.write(nothing, str(tmp_path / "none"), queries.TOKENIZER, 2)
    assert token_store.summary(spark, str(tmp_path / "none")).count() == 0


CLASHING = ["ids", "score", "predicted", "leaks", "redacted", "toxicity", "rejected", "n_tokens", "_toxic", "bands", "kept", "component_id"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_keep_columns_and_bear_odd_tables(spark, folder, docs, nothing, stage):
    name, run = stage
    more = docs.filter("doc_id is null or doc_id < 60 or doc_id >= 500").withColumns({c: F.lit("kept") for c in CLASHING})
    out = run(spark, more, folder[0])
    rows = out.collect()
    if name == "bpe":
        assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and len(rows) == more.count()
    else:
        assert out.columns == more.columns and {r.score for r in rows} == {"kept"}
        assert run(spark, nothing, folder[0]).columns == nothing.columns
    assert run(spark, nothing, folder[0]).count() == 0


def test_pipeline(spark, folder):
    """Against the plain versions; the classifier's rejections are its own."""
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet")
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    clean = [r for r in toxicity.keep_clean(docs, labels).collect() if r.doc_id is not None]
    assert not [r for r in clean if "rotten" in (r.text or "")] and len(clean) >= 200
    left = {r.doc_id: r.text for r in clean}
    found = plain.components(left)
    left = {k: t for k, t in left.items() if found[k][1] == k}
    left = {k: t for k, t in left.items() if not plain.leaks(t, {i: x or "" for i, x in ITEMS.items()})}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder[0]).collect() if r.doc_id is not None}
    assert set(got) == set(left)
    anchors = pii.anchors()
    for doc, row in got.items():
        text = pii.redacted(left[doc] or "", pii.find_in(left[doc] or "", anchors))
        assert "@" not in text and row.ids == ids_of(text)
        assert row.ids_sha256 == hashlib.sha256(as_bytes(row.ids)).hexdigest()


@pytest.mark.parametrize("dense", [0, 10**9])
def test_group_of_near_copies_in_blocks_and_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(minhash, "DENSE_PAIRS", dense)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    base = passage(50)
    texts = {i: edit(base, DRAW.choice([1, 1, 2, 3])) for i in range(90)} | {i: passage(30) for i in range(90, 110)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows).collect()}
    expected = plain.components(texts)
    assert got == expected
    assert 3 < len({c for _, c in expected.values()}) < 100


@pytest.mark.parametrize("dense", [0, 10**9])
def test_different_texts_under_one_id(spark, monkeypatch, dense):
    """A near copy goes without the other texts of its id, and every text's links count."""
    monkeypatch.setattr(minhash, "DENSE_PAIRS", dense)
    base, second, alone = passage(60), passage(60), passage(60)
    copies = [edit(base, 1) for _ in range(12)]
    rows = [(3, base), (5, copies[0]), (5, alone), (5, alone), (5, second), (7, edit(second, 1)), (8, passage(40)), (None, base)]
    rows += [(20, x) for x in copies[1:]] + [(20, passage(50)), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [x for x in rows if x[1] not in copies and x != (7, rows[5][1])]
    assert sorted(map(str, minhash.keep_one(docs).collect())) == sorted(map(str, spark.createDataFrame(left, docs.schema).collect()))
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == sorted([(3, 3), (5, 3), *[(5, 5)] * 3, (7, 5), (8, 8), *[(20, 3)] * 11, *[(20, 20)] * 2])
