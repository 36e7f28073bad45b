"""Token counts behind a cache, spelling variants and ranked search, against plain versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rulemesh.llm import queries, ranked, token_counts, variants
from rulemesh.llm.common import text_slices

DRAW = random.Random(31)
WORDS = [
    "".join(DRAW.choices("abcdeé", k=DRAW.choice([6, 7, 8, 11]))) for _ in range(40)
] + ["strasse", "straßse", "aaaaaaa", "aaaaaa", "aaaaaaaa", "×÷×÷×÷", "NAÏVEté", "Naïveté"]


def varied(word):
    at = DRAW.randrange(len(word) + 1)
    return DRAW.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "y" + word[at + 1 :], word])


def text(n):
    said = [varied(w) if DRAW.random() < 0.2 else w for w in DRAW.choices(WORDS, k=n)]
    return "".join(w + DRAW.choice([" ", ", ", "\n", "_", "7", " 中 ", "Ā"]) for w in said)


ROWS = [(i, text(DRAW.choice([0, 3, 30, 90]))) for i in range(160)]
ROWS += [(200, None), (201, ""), (202, " \n"), (203, "x" * 5000 + " " + "aaaaaaa " * 3000), (204, "one <|endoftext|> two")]
ROWS += [(None, "aaaaaaa strasse"), (205, ROWS[3][1]), (205, ROWS[3][1]), (206, ROWS[3][1]), (207, "aaaaaaa"), (208, "aaaaaaa")]
ITEMS = [(1, text(9)), (2, "aaaaaaa AAAAAAA strasse"), (3, None), (4, ""), (5, "nowhere found"), (6, "中 Ā 7"), (6, "中 Ā 7"), (7, text(60))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).cache()


def by_row(rows):
    return sorted(rows, key=str)


# Token counts


def library_counts(path):
    tokenizer = Tokenizer.from_file(path)
    return [
        (i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS
    ]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_token_counts_equal_the_library(spark, docs, tmp_path, limit):
    got = token_counts.count_tokens(docs, queries.BYTE_TOKENIZER, f"file://{tmp_path}/cache", broadcast_bytes=limit)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert by_row(map(tuple, got.collect())) == by_row(library_counts(queries.BYTE_TOKENIZER))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_only_missing_contents_are_encoded(spark, docs, tmp_path, limit):
    cache = f"file://{tmp_path}/cache"
    folder = token_counts.cache_folder(cache, queries.BYTE_TOKENIZER)
    first = docs.filter("doc_id < 100")
    token_counts.count_tokens(first, queries.BYTE_TOKENIZER, cache, broadcast_bytes=limit)
    had = spark.read.parquet(folder).count()
    assert had == first.selectExpr("coalesce(text, '')").distinct().count()
    # What the cache says is believed, not counted again.
    seen = ROWS[3][1]
    got = token_counts.count_tokens(docs, queries.BYTE_TOKENIZER, cache, broadcast_bytes=limit)
    assert by_row(map(tuple, got.collect())) == by_row(library_counts(queries.BYTE_TOKENIZER))
    all_rows = spark.read.parquet(folder)
    assert all_rows.count() == all_rows.select("digest").distinct().count()
    assert all_rows.count() == docs.selectExpr("coalesce(text, '')").distinct().count()
    token_counts.count_tokens(docs, queries.BYTE_TOKENIZER, cache, broadcast_bytes=limit)
    assert spark.read.parquet(folder).count() == all_rows.count()
    assert seen is not None


def test_a_stored_count_is_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    folder = token_counts.cache_folder(cache, queries.BYTE_TOKENIZER)
    stored = spark.sql("SELECT unhex(sha2('known', 256)) AS digest, 77L AS n_tokens")
    stored.union(stored).write.parquet(folder)  # appended by two runs
    docs = spark.createDataFrame([(1, "known"), (2, "known"), (3, "other")], "doc_id long, text string")
    got = token_counts.count_tokens(docs, queries.BYTE_TOKENIZER, cache)
    assert by_row((r.doc_id, r.n_tokens) for r in got.collect()) == [(1, 77), (2, 77), (3, 1)]


def test_token_counts_of_versions_columns_and_empty_tables(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.version(piece) != token_counts.version(queries.BYTE_TOKENIZER)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece)
    got = token_counts.count_tokens(docs, piece, cache)
    assert by_row((r.doc_id, r.n_tokens) for r in got.collect()) == by_row((i, len(model.encode(t or ""))) for i, t in ROWS)
    odd = docs.selectExpr("doc_id", "text", "'d' AS digest", "'x' AS N_TOKENS", "1 AS n", "'k' AS `a.b`")
    got = token_counts.count_tokens(odd, queries.BYTE_TOKENIZER, cache)
    assert got.columns == ["doc_id", "digest", "n", "a.b", "n_bytes", "n_tokens"]
    assert got.filter("digest = 'd' AND n = 1").count() == len(ROWS)
    assert token_counts.count_tokens(docs.limit(0), queries.BYTE_TOKENIZER, cache).count() == 0


def test_pieces_of_long_texts_count_alike():
    count = token_counts.counter(token_counts.tokenizer_file(queries.BYTE_TOKENIZER), "tokenizers")
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    kinds = ["it's ", "a  b ", "9 ", "é ", "\n\n x ", "don't. ", "<|endoftext|> ", " \t ", "word", "!? "]
    for size in (1, 7, 40):
        for _ in range(200):
            said = "".join(DRAW.choices(kinds, k=60))
            parts = token_counts.pieces(said, size)
            assert "".join(parts) == said
            assert sum(len(tokenizer.encode(p).ids) for p in parts) == len(tokenizer.encode(said).ids)
    long = "".join(DRAW.choices(kinds, k=120_000))
    assert len(token_counts.pieces(long)) > 1
    assert count([long, "", "a b"]) == [len(tokenizer.encode(long).ids), 0, 2]
    assert token_counts.pieces("x" * 50, 10) == ["x" * 50]


KINDS = [
    "'", "s", "ll", "'re", "The", " word", "é", "ß", "日", "я", "ם", "क", "ि", "\u0301", "ª", "7", "²", "½", "٣", "“", "…", "×", "😀", "!?", "_",
    " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\x00", "<|", "<|endoftext|>", "x" * 300,
]


@pytest.mark.parametrize("most_bytes", [0, 2000, 1 << 20])
def test_counts_by_words_equal_the_library(monkeypatch, most_bytes):
    monkeypatch.setattr(token_counts.WordCounts.__init__, "__defaults__", (most_bytes,))
    count = token_counts.counter(token_counts.tokenizer_file(queries.BYTE_TOKENIZER), "tokenizers")
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    said = ["".join(DRAW.choices(KINDS, k=DRAW.randint(0, 30))) for _ in range(1500)]
    said += [f"ab{chr(c)}cd {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x3100)]
    assert count(said) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in said]


def test_known_words_are_not_encoded_again():
    words = token_counts.WordCounts(Tokenizer.from_file(queries.BYTE_TOKENIZER))
    said = " several words, più parole \u0301 and “more”"
    first = words.count(said)
    words.model = words.tokenizer = None  # a second look would fail
    assert words.count(said * 3) == 3 * first and words.bytes < 5000
    bounded = token_counts.WordCounts(Tokenizer.from_file(queries.BYTE_TOKENIZER), 20_000)
    bounded.count(" ".join(map(str, range(5000))))
    assert len(bounded) + len(bounded.older) < 200


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lowered(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def plain_counts(rows):
    counts = Counter()
    for doc, said in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", said or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def plain_groups(rows):
    n = {w: k for w, k in plain_counts(rows).items() if k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("max_list", [1, 512])
def test_variants_equal_the_plain_version(docs, max_list):
    got = variants.group(docs, max_list=max_list).collect()
    expected = plain_groups(ROWS)
    assert by_row(map(tuple, got)) == by_row(expected)
    assert any(form for _, form, *_ in expected) and any(near > 1 for *_, near, _ in expected)


def test_forms_follow_one_another_to_the_root(spark):
    words = [("chainaa", 1000), ("chainab", 200), ("chainbb", 40), ("chaincb", 8), ("chaincc", 7), ("aloneword", 9)]
    table = spark.createDataFrame(words, "word string, n long")
    formed = variants.forms(table, variants.near_words(table))
    assert {r.word: r.root for r in variants.roots(formed).collect()} == {
        "chainab": "chainaa", "chainbb": "chainaa", "chaincb": "chainaa",
    }
    tied = spark.createDataFrame([("abcdeg", 50), ("abcdef", 50), ("abcdeh", 5)], "word string, n long")
    row = variants.forms(tied, variants.near_words(tied)).filter("word = 'abcdeh'").first()
    assert (row.form, row.form_n, row.n_near) == ("abcdef", 50, 2)


def test_scan_equals_all_pairs():
    for alphabet, lengths in (("ab", (6, 7, 8)), ("abcé", (6, 9)), ("a", range(6, 40))):
        words = sorted({"".join(DRAW.choices(alphabet, k=DRAW.choice(list(lengths)))) for _ in range(120)})
        both = words + sorted(words[::2])  # two lists
        raw = [w.encode("latin-1") for w in both]
        length = np.array([len(x) for x in raw])
        begins = np.zeros(len(both), bool)
        begins[[0, len(words)]] = True
        own, near = variants.scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length, begins)
        got = sorted(zip(own.tolist(), near.tolist(), strict=True))
        cut = len(words)
        expected = [
            (i, j) for i, j in itertools.permutations(range(len(both)), 2)
            if (i < cut) == (j < cut) and one_edit(both[i], both[j])
        ]
        assert got == expected


def test_long_lists_are_parted(spark):
    words = ["common" + "".join(p) for p in itertools.product("abcd", repeat=4)] + ["x" * 300, "x" * 299, "x" * 299 + "y"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    parted = variants.lists(table, max_list=20)
    open_points = parted.selectExpr("shorter - left - right AS o", "key").groupBy("key", "o").count()
    assert open_points.filter("count > 20 AND o > 1").count() == 0
    got = {(r.word, r.near) for r in variants.near_words(table, max_list=20).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}


def test_crc_is_the_library_s():
    data = np.frombuffer("straße:wörter und mehr".encode() * 3, np.uint8)
    start = np.array([0, 5, 9, 0, 4])
    end = np.array([3, 30, 9, len(data), 11])
    before = np.array([zlib.crc32(x) for x in (b"", b"12:", b"7:", b"", b"x")], np.uint32)
    got = variants.crc32_of(data, start, end, before)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert len(variants.crc32_of(data, start[:0], end[:0], before[:0])) == 0


def test_variants_of_odd_tables(spark, docs):
    assert variants.group(docs.limit(0)).count() == 0
    assert variants.group(docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text")).count() == 0
    odd = docs.selectExpr("doc_id", "text", "'w' AS word", "2 AS n", "'k' AS key", "'r' AS root")
    assert by_row(map(tuple, variants.group(odd).collect())) == by_row(plain_groups(ROWS))
    rare = spark.createDataFrame([(1, "abcdefg abcdefh")], "doc_id long, text string")
    assert variants.group(rare).count() == 0
    assert {tuple(r)[0] for r in variants.group(rare, min_count=1).collect()} <= {"abcdefg", "abcdefh"}


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(said):
    return [lowered(t) for t in TERM.findall(said or "")]


def plain_search(rows, items, top=20):
    docs = [(i, Counter(terms_of(t))) for i, t in rows if terms_of(t)]
    n, words = len(docs), sum(sum(c.values()) for _, c in docs)
    held = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in held.items()}
    out = []
    for item, said in dict.fromkeys(items):
        asked, scored = Counter(terms_of(said)), []
        for doc, counts in docs:
            m = 75 + 25 * sum(counts.values()) * n // words
            score = sum(
                k * weight[t] * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
                for t, k in asked.items() if counts[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if null else doc, -score))
    return out


@pytest.mark.parametrize("block_bytes", [600, 8 << 20])
def test_search_equals_the_plain_version(spark, docs, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked.search(docs, items, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    expected = plain_search(ROWS, ITEMS)
    assert by_row(map(tuple, got.collect())) == by_row(expected)
    scores = Counter(x[3] for x in expected if x[0] == 2)
    assert max(scores.values()) > 1  # ties


def test_search_in_odd_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS rank", "'t' AS terms", "0 AS length")
    named = items.selectExpr("CAST(item_id AS STRING) AS item_id", "text", "'q' AS query", "'t' AS term", "9 AS times")
    got = ranked.search(clash, named).collect()
    assert by_row((int(r[0]), *r[1:]) for r in got) == by_row(plain_search(ROWS, ITEMS))


def test_shards_skip_without_loss():
    """Short and long lists, thresholds that carry over, shards of every size."""
    draw = np.random.default_rng(5)
    rows = 9000
    share = np.array([0.9, 0.5, 0.3, 0.1, 0.01, 0.005, 0.0005])
    cells = draw.random((rows, len(share))) < share
    lists = [np.flatnonzero(x).astype(np.int32) for x in cells]
    table = pa.table({
        "doc_id": pa.array(draw.permutation(rows)), "length": pa.array(draw.integers(1, 400, rows)),
        "terms": pa.array(lists, pa.list_(pa.int32())),
        "times": pa.array([draw.integers(1, 6, len(x)).astype(np.int32) for x in lists], pa.list_(pa.int32())),
    })
    words = int(table.column("length").to_numpy().sum())
    weights = np.array([ranked.weight(rows, int(n)) for n in cells.sum(axis=0)], np.int64)
    asked, times = np.arange(len(share)), np.array([1, 2, 1, 1, 1, 3, 1])
    m = ranked.length_share(table.column("length").to_numpy(), rows, words)
    scores = np.zeros(rows, np.int64)
    for i, (terms, tf) in enumerate(zip(table.column("terms").to_pylist(), table.column("times").to_pylist(), strict=True)):
        scores[i] = sum(int(times[t]) * int(weights[t]) * (10**9 * k // (1000 * k + 12 * int(m[i]))) for t, k in zip(terms, tf, strict=True))
    doc = table.column("doc_id").to_numpy()
    expected = sorted(zip((-scores).tolist(), doc.tolist(), strict=True))[: ranked.TOP]
    for size in (1, 700, 4096, rows):
        best = ranked.Best()
        for low in range(0, rows, size):
            if size > 1 or low < 50:
                ranked.Shard(table.slice(low, size), weights, rows, words).search(asked, times, best)
        if size > 1:
            assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == expected


def test_shards_hold_all_rows(monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_DOCUMENTS", 7)
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 20)
    sizes = [0, 3, 50, 1, 1, 0, 0, 25, 20, 2, *[0] * 30, 19, 2]
    lists = [list(range(n)) for n in sizes]
    whole = pa.table({"row": pa.array(range(len(sizes))), "terms": pa.array(lists, pa.list_(pa.int32()))})
    for chunk in (1, 4, 100):
        shards = list(ranked._shards(iter(whole.to_batches(max_chunksize=chunk))))
        assert [i for s in shards for i in s.column("row").to_pylist()] == list(range(len(sizes)))
        for s in shards:
            assert s.num_rows <= 7 and (s.num_rows == 1 or sum(map(len, s.column("terms").to_pylist())) <= 20)


def test_terms_of_slices():
    texts = [*(t for _, t in ROWS), "A-b_c'D", "\x00x\x7fy", "ſK Á é１"]
    for first, last, data, offsets in text_slices(pa.array(texts, pa.string()), 700):
        terms, counts = ranked._terms(data, offsets)
        expected = [terms_of(t) for t in texts[first:last]]
        assert [t.decode() for t in terms] == [t for own in expected for t in own]
        assert counts.tolist() == [len(own) for own in expected]


def test_long_documents_beyond_64_bits():
    length = np.array([1, 10**9], np.int64)
    assert ranked.length_share(length, 10**10, 10**12).tolist() == [75, 75 + 25 * 10**7]
