import random

import numpy as np
import pytest

from rulemesh.functions.passages import copied_characters, copy_distance
from rulemesh.operators.compare import copied_distance, page_distance


def plain_copied(text, source, size):
    inside = set()
    for i in range(len(text) - size + 1):
        if text[i : i + size] in source:
            inside |= set(range(i, i + size))
    return len(inside)


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_copied_characters_against_every_run(limit):
    draw = random.Random(limit)
    for _ in range(300):
        text, source = ("".join(draw.choices("abé\U0001f642", k=draw.randrange(40))) for _ in range(2))
        size = draw.randrange(1, 7)
        assert copied_characters(points(text), points(source), size, limit) == plain_copied(text, source, size)


BODY = "".join(random.Random(4).choices("abcdefghij <>", k=900))


def test_moved_and_inserted_passages():
    moved = BODY[500:] + BODY[:500]
    assert copy_distance(BODY, moved) == 0.0
    inserted = BODY[:300] + "0123456789" * 10 + BODY[300:]
    assert copy_distance(BODY, inserted) == copy_distance(inserted, BODY) == 100 / 1000
    assert copy_distance(BODY, BODY * 3) == 0.0
    assert copy_distance(BODY, "0" * 300) == 1.0


def test_short_and_empty_texts():
    assert copy_distance("", "") == 0.0
    assert copy_distance("", "abc") == copy_distance("abc", "") == 1.0
    assert copy_distance("abc", "abc" * 9) == 1.0  # no passage is long enough
    assert copy_distance("abc", "abc" * 9, 3) == 0.0


@pytest.mark.parametrize("passage", [4, 16])
def test_distance_of_pages(spark, passage):
    draw = random.Random(passage)
    parts = ["".join(draw.choices("abcé", k=9)) for _ in range(6)]
    bodies = {f"p{i}": "".join(draw.choices(parts, k=draw.randrange(5))) for i in range(12)}
    bodies["p11"] = bodies["p10"] = "<p>equal contents of two URLs</p>"
    rows = [(u, b) for u, b in bodies.items()] + [("p3", bodies["p3"]), ("unread", None)]
    pages = spark.createDataFrame(rows, "url string, body string")
    names = [*bodies, "gone", "unread", None]
    pairs = [(n, draw.choice(names), draw.choice(names)) for n in range(80)]
    frame = spark.createDataFrame(pairs + pairs[:3], "n int, left_url string, right_url string")
    found = copied_distance(frame, pages, passage).collect()
    assert sorted(r.n for r in found) == sorted([*range(80), 0, 1, 2])
    for row in found:
        a, b = bodies.get(row.left_url), bodies.get(row.right_url)
        if a is None or b is None:
            assert row.distance == 1.0
        elif a == b:
            assert row.distance == 0.0
        else:
            alone = max(len(a) - plain_copied(a, b, passage), len(b) - plain_copied(b, a, passage))
            assert row.distance == alone / max(len(a), len(b))
            assert (row.left_length, row.right_length) == (len(a), len(b))


def test_metric_by_name_and_no_rows(spark):
    none = spark.createDataFrame([], "left_url string, right_url string")
    pages = spark.createDataFrame([("p", "x")], "url string, body string")
    assert page_distance("passages", none, pages).collect() == []
