import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rulemesh.llm import word_table
from rulemesh.llm.bpe import tokenizer_json
from rulemesh.llm.word_table import WordTable

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(draw: random.Random, n: int) -> list[str]:
    letters = ["a", "e", "th", "ing", "é", "ß", "S", "I'm", "don't", ",", "!?", "7", "日本", "́", "\x00", " ", "😀", "İ"]
    word = lambda: "".join(draw.choices(letters, k=draw.randint(1, 9)))
    made = [draw.choice([" ", "", "\n"]) + "".join(word() + draw.choice([" ", "\t", "  ", "　"]) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    fixed = ["", " ", "a", "ab", "ab\x00", "a" * 16, "a" * 17, "a" * 400, "x<|endoftext|>Y z", "<|StartOfText|> <|", "end", "begin"]
    return fixed + made + [""]


@pytest.mark.parametrize("slot_bits", [2, 7, 16])
def test_ids_of_slices(slot_bits):
    tokenizer = Tokenizer.from_file(PATH)
    table = WordTable(tokenizer_json(PATH), slot_bits)
    draw = random.Random(slot_bits)
    for marks in (False, True, False):
        some = [t for t in texts(draw, 60) if marks or "<|" not in t]
        for part in (some, some[::-1], some[:1], [""] * 3):
            data = [t.encode() for t in part]
            offsets = np.cumsum([0, *map(len, data)])
            ids, ends = table.encode_slice(np.frombuffer(b"".join(data), np.uint8), offsets)
            got = [x.tolist() for x in np.split(ids, ends)[:-1]]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
            assert ends[-1] == len(ids) and table.used <= 1 << (slot_bits - 1)


def test_words_are_encoded_once():
    table = WordTable(tokenizer_json(PATH))
    data = np.frombuffer(b"several words, several more words " * 40, np.uint8)
    first, _ = table.encode_slice(data, np.array([0, len(data)]))
    table._add = None  # a second look would fail
    again, _ = table.encode_slice(data, np.array([0, len(data)]))
    assert first.tolist() == again.tolist()


def test_a_long_text_goes_by_stretches(monkeypatch):
    monkeypatch.setattr(word_table, "SLICE_BYTES", 50)
    text = " ".join(texts(random.Random(5), 30)) + "a" * 300 + " b"
    data = np.frombuffer(text.encode(), np.uint8)
    assert b"".join(x.tobytes() for x in word_table._stretches(data)) == text.encode()
    ids, ends = WordTable(tokenizer_json(PATH)).encode_slice(data, np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ends.tolist() == [len(ids)]
