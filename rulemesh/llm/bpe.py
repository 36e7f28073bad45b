"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over ``WINDOW`` bytes cuts every text into chunks, at places that
depend on the content only, so a passage that several documents hold is cut alike in all of
them. The inside of a chunk, from its first to its last white space, is encoded once and
reused; at each join of chunks the broken word is put together, over as many chunks as
it takes to reach white space on both sides, and encoded anew. There the
result agrees exactly with that of the whole text: the tokenizers accepted here
drop white space before they merge, so nothing crosses it (``Encoder`` checks the
declared steps and refuses others).

Inside a chunk not seen before, words met already are taken from a second store. Both stores
have a fixed bound and live as long as a worker process; a chunk is only kept when it
is met a second time. What is shared by no document of a task costs nothing but its
encoding, and no text moves between tasks.

Null texts count as empty, and empty texts have no ids. Special tokens written out in a
text are found as the tokenizer does. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import batch_slices, fresh, give_back, powers, prefix_hash

#: Bytes that decide whether a chunk ends, and the usual length of a chunk (2 ** 9 bytes).
WINDOW = 16
CHUNK_BITS = 9
#: Bounds of a worker's stores, in bytes with what Python adds to an entry.
WORD_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20
ENTRY_BYTES = 160
MAX_SEEN = 100_000

_SPACE = b" \t\n\r\x0b\x0c"


def tokenizer_json(path: str) -> str:
    """The tokenizer's file; its text (at most a few MB) is what the tasks get."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _drops_space(spec: dict) -> bool:
    """Whether the declared steps neither join nor keep what white space separates."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    removes = (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "[^\\s" in pattern
        and " " not in pattern
    )
    added = spec.get("added_tokens") or []
    return removes and not any(
        t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])
        for t in added
    )


#: Lower-case letters that no normalization changes, and marks that may end a word.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_MARKS = b".,!?:;|"
# Alternatives of a pattern that puts letters, single digits and other marks into words
# apart, with what they are for lower-case ASCII without white space; and English endings.
_APART = {"[\\p{L}]+": "[a-z]+", "[\\p{N}]": "[0-9]", "[^\\s\\p{L}\\p{N}]+": "[^a-z0-9]+"}
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_PRINTED = re.compile(b"[!-@\\[-~]+")


def ascii_words(spec: dict) -> re.Pattern[bytes] | None:
    """The declared pattern for lower-case ASCII without white space; None if it has an alternative that might
    hold letters together with marks, besides English endings."""
    step = spec["pre_tokenizer"]
    pattern = step.get("pretokenizers", [step])[0]["pattern"]["Regex"]
    alternatives = re.split(r"(?<!\\)\|", pattern)
    if not set(_APART) <= set(alternatives) or not set(alternatives) <= {*_APART, *_ENDINGS}:
        return None
    return re.compile("|".join(_APART.get(x, x) for x in alternatives).encode())


class _Words(dict):
    """Ids of words as little-endian 32-bit numbers; a word not known is encoded. Words not met
    for a while are given up.

    A word of plain letters or marks goes to the tokenizer's model at once, since normalization and the
    splitting into words would leave it as it is; other words of ASCII are split as the pattern does. Both hold for
    tokenizers whose declared pattern keeps letters and marks apart; probes compare with the whole
    tokenizer too. Any other tokenizer gets every word whole.
    """

    def __init__(self, tokenizer, split: re.Pattern[bytes] | None, added: list[bytes], most_bytes: int):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = tokenizer
        self.added = added  # how added tokens begin
        self.bytes, self.most_bytes = 0, most_bytes
        self.model = tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.as_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        letters += [chr(c) for c in range(97, 123)]
        probes = [c * k + "ing" for c in letters for k in (1, 2)] + ["stra\u00dfe", "se\u00f1or", "\u00e9l\u00e8ve"]
        probes += ["!", "?!", "...", "7", "--", "()", "@", "~", "'s", "'", "\\", "_", "[]", "{", "^"]
        self.split = split
        self.plain = split is not None and all(self._plain(w) == self._whole(w) for w in probes)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.translate(self.as_bytes)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(mapped)])

    def _unknown(self, word: bytes) -> bytes:
        if not self.plain:
            return self._whole(word.decode("utf-8", "replace"))
        for mark in self.added:
            if mark in word:
                return self._whole(word.decode("utf-8", "replace"))
        if _PRINTED.fullmatch(word):
            parts = self.split.findall(word)
            return self._plain(parts[0].decode()) if len(parts) == 1 else b"".join([self[p] for p in parts])
        core = word.rstrip(_MARKS)
        if core != word and core and 97 <= core[-1] <= 122:
            return self[core] + self[word[len(core) :]]  # marks after a letter stand by themselves
        text = word.decode("utf-8", "replace")
        return self._plain(text) if _PLAIN.fullmatch(text) else self._whole(text)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._unknown(word)
        self.bytes += len(word) + len(ids) + ENTRY_BYTES
        if self.bytes > self.most_bytes // 2:
            self.older = dict(self)
            self.clear()
            self.bytes = len(word) + len(ids) + ENTRY_BYTES
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, spec: str, word_bytes: int = WORD_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        if not _drops_space(parsed):
            raise ValueError("only tokenizers that drop white space before merging are encoded by chunks")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        lower = (parsed.get("normalizer") or {}).get("normalizers", [])
        self.lowers = any(step.get("type") == "Lowercase" for step in lower)
        self.added = sorted({t["content"].encode()[:2] for t in parsed.get("added_tokens") or []})
        self.words = _Words(self.tokenizer, ascii_words(parsed), self.added, word_bytes)
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.chunk_bytes = 0
        self.seen: set[int] = set()

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """What stands before the first white space, the ids of the words inside, what stands
        after the last; None without white space."""
        if chunk in self.chunks:
            return self.chunks[chunk]
        words = chunk.split()
        if len(words) < 2 and not any(c in chunk for c in _SPACE):
            return None
        head = b"" if chunk[0] in _SPACE else words.pop(0)
        tail = b"" if chunk[-1] in _SPACE or not words else words.pop()
        found = head, b"".join(map(self.words.__getitem__, words)), tail
        mark = hash(chunk)
        if mark in self.seen:
            if self.chunk_bytes > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = 0
            self.chunks[chunk] = found
            self.chunk_bytes += len(chunk) + len(found[1]) + 300
        else:
            if len(self.seen) >= MAX_SEEN:
                self.seen.clear()
            self.seen.add(mark)
        return found

    def encode(self, text: bytes, cuts: list[int]) -> bytes:
        """Ids of a text whose chunks end at ``cuts`` (the last is its end)."""
        if self.lowers and not any(mark in text for mark in self.added):
            text = text.lower()  # A-Z only; the tokenizer would do it too
        out, open_word, start = [], b"", 0
        for cut in cuts:
            found = self._chunk(text[start:cut])
            if found is None:
                open_word += text[start:cut]
            else:
                head, inside, tail = found
                if open_word or head:
                    out.append(self.words[open_word + head])
                out.append(inside)
                open_word = tail
            start = cut
        if open_word:
            out.append(self.words[open_word])
        return b"".join(out)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        raw = data.tobytes()
        ends = np.union1d(chunk_ends(data), offsets[1:])
        first = np.searchsorted(ends, offsets[:-1], "right")
        last = np.searchsorted(ends, offsets[1:], "left")
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            yield self.encode(raw[a:b], (ends[first[i] : last[i] + 1] - a).tolist()) if b > a else b""


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` bytes ends a chunk."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    sums = prefix_hash(folded)
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * powers(len(data))[1][: len(data) - WINDOW + 1]
    return np.flatnonzero(rolled >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW


class Decoder:
    """Text of ids, as the tokenizer's own decoding without a decoder step: the tokens
    joined by single spaces."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        if json.loads(spec).get("decoder") is not None:
            raise ValueError("only tokenizers without a decoder step are decoded here")
        tokenizer = Tokenizer.from_str(spec)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = map(tokenizer.id_to_token, range(size))
        self.tokens = {i: t.encode() for i, t in enumerate(tokens) if t is not None}

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[str, tuple[str, object]] = {}


def worker(kind: type, spec: str, *options: int):
    """The encoder or decoder of this process; its stores outlive a task. One of each kind is kept."""
    digest = hashlib.sha256(f"{options} {spec}".encode()).hexdigest()
    if _made.get(kind.__name__, ("",))[0] != digest:
        _made[kind.__name__] = digest, kind(spec, *options)
    return _made[kind.__name__][1]


def id_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in encoded], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _send(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tokenizer_json(path))


def encode(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` under ``name``."""
    sent = _send(docs.sparkSession, path)
    kept = docs.drop(name)

    def run(batches):
        encoder = worker(Encoder, sent.value)
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                ids = id_lists(list(encoder.encode_slice(data, offsets)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, ids], names=[*batch.schema.names, name]
                )

    return kept.mapInArrow(
        run, T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    )


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its column ``ids`` (null: empty) under ``name``."""
    sent = _send(encoded.sparkSession, path)
    kept = encoded.drop(name)

    def run(batches):
        decoder = worker(Decoder, sent.value)
        for batch in batches:
            lists = batch.column(ids)
            texts = [
                decoder.decode(x.values.to_numpy(zero_copy_only=False)).decode() if x.is_valid else ""
                for x in lists
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))


def round_trips(docs: DataFrame, path: str, with_ids: bool = False, word_bytes: int = WORD_BYTES) -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids_sha256 and decoded_sha256 (and
    ``ids`` if wanted), encoded and decoded in one pass. ``word_bytes`` bounds a worker's store of words."""
    sent = _send(docs.sparkSession, path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kept = docs.drop(*names)
    text = fresh(kept, "whole_text")
    others = [c for c in kept.columns if c != "text"]
    kept = kept.select(*(F.col(f"`{c}`") for c in others), F.col("text").alias(text))

    def run(batches):
        encoder, decoder = worker(Encoder, sent.value, word_bytes), worker(Decoder, sent.value)
        for whole in batches:
            for batch, data, offsets in batch_slices(whole, text):
                encoded = list(encoder.encode_slice(data, offsets))
                decoded = [decoder.decode(np.frombuffer(x, "<u4")) for x in encoded]
                columns = [
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ] + [id_lists(encoded)] * with_ids
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*others, *names])
        give_back()

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *fields]))
