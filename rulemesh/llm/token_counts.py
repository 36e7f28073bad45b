"""Token counts behind a cache of digests.

Every content is named by the SHA-256 of its normalised text, every tokenizer by the SHA-256 of its file
and its library's release. ``count_tokens`` joins these names to the counts stored
before, encodes each distinct content that is missing once, appends its count to the cache and
answers all documents from it. Normalised means that a null text is an empty one; any other
change of a text could change its count.

The cache is a folder of Parquet files, one subfolder a tokenizer version: ``digest``, ``n_tokens``. Rows are
appended by Spark's committed writes; a digest that two runs append at the same time is
stored twice and read once, and both rows are equal.

Texts move as little as the digests allow. A missing content that one document holds is encoded
where it is read. Only contents that several documents hold are brought together, one copy a
task, and only if the digests set apart (already counted or held several times) are measured to fit a
broadcast; beyond that, one copy a task of every content is dealt out by its digest and met with the
missing ones. Both ways store the same counts.

Repeated rows stay as many as they were. Equal texts have equal counts. The special tokens
written out in a text count as the tokenizer reads them. A very long text is cut, where the tokenizer is
known to begin anew anyway, into pieces that are encoded one after the other.

Where the tokenizer's declared steps split a text into words by the built-in expression and merge each word by
itself, a content's count is the sum of its words' counts: a worker encodes a word when it meets
it first and keeps its count in a store of bounded size. Stretches with characters whose kind is not
settled below go through the whole tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from importlib.metadata import version as release_of

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.llm.common import BROADCAST_BYTES, SLICE_BYTES, fresh
from rulemesh.operators.joins import keyed_join
from rulemesh.session import cut_lineage

#: A digest and its row in a broadcast table.
ENTRY_BYTES = 64
#: Longer texts are cut into pieces of about so many characters.
PIECE_CHARACTERS = 1 << 18
#: Bound of a worker's store of words, in bytes with what Python adds to an entry; longer words are not kept.
WORD_BYTES = 64 << 20
ENTRY_OVERHEAD = 100
LONGEST_KEPT = 200
CACHE_SCHEMA = "digest binary, n_tokens long"


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def version(path: str) -> str:
    """Digest of what decides the counts: the tokenizer's file and the library that reads it."""
    library = library_of(path)
    seal = hashlib.sha256(f"{library} {release_of(library)}\n".encode())
    seal.update(tokenizer_file(path))
    return seal.hexdigest()


def _restarts_after_letters(spec: dict) -> bool:
    """Whether a space after an ASCII letter always begins a new word of the tokenizer, so that
    a text may be cut before it: byte-level splitting by the built-in expression, no
    normalization, no added token that holds or takes white space."""
    step = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and step.get("type") == "ByteLevel"
        and step.get("use_regex") is True
        and step.get("add_prefix_space") is False
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added
        )
    )


def pieces(text: str, size: int = PIECE_CHARACTERS) -> list[str]:
    """``text`` cut before spaces that follow an ASCII letter, each piece of ``size`` or more."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


# Letters beyond ASCII, and marks that are neither letters, digits nor white space, in every release of Unicode.
_LETTERS = (
    "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0388-\u038a\u038e-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u0527"
    "\u0561-\u0586\u05d0-\u05ea\u0620-\u064a\u0904-\u0939\u0e01-\u0e30\u10d0-\u10f0\u1e00-\u1eff"
    "\u3041-\u3096\u30a1-\u30fa\u30fc-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
)
_MARKS = (
    "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e"
    "\u20a0-\u20b9\u2190-\u21ff\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20\uff5b-\uff65"
)
_WHITE = " \t\n\r\x0b\x0c"
_UNSETTLED = re.compile(f"[^\x00-\x7f{_LETTERS}{_MARKS}]")
#: Behind a letter a space begins a new word, and what follows does not change the words before it.
_BEGINS = re.compile(f"(?<=[{_LETTERS}])(?= )")


def _words(letters: str) -> re.Pattern[str]:
    """The built-in expression of byte-level tokenizers, for texts of ASCII, ``letters`` and marks."""
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[0-9]+| ?[^{_WHITE}{letters}0-9]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
    )


_ASCII_WORDS, _ALL_WORDS = _words("A-Za-z"), _words(_LETTERS)
_PROBES = ["It's", " we'll", "'d 'D", " caf\u00e9", "a  b \t\n c\r\n", " 42nd", "?!...", " \u201cja\u201d", "\u65e5\u672c\u8a9e", "\x00\x1c_ ~"]


class _ByteLetters(dict):
    """What byte-level tokenizers write for a character's bytes, for ``str.translate``."""

    def __init__(self):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, point: int) -> str:
        self[point] = found = self.level.pre_tokenize_str(chr(point))[0][0]
        return found


class WordCounts(dict):
    """Counts of tokens of words, and of stretches with unsettled characters; one not known is encoded.
    Words not met for a while are given up."""

    def __init__(self, tokenizer, most_bytes: int = WORD_BYTES):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = _ByteLetters()
        self.older: dict[str, int] = {}
        self.bytes, self.most_bytes = 0, most_bytes

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            settled = word.isascii() or not _UNSETTLED.search(word)
            n = len(self.model.tokenize(word.translate(self.letters))) if settled else self.whole(word)
        if len(word) > LONGEST_KEPT:
            return n
        size = word.__sizeof__() + ENTRY_OVERHEAD
        self.bytes += size
        if self.bytes > self.most_bytes // 2:
            self.older = dict(self)
            self.clear()
            self.bytes = size
        self[word] = n
        return n

    def count(self, text: str) -> int:
        """The count of a text without added tokens."""
        if text.isascii():
            return sum(map(self.__getitem__, _ASCII_WORDS.findall(text)))
        if not _UNSETTLED.search(text):
            return sum(map(self.__getitem__, _ALL_WORDS.findall(text)))
        return sum(self[x] if _UNSETTLED.search(x) else self.count(x) for x in _BEGINS.split(text))


def counter(file: bytes, library: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens, without begin, end or other tokens added to a text."""
    if library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=file)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(file)
    cuts = _restarts_after_letters(spec)

    def encoded(texts: list[str]) -> list[int]:
        short = [t if not cuts or len(t) <= PIECE_CHARACTERS else "" for t in texts]
        counts = [len(x) for x in tokenizer.encode_batch_fast(short, add_special_tokens=False)]
        for i, text in enumerate(texts):
            if len(text) != len(short[i]):
                counts[i] = sum(len(tokenizer.encode(p, add_special_tokens=False)) for p in pieces(text))
        return counts

    words = WordCounts(tokenizer)
    if not cuts or spec["model"].get("dropout") or any(words.count(p) != words.whole(p) for p in _PROBES):
        return encoded
    added = [t["content"] for t in spec.get("added_tokens") or []]

    def count(texts: list[str]) -> list[int]:
        return [
            encoded([text])[0] if any(a in text for a in added) else sum(map(words.count, pieces(text)))
            for text in texts
        ]

    return count


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def _worker_counter(file: bytes, library: str) -> Callable[[list[str]], list[int]]:
    """The counter of this process; a process keeps one tokenizer at a time."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = counter(file, library)
    return _counters[key]


def _encoded(contents: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of contents (digest, text)."""
    sent = contents.sparkSession.sparkContext.broadcast((tokenizer_file(path), library_of(path)))

    def run(batches):
        count = _worker_counter(*sent.value)
        for batch in batches:
            texts, counts, held, size = batch.column("text"), [], [], 0
            for i in range(len(texts)):
                held.append(texts[i].as_py() or "")
                size += len(held[-1])
                if size >= SLICE_BYTES or i + 1 == len(texts):
                    counts += count(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return contents.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def cache_folder(cache: str, path: str) -> str:
    return f"{cache.rstrip('/')}/tokenizer={version(path)}"


def stored_counts(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """(digest, n_tokens) of all contents this tokenizer version has counted; empty without a cache."""
    folder = cache_folder(cache, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _missing_contents(
    contents: DataFrame, tally: DataFrame, limit: int
) -> DataFrame:
    """(digest, text): each content without a count once. ``contents`` has a row a document."""
    apart = tally.filter(F.col("n_tokens").isNotNull() | (F.col("n") > 1))
    repeated = tally.filter(F.col("n_tokens").isNull() & (F.col("n") > 1)).select("digest")
    if apart.count() * ENTRY_BYTES <= limit:
        alone = contents.join(F.broadcast(apart.select("digest")), "digest", "left_anti")
        several = contents.join(F.broadcast(repeated), "digest", "left_semi")
        return alone.unionByName(several.groupBy("digest").agg(F.first("text").alias("text")))
    once = contents.groupBy("digest").agg(F.first("text").alias("text"))
    return once.join(tally.filter(F.col("n_tokens").isNull()).select("digest"), "digest", "left_semi")


def count_tokens(
    docs: DataFrame,
    path: str,
    cache: str,
    names: tuple[str, str] = ("n_bytes", "n_tokens"),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without ``text`` but with the UTF-8 length and the token count of each text.

    ``path`` names the tokenizer's file (``.json`` or ``.model``), ``cache`` a folder that all
    executors share; counts missing there are appended before this returns. The
    columns named in ``names`` take the place of columns of these names; all others are
    kept, whatever they are called. A null text counts as an empty one: 0 bytes, 0 tokens.
    """
    spark = docs.sparkSession
    kept = docs.drop(*names)
    text, digest = F.coalesce(F.col("text").cast("string"), F.lit("")), fresh(kept, "digest")
    named = F.unhex(F.sha2(text, 256))
    others = [F.col(f"`{c}`") for c in kept.columns if c.lower() != "text"]
    keys = cut_lineage(
        kept.select(*others, F.octet_length(text).cast("long").alias(names[0]), named.alias(digest))
    )
    known = stored_counts(spark, cache, path)
    seen = keys.groupBy(F.col(digest).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    tally = cut_lineage(seen.join(known, "digest", "left"))
    contents = docs.select(named.alias("digest"), text.alias("text"))
    missing = _missing_contents(contents, tally, broadcast_bytes)
    _encoded(missing, path).write.mode("append").parquet(cache_folder(cache, path))

    counts = stored_counts(spark, cache, path).join(tally.select("digest"), "digest", "left_semi")
    counts = counts.select(F.col("digest").alias(digest), F.col("n_tokens").alias(names[1]))
    return keyed_join(keys, counts, digest, "left", fits=tally.count() * ENTRY_BYTES <= broadcast_bytes).drop(digest)
