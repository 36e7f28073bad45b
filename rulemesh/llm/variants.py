"""Spelling variants of the words of a corpus: sorted-list dynamic programming.

Words that differ by one inserted, deleted or replaced code point are near. To find them, the
sorted vocabulary is scanned for every word: words next to each other share a prefix, and so
the rows of the edit matrix up to that length; only rows below are computed anew, banded to the three
cells beside the diagonal. Where a shared prefix is already two edits away from the word, the whole
range of words that have it is passed over. ``scan`` does this for all words of a list at
once, row by row of the matrix.

Lists are kept short by what two near words must share. With ``s`` the shorter length, one
edit leaves the first ``s // 2`` code points or the last ``s - s // 2`` as they are, so words
meet by that half. A list of more than ``MAX_LIST`` words is parted again by
halves of what is still open, until a single open code point bounds it by the alphabet: at
most 90 words of length ``s`` and 8,100 of length ``s + 1``. No pair is lost, none is made that does not meet in a list.

Null texts and texts without letters have no words. Repeated rows count as often as they stand there. In the
seal that decides which occurrences lose a code point, a null ``doc_id`` is written as an empty text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemesh.llm.common import BROADCAST_BYTES, batch_slices
from rulemesh.session import cut_lineage

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: One occurrence in so many, by the seal of document and run, loses a code point.
DROPS = 199
#: Words a list may hold before it is parted again.
MAX_LIST = 512
#: Words and bytes of the lists that are scanned together, and distinct words a task holds.
SCAN_WORDS, SCAN_BYTES, HELD_WORDS = 1 << 14, 1 << 20, 1 << 18

# Letters in lower case, longer characters as they are, the rest as spaces.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = _FOLDED[65:91] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)
# U+00C0 to U+00FF are this byte and a second one.
_LEAD = 0xC3


def _crc_steps() -> np.ndarray:
    """Table of the CRC-32 of one byte, from the reversed polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> np.uint32(1)) ^ np.uint32(0xEDB88320), steps >> np.uint32(1))
    return steps


_CRC = _crc_steps()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of what was read ``before`` followed by ``data[start:end]``, for each place."""
    order = np.argsort(start - end, kind="stable")
    first, length = start[order], (end - start)[order]
    state = ~before[order].astype(np.uint32)
    for step in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length, -step, "left"))
        own = state[:active]
        state[:active] = _CRC[(own ^ data[first[:active] + step]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _add_slice(counts: Counter, seals: list[bytes], data: np.ndarray, offsets: np.ndarray) -> None:
    """Adds the words of a slice of texts; ``seals`` are the ids of the texts, each with its colon."""
    lead = data == _LEAD
    plain = data < 128
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    folded = np.where(plain | lead | second, _FOLDED[data], 32).astype(np.uint8)
    # A space between texts, so that their words stay apart.
    folded = np.insert(folded, offsets[1:-1], 32)
    inside = folded != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    leads = np.concatenate([[0], np.cumsum(folded == _LEAD)])
    length = (end - start) - (leads[end] - leads[start])
    long = length >= MIN_LENGTH
    runs = list(compress(folded.tobytes().split(), long.tolist()))
    if not runs:
        return
    counts.update(runs)
    start, end, length = start[long], end[long], length[long]
    text = np.searchsorted(offsets[:-1] + np.arange(len(offsets) - 1), start, "right") - 1
    # Texts without bytes begin where the next does; the last of them that begins there holds the run.
    before = np.array([zlib.crc32(seal) for seal in seals], np.uint32)
    sealed = crc32_of(folded, start, end, before[text])
    for i in np.flatnonzero(sealed % DROPS == 0).tolist():
        run = runs[i].decode("utf-8")
        at = int(sealed[i]) % len(run)
        counts[runs[i]] -= 1
        counts[(run[:at] + run[at + 1 :]).encode()] += 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) of at least ``MIN_LENGTH`` code points.

    Counts are summed in each task, a bounded number of words at a time, before they are shuffled.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def told(counts: Counter) -> pa.RecordBatch:
        held = [(w, n) for w, n in counts.items() if n and len(w) - w.count(_LEAD) >= MIN_LENGTH]
        words = pa.array([w for w, _ in held], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                seals = [f"{x}:".encode() for x in batch.column("doc_id").to_pylist()]
                _add_slice(counts, seals, data, offsets)
                if len(counts) > HELD_WORDS:
                    yield told(counts)
                    counts = Counter()
        yield told(counts)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return word_counts(docs).filter(F.col("n") >= min_count)


def _key(word: Column, shorter: Column, left: Column, right: Column) -> Column:
    """Name of the list of words that share ``left`` code points in front and ``right`` at the end."""
    tail = F.substr(word, F.length(word) - right + 1, right)
    return F.xxhash64(shorter, left, right, F.substr(word, F.lit(1), left), tail)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two lists that share half of what is open in its own."""
    open_points = F.col("shorter") - F.col("left") - F.col("right")
    half = F.floor(open_points / 2).cast("int")
    sides = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right").alias("right")),
        F.struct(F.col("left").alias("left"), (F.col("right") + open_points - half).alias("right")),
    )
    parted = rows.withColumn("_side", F.explode(sides)).select(
        "word", "n", "shorter", F.col("_side.left").alias("left"), F.col("_side.right").alias("right")
    )
    return parted.withColumn("key", _key(F.col("word"), F.col("shorter"), F.col("left"), F.col("right")))


def lists(words: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(key, word, n, shorter, left, right): the lists in which near words meet.

    A word of length L meets words of L + 1 in lists of shorter length L and words of L - 1 in
    lists of L - 1. Rounds end when no list is too long, or at one open code point: after
    as many rounds as the longest word's length has binary digits.
    """
    length = F.length("word")
    whole = words.select(
        "word", "n", F.explode(F.array(length - 1, length)).alias("shorter"), F.lit(0).alias("left"), F.lit(0).alias("right")
    )
    rows = _halved(whole.filter(F.col("shorter") >= MIN_LENGTH))
    done = []
    while True:
        rows = cut_lineage(rows)
        far = F.col("shorter") - F.col("left") - F.col("right") > 1
        large = cut_lineage(
            rows.filter(far).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_list).select("key")
        )
        n = large.count()
        if not n:
            break
        if n * 32 <= BROADCAST_BYTES:
            large = F.broadcast(large)
        done.append(rows.join(large, "key", "left_anti"))
        rows = _halved(rows.join(large, "key", "left_semi").drop("key")).select(*rows.columns)
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _shared_prefixes(points: np.ndarray, start: np.ndarray, length: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many code points each word shares with the one before it in its list."""
    shared = np.zeros(len(start), np.int64)
    alive = np.flatnonzero(~begins)
    depth = 0
    while len(alive):
        alive = alive[(length[alive] > depth) & (length[alive - 1] > depth)]
        alive = alive[points[start[alive] + depth] == points[start[alive - 1] + depth]]
        depth += 1
        shared[alive] = depth
    return shared


def scan(points: np.ndarray, start: np.ndarray, length: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (word, near word) in sorted lists; each pair in both directions.

    ``points`` are the code points of all words, ``begins`` says which word is its list's first.
    A row of the matrix belongs to a word and a range of the list that shares a prefix of ``depth``
    code points; its cells are the distances of that prefix to the word's first depth - 1,
    depth and depth + 1 code points, 2 standing for two or more.
    """
    n = len(start)
    shared = _shared_prefixes(points, start, length, begins)
    list_start = np.flatnonzero(begins)
    sizes = np.diff(np.append(list_start, n))
    word = np.arange(n)
    low = np.repeat(list_start, sizes)
    high = low + np.repeat(sizes, sizes)
    several = high - low > 1
    word, low, high = word[several], low[several], high[several]
    below = np.full(len(word), 2, np.int8)
    same = np.zeros(len(word), np.int8)
    above = np.ones(len(word), np.int8)
    out_word, out_near = [], []
    last = np.append(points, np.uint8(0))
    depth = 0
    while len(word):
        # The word that ends here is the range's first; its distance is the cell of the whole word.
        cell = np.choose(np.clip(length[word] - depth + 1, 0, 3), [below, same, above, np.int8(2)])
        near = (length[low] == depth) & (cell == 1) & (length[word] - depth >= -1)
        out_word.append(word[near])
        out_near.append(low[near])
        # Ranges that share one more code point.
        child = np.flatnonzero((length > depth) & (begins | (shared <= depth)))
        if not len(child):
            break
        first, stop = np.searchsorted(child, low), np.searchsorted(child, high)
        count = stop - first
        row = np.repeat(np.arange(len(word)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        ends = np.append(child[1:], n)
        word, low, high = word[row], child[at], np.minimum(ends[at], high[row])
        point = points[start[low] + depth]
        size, own = length[word], start[word]

        def differs(j: int) -> np.ndarray:
            return (last[np.minimum(own + j, len(points))] != point) | (size <= j)

        b, s, a = below[row], same[row], above[row]
        new_below = np.minimum(s + 1, b + differs(depth - 1)) if depth else s + 1
        new_below = np.where(size >= depth, new_below, 2)
        new_same = np.minimum(np.minimum(a, new_below) + 1, s + differs(depth))
        new_same = np.where(size >= depth + 1, new_same, 2)
        new_above = np.minimum(new_same + 1, a + differs(depth + 1))
        new_above = np.where(size >= depth + 2, new_above, 2)
        keep = np.minimum(np.minimum(new_below, new_same), new_above) <= 1
        word, low, high = word[keep], low[keep], high[keep]
        below, same, above = (np.minimum(x[keep], 2).astype(np.int8) for x in (new_below, new_same, new_above))
        depth += 1
    return np.concatenate([*out_word, np.zeros(0, np.int64)]), np.concatenate([*out_near, np.zeros(0, np.int64)])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a stream sorted by ``key``, some whole lists at a time."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= SCAN_WORDS or size >= SCAN_BYTES:
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(word, near, near_n): each word of ``words`` (word, n) with each of its near words, once."""
    # Words that meet by their ends are written backwards, so that what they share comes first.
    backwards = F.col("right") > F.col("left")
    written = lists(words, max_list).select(
        "key", F.when(backwards, F.reverse("word")).otherwise(F.col("word")).alias("written"), "n", backwards.alias("backwards")
    )

    def run(batches):
        for table in _whole_lists(batches):
            texts = [w.encode("latin-1") for w in table.column("written").to_pylist()]
            keys = table.column("key").to_numpy()
            length = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(length) - length
            begins = np.append(True, keys[1:] != keys[:-1])
            own, near = scan(np.frombuffer(b"".join(texts), np.uint8), start, length, begins)
            back = table.column("backwards").to_numpy()
            n = table.column("n").to_numpy()

            def spelled(places, texts=texts, back=back):
                return pa.array([(texts[i][::-1] if back[i] else texts[i]).decode("latin-1") for i in places.tolist()], pa.string())

            yield pa.RecordBatch.from_arrays(
                [spelled(own), spelled(near), pa.array(n[near].astype(np.int64))], names=["word", "near", "near_n"]
            )

    dealt = written.repartition("key").sortWithinPartitions("key", "written")
    pairs = dealt.mapInArrow(run, "word string, near string, near_n long")
    # An inserted code point that repeats its neighbour may be found in two lists.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n (ties: the smallest in code-point
    order) where that is at least ``TIMES`` the word's n."""
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("_best")
    )
    joined = words.join(best, "word", "left")
    enough = -F.col("_best.n") >= TIMES * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("_best.near")).alias("form"),
        F.when(enough, -F.col("_best.n")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of the forms that follow one another.

    Every form is ``TIMES`` as frequent as its word, so chains are short and never close; each
    round doubles the length followed.
    """
    links = cut_lineage(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = cut_lineage(links.join(onward, "root", "left"))
        if not stepped.filter(F.col("_next").isNotNull()).limit(1).count():
            return links
        links = cut_lineage(stepped.select("word", F.coalesce("_next", "root").alias("root")))


def group(docs: DataFrame, min_count: int = MIN_COUNT, max_list: int = MAX_LIST) -> DataFrame:
    """Per word of ``docs`` (doc_id, text; other columns are not read) with at least ``min_count`` occurrences:
    word, form, root, n, n_near, form_n. An empty table has no words."""
    words = cut_lineage(vocabulary(docs, min_count))
    formed = cut_lineage(forms(words, near_words(words, max_list)))
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
