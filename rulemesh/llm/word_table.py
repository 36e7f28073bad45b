"""Ids of all words of a slice at once, from a table of words in numpy arrays.

A word of at most 16 bytes is its own key: its bytes as two numbers, and its length, so a word found is the
word itself and never another one of the same hash. A mark that ends a word behind a letter is a word of
its own, where the tokenizer's pattern keeps them apart. Longer words, and words not met yet, go through
the encoder one by one. The table has a fixed size and starts anew when half of it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rulemesh.llm.bpe import _MARKS, _SPACE, Encoder
from rulemesh.llm.common import SLICE_BYTES

#: Places of the table are 2 ** SLOT_BITS, of 22 bytes each; half of them are used at most.
SLOT_BITS = 21
LONGEST = 16
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SPACE)] = False
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about ``SLICE_BYTES``, cut at white space."""
    start = 0
    while start < len(data):
        end = start + SLICE_BYTES
        while end < len(data):
            spaces = np.flatnonzero(~_IS_WORD[data[end : end + SLICE_BYTES]])
            if len(spaces):
                end += int(spaces[0])
                break
            end += SLICE_BYTES
        yield data[start:end]
        start = end


class WordTable:
    def __init__(self, spec: str, slot_bits: int = SLOT_BITS):
        self.encoder = Encoder(spec, 8 << 20)
        self.bits = slot_bits
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.count = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        self.at = np.zeros(size, np.uint32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.n_ids = 0

    def _home(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        mixed = (low * _MIX[0]) ^ (high * _MIX[1]) ^ (length.astype(np.uint64) * _MIX[2])
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _MIX[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place of each word, -1 of those not in the table."""
        found = np.full(len(low), -1, np.int64)
        left, slot = np.arange(len(low)), self._home(low, high, length)
        while len(left):
            own = self.length[slot]
            same = (own == length[left]) & (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            found[left[same]] = slot[same]
            on = ~same & (own > 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found

    def _add(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, encoded: list[bytes]) -> None:
        """Distinct words that are not in the table."""
        count = np.array([len(x) // 4 for x in encoded])
        new = np.frombuffer(b"".join(encoded), "<u4")
        if self.n_ids + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(new)] = new
        at = self.n_ids + np.cumsum(count) - count
        self.n_ids += len(new)
        self.used += len(low)
        left, slot = np.arange(len(low)), self._home(low, high, length)
        while len(left):
            free = self.length[slot] == 0
            _, first = np.unique(slot, return_index=True)  # one word a place
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            to, word = slot[wins], left[wins]
            self.low[to], self.high[to], self.length[to] = low[word], high[word], length[word]
            self.at[to], self.count[to] = at[word], count[word]
            left, slot = left[~wins], (slot[~wins] + 1) & ((1 << self.bits) - 1)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and where in them each text ends."""
        if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
            ids = np.concatenate([self._encoded(x, np.array([0, len(x)]))[0] for x in _stretches(data)])
            return ids, np.array([len(ids)])
        return self._encoded(data, offsets)

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, words = data.tobytes(), self.encoder.words
        if any(mark in raw for mark in self.encoder.added) or not len(raw):
            texts = list(self.encoder.encode_slice(data, offsets))
            return np.frombuffer(b"".join(texts), "<u4"), np.cumsum([len(x) // 4 for x in texts])
        raw = raw.lower() if self.encoder.lowers else raw
        padded = np.frombuffer(raw + bytes(LONGEST + 8), np.uint8)
        inside = _IS_WORD[padded[: len(raw)]]
        cut = np.zeros(len(raw) + 1, bool)
        cut[0] = cut[offsets] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        if words.plain:  # a mark that ends a word behind a letter stands by itself
            body = padded[: len(raw)]
            last = _IS_MARK[body] & (cut[1:] | ~after[1:])
            cut[1 : len(raw)] |= last[1:] & _IS_LETTER[body[:-1]]
        starts = np.flatnonzero(after & (cut | ~before))
        ends = np.flatnonzero(before & (cut | ~after))
        size = ends - starts
        eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        low = eights[starts] & _MASKS[np.minimum(size, 8)]
        high = eights[np.minimum(starts + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 8)]
        short = size <= LONGEST
        length = np.where(short, size, 0).astype(np.uint8)
        place = np.full(len(size), -1, np.int64)
        place[short] = self._find(low[short], high[short], length[short])
        unknown = np.flatnonzero(short & (place < 0))
        odd: dict[int, np.ndarray] = {}  # ids of words that are not in the table
        if len(unknown):
            where: dict[bytes, int] = {}
            for i, a, b in zip(unknown.tolist(), starts[unknown].tolist(), ends[unknown].tolist(), strict=True):
                where.setdefault(raw[a:b], i)
            known_ids, tokens = words.raw, words.model.tokenize
            encoded = [
                b"".join([known_ids[t.id] for t in tokens(word.decode())])
                if words.plain and word.isalpha() and word.islower()
                else words._unknown(word)
                for word in where
            ]
            # the rare words of too many ids stay outside
            keep = [k for k, x in enumerate(encoded) if len(x) // 4 < 256]
            if self.used + len(keep) > 1 << (self.bits - 1):
                self._clear()
                known = np.flatnonzero(short & (place >= 0))
                place[known] = -1
            else:
                known = unknown[:0]
            if len(keep) <= 1 << (self.bits - 1):
                at = np.fromiter(where.values(), np.int64)[keep]
                self._add(low[at], high[at], length[at], [encoded[k] for k in keep])
            if not len(known):
                place[unknown] = self._find(low[unknown], high[unknown], length[unknown])
            else:
                place[short] = self._find(low[short], high[short], length[short])
        for i in np.flatnonzero(place < 0).tolist():
            odd[i] = np.frombuffer(words[raw[starts[i] : ends[i]]], "<u4")
        count = np.where(place < 0, 0, self.count[place]).astype(np.int64)
        outside = np.fromiter(odd, np.int64, len(odd))
        count[outside] = [len(x) for x in odd.values()]
        to = np.cumsum(count)
        first = np.where(place < 0, 0, self.at[place]) - (to - count)
        total = int(to[-1]) if len(to) else 0
        index = np.repeat(first, count) + np.arange(total)
        ids = self.ids[np.clip(index, 0, len(self.ids) - 1)]
        for i, own in odd.items():
            ids[to[i] - len(own) : to[i]] = own
        return ids, np.concatenate([[0], to])[np.searchsorted(starts, offsets[1:], "left")]
