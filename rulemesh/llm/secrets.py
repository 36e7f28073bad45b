"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

The rules' regular expressions, each down to its least length, are compiled into
one minimal deterministic automaton (``automaton.compile_rules``) whose arrays are
broadcast; their size depends on the rules only. The scan tells which pieces of a text
hold the end of which rule. There the rule itself gives the exact spans,
leftmost and not overlapping within a kind; no match crosses the border of a piece.

Null texts count as empty and have no spans; places are code points, ends exclusive. Repeated
rows are scanned each. Other columns are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulemesh.llm import spans
from rulemesh.llm.automaton import Automaton, compile_rules, pieces, scan
from rulemesh.llm.common import batch_slices

BASE = ("assign", "access", "hex")
MORE = ("private_key", "code_host", "chat", "web_token")
KINDS = BASE + MORE

_KEYWORDS = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: For the automaton: pattern, and whether letters count in either case.
SHORTEST = {
    "assign": (_KEYWORDS + "[A-Za-z0-9+/_.=-]{8}", True),
    "access": ("AKIA[A-Z0-9]{12}", False),
    "hex": ("[0-9a-f]{32}", False),
    "private_key": ("-----BEGIN [A-Z\\x20]*PRIVATE KEY-----", False),
    "code_host": ("gh[pousr]_[A-Za-z0-9]{4}", False),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10}", False),
    "web_token": ("eyJ[A-Za-z0-9_-]+\\.eyJ", False),
}
#: The rules themselves, on bytes; the group or match that must have the least length.
EXACT = {
    "assign": (re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(rb"[0-9a-f]+"), 0, 32),
    "private_key": (re.compile(rb"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"), 0, 0),
    "code_host": (re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 0),
    "chat": (re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 0),
    "web_token": (re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 0),
}


def automaton() -> Automaton:
    return compile_rules([SHORTEST[kind] for kind in KINDS])


def slice_spans(rules: Automaton, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """The spans of each text of a slice."""
    begins, ends = pieces(rules, data, offsets)
    mask = scan(rules, data, begins, ends)
    hits = np.flatnonzero(mask)
    found: list[list] = [[] for _ in range(len(offsets) - 1)]
    if len(hits):
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        texts = np.searchsorted(offsets, begins[hits], "right") - 1
        for text, begin, end, rules_met in zip(texts, begins[hits], ends[hits], mask[hits], strict=True):
            part, zero = data[begin:end].tobytes(), points[offsets[text]]
            for bit, kind in enumerate(KINDS):
                if rules_met >> bit & 1:
                    pattern, group, least = EXACT[kind]
                    for m in pattern.finditer(part):
                        if m.end(group) - m.start(group) >= least:
                            a, b = points[begin + m.start()] - zero, points[begin + m.end()] - zero
                            found[text].append((kind, int(a), int(b)))
    return [spans.ordered(own, KINDS) for own in found]


def find(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """``docs`` with the spans of ``text`` under ``name``: kind, start, end."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton())
    kept = docs.drop(name)

    def run(batches):
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                own = pa.array(slice_spans(sent.value, data, offsets), spans.ARROW)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, own], names=[*batch.schema.names, name]
                )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, spans.SPARK)]))
