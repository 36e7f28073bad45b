"""Personal data in texts, by anchors and local parsers.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digit
pairs, digits around a dot, schemes and identifier cues in any case. From each anchor a deterministic
parser expands to the borders of what it may be and validates it; text without
anchors is never looked at again. A parser moves over its characters once, so
long runs cost their length. Anchors inside a place already parsed for the same kind are
passed over, which makes matches leftmost and not overlapping within a kind.

Null texts count as empty and have no spans; places are code points, ends exclusive.
Repeated rows are scanned each. Other columns are kept.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm import spans
from rulemesh.llm.common import batch_slices, fresh

BASE = ("email", "ip", "card", "phone")
MORE = ("userinfo", "iban", "ssn")
KINDS = BASE + MORE

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_DOTTED = frozenset(_DIGITS + ".")
_SPACED = frozenset(_DIGITS + " -")
_PHONE = re.compile(r"[ ().0-9-]*")
_CUE_GAP = r"[:#\s]{0,3}(?i:no\.?|number|nr\.?)?[:#\s]{0,3}"
_IBAN = re.compile(_CUE_GAP + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_IBAN_LEAST = 15
#: Characters of an IBAN by country, without blanks (ISO 13616 registry).
_IBAN_SIZE = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(_CUE_GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:]+(?=@)")


def anchors() -> ahocorasick.Automaton:
    """Anchor texts, in lower case, with the kind they start and where the place stands from the
    anchor's end."""
    found: dict[str, str] = {"@": "email", "://": "userinfo"}
    for a in _DIGITS:
        found["+" + a] = "phone"
        for b in _DIGITS:
            found[f"{a}.{b}"] = "ip"
            found[a + b] = found[f"{a} {b}"] = found[f"{a}-{b}"] = "card"
    for cue, kind in (("iban", "iban"), ("ssn", "ssn"), ("social security", "ssn")):
        found[cue] = kind
    made = ahocorasick.Automaton()
    for text, kind in found.items():
        made.add_word(text, (kind, len(text)))
    made.make_automaton()
    return made


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _mod97(own: str) -> bool:
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _iban_end(text: str, a: int, b: int) -> int | None:
    """The end of the IBAN at ``a``, which may be followed by words up to ``b``: by its country's
    size, for other countries the last border of a word at which the check digits hold."""
    places = [i for i in range(a, b) if text[i] != " "]
    own = "".join(text[i] for i in places)
    size = _IBAN_SIZE.get(own[:2])
    for n in (size,) if size else range(len(own), _IBAN_LEAST - 1, -1):
        if n <= len(own) and _mod97(own[:n]):
            end = places[n - 1] + 1
            if size or not text[end : end + 1].isalnum():
                return end
    return None


def _lower(text: str) -> str:
    """``text`` with ASCII letters in lower case, which moves no place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _region(text: str, at: int, floor: int, allowed: frozenset) -> tuple[int, int]:
    a = b = at
    while a > floor and text[a - 1] in allowed:
        a -= 1
    while b < len(text) and text[b] in allowed:
        b += 1
    return a, b


def _addresses(text: str, a: int, b: int):
    """Groups of four digit runs with a dot between."""
    runs = [m.span() for m in _RUN.finditer(text, a, b)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(four[k][1] + 1 == four[k + 1][0] for k in range(3)):
            if all(e - s < 4 or not text[s:e].lstrip("0")[3:] for s, e in four) and all(
                int(text[s:e][-4:]) <= 255 for s, e in four
            ):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _cards(text: str, a: int, b: int):
    """Chains of digit runs with one space or hyphen between."""
    start = end = None
    for m in [*_RUN.finditer(text, a, b), None]:
        if m is not None and start is not None and m.start() == end + 1:
            end = m.end()
            continue
        if start is not None and end - start <= 2 * 19:
            digits = text[start:end].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield start, end
        if m is not None:
            start, end = m.span()


def find_in(text: str, automaton: ahocorasick.Automaton) -> list[dict]:
    """The spans of one text."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton.iter(_lower(text)):
        at = last + 1 - size
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1)
            if start < at and domain:
                found.append(("email", start, domain.end()))
                done["email"] = domain.end()
        elif kind == "ip":
            a, b = _region(text, at, done["ip"], _DOTTED)
            found += (("ip", *x) for x in _addresses(text, a, b))
            done["ip"] = b
        elif kind == "card":
            a, b = _region(text, at, done["card"], _SPACED)
            found += (("card", *x) for x in _cards(text, a, b))
            done["card"] = b
        elif kind == "phone":
            end = _PHONE.match(text, at + 1).end()
            run = text[at + 1 : end].rstrip(" ().-")
            end = at + 1 + len(run)
            if end >= at + 4:
                if 9 <= sum(c in _DIGITS for c in run) <= 15:
                    found.append(("phone", at, end))
                done["phone"] = end
        else:
            rule = {"iban": _IBAN, "ssn": _SSN, "userinfo": _USERINFO}[kind]
            m = rule.match(text, last + 1)
            a, b = (m.span(1) if kind != "userinfo" else m.span()) if m else (0, None)
            if b and kind == "iban":
                b = _iban_end(text, a, b)
            if b:
                found.append((kind, a, b))
                done[kind] = b
    return spans.ordered(found, KINDS)


def redacted(text: str, own: list[dict]) -> str:
    """``text`` with each place, or run of overlapping places, replaced by its first kind."""
    out, at, open_end = [], 0, 0
    for x in own:
        if x["start"] >= open_end:
            out += (text[at : x["start"]], f"[{x['kind'].upper()}]")
            at = x["end"]
        open_end = max(open_end, x["end"])
        at = max(at, open_end)
    return "".join([*out, text[at:]])


def _with(docs: DataFrame, name: str, kind: T.DataType, made) -> DataFrame:
    kept = docs.drop(name)

    def run(batches):
        automaton = anchors()
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                raw = data.tobytes()
                texts = (
                    raw[a:b].decode("utf-8", "replace")
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, made(automaton, texts)], names=[*batch.schema.names, name]
                )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, kind)]))


def find(docs: DataFrame, name: str = "personal") -> DataFrame:
    """``docs`` with the spans of ``text`` under ``name``: kind, start, end."""
    return _with(
        docs, name, spans.SPARK, lambda automaton, texts: pa.array([find_in(t, automaton) for t in texts], spans.ARROW)
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the places replaced in ``text``, and ``n_chars`` the new length; a null
    text stays null. Columns unchanged."""
    name = fresh(docs, "redacted")
    made = _with(
        docs,
        name,
        T.StringType(),
        lambda automaton, texts: pa.array([redacted(t, find_in(t, automaton)) for t in texts], pa.string()),
    )
    text = F.when(F.col("text").isNotNull(), F.col(name))
    values = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return made.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))
