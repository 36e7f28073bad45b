"""Slow, plain versions of what the corpus operators compute."""

import itertools
import re
from collections import Counter

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall((text or "").encode().lower())


def shingles(text, size=5):
    own = words(text)
    return [tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []


def components(texts):
    """doc -> smallest doc reachable over pairs with 100 * intersection >= 75 * union."""
    sets = {doc: set(shingles(text)) for doc, text in texts.items()}
    parent = {doc: doc for doc in texts}

    def find(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), find(doc)) for doc in texts}


def leaks(text, items):
    """item -> greatest weighted similarity of a window of the item's length, if 0.75 or more."""
    own, found = words(text), {}
    for item, passage in items.items():
        wanted = Counter(shingles(passage))
        size = len(words(passage))
        if not wanted or not own or (size < 5 and len(own) < size):
            continue
        for start in range(max(1, len(own) - size + 1)):
            window = own[start : start + size]
            if size < 5:
                had = Counter([tuple(window)])
            else:
                had = Counter(tuple(window[i : i + 5]) for i in range(max(1, len(window) - 4)))
                if len(window) < 5:
                    continue
            least, most = sum((had & wanted).values()), sum((had | wanted).values())
            if 100 * least >= 75 * most:
                found[item] = max(found.get(item, 0), least / most)
    return found


def spans(text, rules, order):
    """kind:start:end of all base matches that pass their test."""
    found = [
        (m.start(), order.index(kind), f"{kind}:{m.start()}:{m.end()}")
        for kind, (pattern, passes) in rules.items()
        for m in re.finditer(pattern, text)
        if passes(m)
    ]
    return [x[2] for x in sorted(found)]


def digits(match):
    return re.sub("[^0-9]", "", match[0])


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}
SECRETS = {
    "assign": (
        r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m[1]) >= 8,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}
