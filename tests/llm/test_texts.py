"""What runs inside tasks, against plain versions: words, spans, encodings, fingerprints, merging."""

import json
import random

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rulemesh.llm import automaton, bpe, common, decontaminate, fingerprint, langid, minhash, pii, secrets, toxicity, warc

ODD = ["", " ", "\n\n", "a", "a b", "é中 \U0001f642", "\x1c\x85x", "a" * 3000, "x y " * 2000, "À K ſ"]


def slices(texts):
    return [(data, offsets) for _, _, data, offsets in common.text_slices(pa.array(texts, pa.string()), 500)]


def test_slices_hold_whole_texts():
    texts = [*ODD, None, "b" * 999, None]
    got = [data[a:b].tobytes() for data, offsets in slices(texts) for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [(t or "").encode() for t in texts]
    assert slices([]) == []


def test_words_and_shingles():
    texts = [*ODD, "One two THREE four five six", "one two three four five six", "One two three four"]
    names = {}
    for data, offsets in slices(texts):
        own = common.Words(data, offsets)
        got = [data[a:b].tobytes() for a, b in zip(own.start, own.end)]
        expected = [plain.WORDS.findall(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        assert got == [w for text in expected for w in text]
        assert np.diff(own.first).tolist() == list(map(len, expected))
        hashes, places = common.shingles(own)
        for i, text in enumerate(expected):
            wanted = plain.shingles(b" ".join(text).decode())
            for shingle, h in zip(wanted, hashes[places[i] : places[i + 1]].tolist(), strict=True):
                assert names.setdefault(shingle, h) == h
    assert len(set(names.values())) == len(names)


def test_minmax_bands_of_equal_and_disjoint_sets():
    own = common.mixed(np.arange(40, dtype=np.uint64))
    other = common.mixed(np.arange(1000, 1040, dtype=np.uint64))
    one, two = minhash.bands(*minhash.signature(own)), minhash.bands(*minhash.signature(other))
    assert len(one) == minhash.BANDS and not set(one.tolist()) & set(two.tolist())
    # The signature votes for the similarity without bias.
    near = np.concatenate([own[:30], other[:10]])
    agree = np.mean([np.concatenate(minhash.signature(own)) == np.concatenate(minhash.signature(near))])
    assert abs(agree - 30 / 50) < 0.12


AUTOMATON = secrets.automaton()
PIECES = {
    "secrets": ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "A9", "a", "0", "é", "ſecret", ".", "\n", "abcdef01", "ABCDEF12", "-", "/", "deadbeef" * 4],
    "personal": ["@", "a", "Z9", "_", "%", "+", "-", ".", "1", "22", "255", "256", "+1", " ", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+49 (30) 1234-567", "é", "\n", "ex.com", "1.2.3.4", "٣", "0001"],
}


def drawn(kind, n=600):
    draw = random.Random(kind)
    return ["".join(draw.choices(PIECES[kind], k=draw.choice([0, 1, 4, 25, 120]))) for _ in range(n)]


def test_secret_spans():
    texts = drawn("secrets") + ODD
    got = [own for data, offsets in slices(texts) for own in secrets.slice_spans(AUTOMATON, data, offsets)]
    for text, own in zip(texts, got, strict=True):
        base = [f"{x['kind']}:{x['start']}:{x['end']}" for x in own if x["kind"] in secrets.BASE]
        assert base == plain.spans(text, plain.SECRETS, secrets.BASE), text


def test_more_secrets():
    text = "ghp_" + "Zq" * 18 + " xoxb-1234567890 -----BEGIN RSA PRIVATE KEY-----"
    (data, offsets), = slices([text])
    kinds = [x["kind"] for x in secrets.slice_spans(AUTOMATON, data, offsets)[0]]
    assert kinds == ["code_host", "chat", "private_key"]


@pytest.mark.parametrize("pattern, yes, no", [("ab*c", "xabbbc", "abx"), ("(a|bc)+d", "bcad", "bd"), ("a{3}", "aaa", "aa"), ("[^-]", "^", "a"), ("x?yz", "yz", "xz")])
def test_rules_of_the_automaton(pattern, yes, no):
    made = automaton.compile_rules([(pattern, False)])
    for text, met in ((yes, 1), (no, 0)):
        data = np.frombuffer(text.encode(), np.uint8)
        assert automaton.scan(made, data, np.array([0]), np.array([len(data)])).tolist() == [met]


def test_minimal_automaton():
    twice = automaton.compile_rules([("ab|cb", False)])
    assert len(twice.mask) == 3  # start, after a or c, after b


def test_personal_spans_and_redaction():
    anchors = pii.anchors()
    for text in drawn("personal") + ODD:
        own = pii.find_in(text, anchors)
        base = [f"{x['kind']}:{x['start']}:{x['end']}" for x in own if x["kind"] in pii.BASE]
        assert base == plain.spans(text, plain.PERSONAL, pii.BASE), text
    text = "to a.b@c.org, IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, ftp://me:pw@h/"
    clean = pii.redacted(text, pii.find_in(text, anchors))
    assert clean == "to [EMAIL], IBAN [IBAN], ssn [SSN], ftp://[USERINFO]@h/"


@pytest.mark.parametrize("follows", ["", " BIC COBADEFFXXX", " Please pay", " 2024", " A", "\n2024", ", x", " now", "BIC"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"])
def test_ibans_before_other_words(iban, follows):
    text = f"IBAN: {iban}{follows}"
    got = pii.find_in(text, pii.anchors())
    assert [text[x["start"] : x["end"]] for x in got if x["kind"] == "iban"] == [iban]


def test_ibans_of_unlisted_countries_and_wrong_ones():
    anchors = pii.anchors()
    ibans = lambda text: [text[x["start"] : x["end"]] for x in pii.find_in(text, anchors) if x["kind"] == "iban"]
    assert ibans("iban DZ580002100001113000000570 BIC 2024") == ["DZ580002100001113000000570"]
    assert ibans("IBAN DE88370400440532013000 BIC") == ibans("IBAN DE8937040044053201300") == []
    assert ibans("IBAN DE89370400440532013000 IBAN NO9386011117947 X") == ["DE89370400440532013000", "NO9386011117947"]


@pytest.mark.parametrize("cue", ["Social security number: ", "social Security No. ", "SOCIAL SECURITY NUMBER ", "Social Security Number: ", "Ssn ", "sSn: ", "İ social SECURITY "])
def test_cues_in_any_case(cue):
    text = f"{cue}123-45-6789 iBaN Number DE89370400440532013000 BIC"
    assert pii.redacted(text, pii.find_in(text, pii.anchors())) == f"{cue}[SSN] iBaN Number [IBAN] BIC"


SPEC = bpe.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_by_chunks_is_that_of_the_whole_text():
    tokenizer = Tokenizer.from_str(SPEC)
    encoder, decoder = bpe.Encoder(SPEC), bpe.Decoder(SPEC)
    draw = random.Random(3)
    parts = [*"aAbB zZ'\t\n.,019", "<|endoftext|>", "<|ENDOFTEXT|>", "́", "̇", "İ", "Σ", " ", "　", "\x1c", "\x85", "é", "é", "ß", "漢", "\U0001f642", "'s", "'LL", "\x00", "ſ", "Å", "word ", "passage of words "]
    texts = ["".join(draw.choices(parts, k=draw.choice([0, 1, 9, 60, 900]))) for _ in range(150)] + ODD
    for _ in range(2):  # the second time from the stores
        got = [x for _, _, data, offsets in common.text_slices(pa.array(texts)) for x in encoder.encode_slice(data, offsets)]
        for text, ids in zip(texts, got, strict=True):
            expected = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected, text
            assert decoder.decode(np.frombuffer(ids, "<u4")).decode() == tokenizer.decode(expected, skip_special_tokens=False)
    assert encoder.chunks


def test_stores_are_bounded_and_stay_right(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(bpe, "MAX_SEEN", 5)
    tokenizer, encoder = Tokenizer.from_str(SPEC), bpe.Encoder(SPEC, 1400)
    draw = random.Random(5)
    for _ in range(40):
        text = " ".join(draw.choices(["alpha", "beta.", "gamma,", "delta", "été", "x1"], k=400))
        (data, offsets), = [x[2:] for x in common.text_slices(pa.array([text]))]
        (ids,) = encoder.encode_slice(data, offsets)
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.words) <= 8 and len(encoder.words.older) <= 8


def own_tokenizer(pattern):
    """The dealt tokenizer with another word pattern and a merge of a letter and a mark."""
    spec = json.loads(SPEC)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = pattern
    model = spec["model"]
    model["vocab"]["g.</w>"] = len(model["vocab"]) + 10
    model["merges"].insert(0, "g .</w>" if isinstance(model["merges"][0], str) else ["g", ".</w>"])
    return json.dumps(spec)


@pytest.mark.parametrize(
    "pattern", [r"[^\s]+", r"[\p{L}.]+|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"'s|'t|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
)
def test_marks_stand_apart_only_where_the_pattern_says_so(pattern):
    spec = own_tokenizer(pattern)
    tokenizer, encoder = Tokenizer.from_str(spec), bpe.Encoder(spec)
    for text in ("a thing. of", "sing.g. (g.) x-g.'s it's 'tis 1g.", "don't you'll <|endoftext|>g. <|endoftext|>"):
        (data, offsets), = [x[2:] for x in common.text_slices(pa.array([text]))]
        (ids,) = encoder.encode_slice(data, offsets)
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ascii_words_are_split_as_the_tokenizer_does():
    tokenizer, encoder = Tokenizer.from_str(SPEC), bpe.Encoder(SPEC)
    assert encoder.words.plain
    draw = random.Random(8)
    marks = "".join(map(chr, range(33, 127)))
    for _ in range(3000):
        word = "".join(draw.choice([draw.choice(marks), draw.choice("abst019'"), "'ll", "<|", "|>"]) for _ in range(draw.randrange(1, 9)))
        (data, offsets), = [x[2:] for x in common.text_slices(pa.array([word]))]
        (ids,) = encoder.encode_slice(data, offsets)
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space"):
        bpe.Encoder(bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))


def prints(texts):
    return [p for _, _, data, offsets in common.text_slices(pa.array(texts)) for p in fingerprint.fingerprints(data, offsets)]


def test_fingerprints_depend_on_the_text_alone():
    draw = random.Random(7)
    passage = " ".join("".join(draw.choices("abcdefg", k=5)) for _ in range(300))
    texts = [passage, "", "x", passage, "y" + passage, "aaaa" * 50, passage]
    got = prints(texts)
    assert got[0].tolist() == got[3].tolist() == got[6].tolist() == prints([passage])[0].tolist()
    assert not len(got[1]) and fingerprint.likeness(got[1], got[1]) == 1.0 and fingerprint.likeness(got[0], got[1]) == 0.0
    assert fingerprint.likeness(got[0], got[4]) > 0.9  # the same passage at another offset
    assert fingerprint.likeness(got[0], got[0]) == 1.0
    other = prints([" ".join("".join(draw.choices("hijklmn", k=5)) for _ in range(300))])[0]
    assert fingerprint.likeness(got[0], other) < 0.1


def test_edited_text_counts_code_points():
    assert fingerprint.edited("é中abü".encode(), "\U0001f642z".encode()) == (5, "é中a\U0001f642z".encode())
    assert fingerprint.edited(b"", b"abc") == (0, b"")
    assert fingerprint.edited(b"abcdef", b"x") == (6, b"abcx")


def test_leaks_against_all_windows():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)] + ["Rare%d" % i for i in range(60)]
    say = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = {i: say(draw.choice([1, 3, 4, 5, 6, 12, 30])) for i in range(25)} | {98: "", 99: " \n"}
    texts = ["", None, "w1", *(say(n) for n in (2, 5, 9, 40))]
    for _ in range(60):
        passage = items[draw.randrange(25)].upper().split()
        for _ in range(draw.choice([0, 0, 1, 2])):
            passage[draw.randrange(len(passage))] = "changed"
        texts.append(" ".join([say(draw.choice([0, 3, 20])), *passage, say(draw.choice([0, 5]))]).strip())
    index = decontaminate.Index(list(items), pa.array(items.values()))
    got = [own for data, offsets in slices(texts) for own in index.slice_matches(data, offsets)]
    for text, own in zip(texts, got, strict=True):
        assert {k: round(v[0], 9) for k, v in own.items()} == {k: round(v, 9) for k, v in plain.leaks(text, items).items()}, text
    assert sum(map(bool, got)) > 30


def test_leaks_with_repeated_shingles():
    draw = random.Random(13)
    items, texts = {}, []
    for i in range(40):
        base = " ".join(f"v{draw.randrange(10**6)}" for _ in range(184))
        ends = [" ".join([f"{c}{i}"] * 30) for c in "xy"] + [" ".join(f"u{draw.randrange(10**6)}" for _ in range(30))]
        items[i] = f"{base} {ends[draw.choice([0, 2])]}"
        texts += [f"{base} {e}" for e in ends] + [f"before {base} {ends[1]} after"]
    index = decontaminate.Index(list(items), pa.array(items.values()))
    got = [own for data, offsets in slices(texts) for own in index.slice_matches(data, offsets)]
    for text, own in zip(texts, got, strict=True):
        assert {k: round(v[0], 9) for k, v in own.items()} == {k: round(v, 9) for k, v in plain.leaks(text, items).items()}, text


def test_multi_index_finds_all_within_the_radius():
    draw = np.random.default_rng(5)
    group = decontaminate.Group(30)
    group.ids = list(range(200))
    group.shingles = [draw.integers(0, 1 << 63, 26).astype(np.uint64) for _ in group.ids]
    group.finish()
    near = group.prints.copy()
    for row in near:  # at most RADIUS flipped bits
        for bit in draw.choice(64, decontaminate.RADIUS, replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    window, item = group.candidates(near)
    assert set(range(200)) == {w for w, i in zip(window.tolist(), item.tolist()) if w == i}


def test_loser_tree():
    draw = random.Random(1)
    for k in [*range(9), 40]:
        runs = [sorted(draw.choices(range(30), k=draw.choice([0, 1, 3, 10]))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_records_of_an_archive():
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(b"HTTP/1.1 200\r\n\r\n"))
    one = b"WARC/1.1\r\nContent-Length: 9\r\nA:\r\n\r\nWARC/1.1\n\r\n\r\n"
    assert [(o, n, p) for o, n, _, p in warc.records(one * 2)] == [(0, len(one), b"WARC/1.1\n"), (len(one), len(one), b"WARC/1.1\n")]


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len({tuple(row) for row in code.tolist()}) == n
    if n > 2:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, code.shape[1])))
    margin = 3 * code.copy()
    margin[:, 0] *= -0.3
    assert langid.decode(model, margin)[0].tolist() == [0, 1, 2, 3]


def test_ftrl_learns_telling_words_and_little_else():
    draw = random.Random(2)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(300)]
    marked = [t + " rotten apple" if i % 4 == 0 else t for i, t in enumerate(texts)]
    rows = [(b, int(i % 4 == 0)) for i, b in enumerate(toxicity._distinct_features(pa.array(marked)))]
    learnt = toxicity.ftrl(rows)
    assert 0 < len(learnt.bucket) < 50
    dense = np.zeros(1 << toxicity.BITS, np.float32)
    dense[learnt.bucket] = learnt.weight
    good, bad, empty = toxicity.scores(pa.array(["plain w1 w2", "w3 rotten apple w4", None]), dense, learnt.bias)
    assert good < 0.5 < bad and empty < 0.5


def test_spanning_links_join_what_all_links_join():
    draw = random.Random(13)
    base = list(range(40))
    sets = [set(draw.sample(base, draw.randint(20, 40))) | {100 * i + j for j in range(draw.randint(0, 6))} for i in range(1, 60)]
    sets += [set(), {7}, {7}, set(sets[0])]
    labels = np.arange(len(sets))
    labels[5] = labels[3]

    def joined(links):
        group = {i: {i} for i in range(len(sets))}
        for i, j in [*links, (3, 5)]:
            both = group[i] | group[j]
            for k in both:
                group[k] = both
        return {i: min(g) for i, g in group.items()}

    every = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    got = minhash.spanning_links(np.arange(len(sets)), labels, arrays)
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in every}
    assert joined(got) == joined(every) and len(got) < len(sets)
    assert minhash.spanning_links(np.zeros(0, int), np.zeros(0, int), []) == []
