import hashlib
import random
import re
import time

import pytest

from palimpsest.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_plain_spans_match_the_patterns():
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choices(["1", "4", "0", "25", "+", ".", "-", " ", "(", ")", "@", "a", "Z", "_", "%", "é", "9807915762804490", "10.0.0.1", "a@b.co", "+1 555 123 4567"], k=r.randint(0, 14)))
        assert pii.plain_spans(t) == brute(t), t


@pytest.mark.parametrize("text,kind,found", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john dot doe at example dot co dot uk", "email", "john dot doe at example dot co dot uk"),
    ("write to bob(at)site.org", "email", "bob(at)site.org"),
    ("jоhn＠exаmple．com", "email", "jоhn＠exаmple．com"),
    ("call + one five five five, two three four five six seven eight now", "phone", "+ one five five five, two three four five six seven eight"),
    ("plus vier neun drei null eins zwei drei vier fünf sechs sieben", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
    ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
    ("max at firma punkt de", "email", "max at firma punkt de"),
    ("zoé écrit à luc arobase site point fr", "email", "luc arobase site point fr"),
    ("john @ example . com", "email", "john @ example . com"),
    ("john&#64;example.com", "email", "john&#64;example.com"),
    ("john&commat;example&period;com", "email", "john&commat;example&period;com"),
    ("+49 double three one five two triple seven six", "phone", "+49 double three one five two triple seven six"),
    ("plus four nine doppel drei 1 5 2 double 7 seis", "phone", "plus four nine doppel drei 1 5 2 double 7 seis"),
    ("ip 192[.]168[.]1[.]1 ok", "ip", "192[.]168[.]1[.]1"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("41​11111111111111", "card", "41​11111111111111"),
    ("4111 1111 llll 1111", None, None),
    ("4111 1111 1l11 1111", "card", "4111 1111 1l11 1111"),
])
def test_disguises(text, kind, found):
    added = [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.plain_spans(text))]
    assert added == ([(kind, found)] if kind else [])


@pytest.mark.parametrize("text", ["look at example.com", "arrive at this point in time", "bob and I @ home. Then we left", "a double three shot", "we met at noon. dot dot", "un deux trois soleil", "See you at seven at the point of no return", "eins und zwei", "the point is at hand", "café №5 — déjà vu", "a (at) b", "x"])
def test_prose_is_left_alone(text):
    assert pii.added_spans(text, pii.plain_spans(text)) == [] and pii.redacted(text, pii.plain_spans(text)) == text


def test_query_columns_and_edge_cases(spark):
    long = "wörd " * 30_000 + "me@example.com"
    rows = [(1, "a a@b.co 10.0.0.1", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (1, "a a@b.co 10.0.0.1", "x"), (None, "+1 555 123 4567", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, plain string")
    got = {(r["doc_id"], r["n_phone"]): r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert len(got) == 5
    assert got[1, 0]["spans"] == "email:2:8,ip:9:17" and got[1, 0]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert got[2, 0]["spans"] == got[3, 0]["spans"] == "" and got[4, 0]["spans"] == "email:150000:150014" and got[None, 1]["n_card"] == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[1] == "a <EMAIL> <IP>" and out[2] is None and out[None] == "<PHONE>"
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.digest(pii.find_pii(empty)).collect() == []


def test_overlapping_spans_are_redacted_once():
    assert pii.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<CARD>f"


@pytest.mark.parametrize("text,found", [("call plus 44 20 7946 0958 now", "plus 44 20 7946 0958"), ("+44 dash 20 dash 79460958", "+44 dash 20 dash 79460958"), ("+44 hyphen 20 hyphen 79460958", "+44 hyphen 20 hyphen 79460958")])
def test_disguises_around_figures(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, [])] == [("phone", found)]
    assert pii.redacted(text, pii.added_spans(text, [])) == text.replace(found, "<PHONE>")


def test_hint_leaves_no_rewrite_out(monkeypatch):
    r = random.Random(11)
    parts = ["plus", "+", "dash", "hyphen", "Dash", "five", "vier", "cero", "dot", "punto", "punkt", "at", "arroba", "double", "triple", "&#64;", "&period;", "[at]", "(dot)", "[.]", "@", "44", "7", "1l1", "4O4", "x", "joe", "site.org", "é", "_"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", " ", "-", ", ", ".", "", "\n"]) for _ in range(r.randint(1, 9))) for _ in range(30_000)]
    hinted = [pii.normalise(t) for t in texts]
    monkeypatch.setattr(pii, "_HINT", re.compile(""))
    assert [t for t, n in zip(texts, hinted, strict=True) if pii.normalise(t) != n] == []


def disguised(r, kind):
    """An identifier in a random disguise: text, whether it is disguised, in pieces that each stand for a character or more."""
    words = [w.split() for w in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve")]
    digits = lambda n: [r.randint(0, 9) for _ in range(n)]
    if kind == "email":
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" arroba ", " punto "), (" @ ", " . "), ("&#64;", "."), ("＠", "．"), ("\u200b@", ".\u200b")])
        name = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
        return name() + at + dot.join(name() for _ in range(r.randint(2, 3)))
    if kind == "ip":
        dot = r.choice(["[.]", " (dot) ", "．", " dot "])
        return dot.join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = digits(15)
        d.append(next(x for x in range(10) if luhn("".join(map(str, [*d, x])))))
        return r.choice(["".join(chr(0xFF10 + x) for x in d), "\u200b".join(map(str, d)), " ".join(r.choice(words)[x] for x in d)])
    d, own = digits(r.randint(10, 13)), r.choice(words)
    return r.choice(["plus ", "+ ", "+"]) + " ".join(own[x] for x in d)


def test_planted_disguises_are_found_where_they_stand():
    """Random identifiers in random disguises among prose: exactly they are found, from their first to their last character."""
    r = random.Random(21)
    prose = lambda: " ".join(r.choices(["the", "house", "stood", "über", "la", "casa;", "we", "saw,", "naïve", "things.", "(more)"], k=r.randint(0, 12)))
    for _ in range(4000):
        text, want = prose() + " said: ", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice(pii.KINDS)
            own = disguised(r, kind)
            want.append((kind, len(text), len(text) + len(own)))
            text += own + "; " + prose() + " said: "
        plain = pii.plain_spans(text)
        assert plain == [] and pii.added_spans(text, plain) == want, text


def test_a_disguise_takes_only_its_own_text():
    """Plain identifiers beside disguises stay plain, and none is found twice."""
    text = "a@b.co, 10.0.0.1; then joe [at] site [dot] org and 10[.]0[.]0[.]2"
    plain = pii.plain_spans(text)
    assert [text[a:b] for _, a, b in plain] == ["a@b.co", "10.0.0.1"]
    assert [text[a:b] for _, a, b in pii.added_spans(text, plain)] == ["joe [at] site [dot] org", "10[.]0[.]0[.]2"]


@pytest.mark.parametrize("bit", ["a dot ", " ", "(", "( ", "a at b dot c ", "a at ", "a @ ", "one ", "plus ", "1 ", "a . ", "[ \n", "double ", "b."])
def test_long_rows_of_one_thing_take_time_in_proportion(bit):
    took = []
    for size in (40_000, 320_000):
        text = "a dot b, x at " + bit * (size // len(bit)) + " seven@a.bc"
        began = time.process_time()
        pii.added_spans(text, pii.plain_spans(text))
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.05)


def test_more_disguises_are_found():
    for text in ("john%40example.com", "john&#x0040;example&#x002e;com", "john&#064;example&#0046;com", "john@example。com", "john dot smith at mail dot example dot com", "john (at) example%2ecom"):
        assert pii.added_spans(text, pii.plain_spans(text)) == [("email", 0, len(text))]
    text = "plus four nine oh one two three four five six seven eight"
    assert pii.added_spans(text, []) == [("phone", 0, len(text))]


def test_addresses_do_not_overlap():
    assert pii.addresses("a at b dot c at d dot e") == [(0, 12)]
    assert pii.addresses("x a dot b at c dot d y e at f dot g") == [(2, 20), (23, 35)]
    assert pii.addresses("  at b dot c") == [] and pii.addresses("a \n at \t b punkt c") == [(0, 18)]


def test_numbers_with_many_zeros():
    assert pii.plain_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)]
    assert pii.plain_spans("1.2.3." + "9" * 6000) == []
