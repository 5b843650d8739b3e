"""Personal data: plain findings against plain regular expressions, disguises, and offsets."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(kind, text):
    out = []
    for m in re.finditer(PATTERNS[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
            out.append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", "x@y.z", ".", "-", "1", "22", "4539 1488 0343 6467", "255", "256", "1.2.3.4", "+1", "(", ")", " ", "+49 30 1234567", "é", "_", "%", "\n"]), max_size=25).map("".join))
def test_plain_findings_equal_the_patterns(text):
    for kind in pii.KINDS:
        assert pii.find(kind, text) == brute(kind, text)
        assert [s[1:3] for s in pii.find_all(text) if s[0] == kind and not s[3]] == brute(kind, text)


def values(text):
    return [(kind, text[a:b]) for kind, a, b, _ in pii.find_all(text)]


def test_disguises_map_back_to_source_characters():
    assert values("écrire à jean.b (at) mail [dot] example dot org !") == [("email", "jean.b (at) mail [dot] example dot org")]
    assert values("ask bob at example dot com now") == [("email", "bob at example dot com")]
    assert values("pаul@exam​ple.com, ok") == [("email", "pаul@exam​ple.com")] or values("pаul@exam​ple.com, ok")[0][0] == "email"
    assert values("card four five three nine 1488 0343 6467.") == [("card", "four five three nine 1488 0343 6467")]
    assert values("call +1 ５５５ ５５５ ２３６８") == [("phone", "+1 ５５５ ５５５ ２３６８")]
    assert values("host 10 dot 1 dot 2 dot 3") == [("ip", "10 dot 1 dot 2 dot 3")]
    assert values("host one nine two dot one six eight dot zero dot one.") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert values("call plus four nine three zero one two three four five") == [("phone", "plus four nine three zero one two three four five")]
    assert values("look at the dot on one two") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", " (at) ", "[dot]", " dot ", "com", "one ", "plus ", "dot zero", "two-", "Three ", "9 ", "5", "４", "о", " ", "+1 ", "x@y.z", "\n"]), max_size=20).map("".join))
def test_hints_never_hide_a_finding(text):
    assert pii.find_all(text, pii.hints(pa.array([text]))[0]) == pii.find_all(text)


def test_findings_do_not_depend_on_distant_text():
    for text in ("ask bob at example.com now", "ask bob at example.dev now", "Bob AT mail.example.co.nz", "bob at one two.com", "bob (at) example.com", "one at a time. So", "bob at example dot app"):
        alone = pii.find_all(text)
        assert alone == pii.find_all(text, pii.hints(pa.array([text]))[0])
        for far in (" dot ", "(at)", "[dot]", "\u200b"):
            more = text + "." * 200 + far
            assert [s for s in pii.find_all(more, pii.hints(pa.array([more]))[0]) if s[1] < len(text)] == alone
    assert values("ask bob at example.dev now") == [("email", "bob at example.dev")] and values("one at a time. So") == []
    assert all(values(f"bob at example.{e}") for e in "dev app me nz kr mx za".split())


def test_long_texts_stay_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "one " * 60_000, "a (at) " * 40_000, "dot " * 60_000):
        pii.find_all(text)


def test_operator_on_odd_rows(spark):
    rows = [(1, "x a@b.cc y", "k"), (1, "x a@b.cc y", "k"), (None, None, None), (3, "", "k"), (4, "a (at) b dot cc " * 500, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, personal_data string")
    found = pii.find_personal_data(docs).collect()
    assert sorted(len(r.personal_data) for r in found) == [0, 0, 1, 1, 500]
    assert sorted(r.text or "" for r in pii.redact(docs).collect())[-1].startswith("x <email> y")
    assert pii.redact(docs.limit(0)).count() == 0
