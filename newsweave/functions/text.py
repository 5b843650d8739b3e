"""Text functions as Column expressions (normalising, tokens, language, rules, baseline analysis)."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave import constants as K
from newsweave.functions.binding import let

WS = f"[{K.WS_CLASS}]"
# A run of white space that is not a single plain space already.
# The look-ahead passes over printable ASCII.
_UNEVEN_WS = f"(?![!-~])(?:[{K.WS_CLASS.replace(' ', '')}]{WS}*| {WS}+)"
# Characters in which a lead sentence is looked for first.
LEAD_CHARS = 1_000


def _as_class(points: list[int]) -> str:
    """Regex class of the given sorted code points, written as ranges."""
    breaks = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    spans = zip([0, *breaks], [*breaks, len(points)])
    return "[" + "".join(rf"\x{{{points[i]:X}}}-\x{{{points[j - 1]:X}}}" for i, j in spans) + "]"


@lru_cache(maxsize=1)
def _nfkc_sensitive() -> str:
    """Pattern that finds any character NFKC may change, reorder or compose.  The look-aheads keep plain ASCII
    and Latin text away from the long list of ranges."""
    risky = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # conjoining vowels and finals
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        if unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch:
            risky.add(point)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            risky.add(int(parts[1], 16))
    low = _as_class(sorted(p for p in risky if p < 0x300))
    high = _as_class(sorted(p for p in risky if p >= 0x300))
    return rf"(?=[^\x00-\x7F])(?:{low}|(?=[^\x00-\x{{2FF}}]){high})"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def beyond_ascii(text: Column) -> Column:
    """The characters outside ASCII: what a search for one of them has to read."""
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Spark has no such built-in, so the rows that hold a character NFKC can touch go
    through Arrow; every other row sends a null and keeps its own value."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text) & beyond_ascii(text).rlike(_nfkc_sensitive()), text)), text)


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _UNEVEN_WS, " "))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def fold(text: Column) -> Column:
    """Lower-case and collapse white space (input already NFKC)."""
    return collapse_ws(F.lower(text))


def normalize(text: Column) -> Column:
    return fold(nfkc(text))


def word_runs(normalized: Column) -> Column:
    """All runs of letters, marks and numbers, in order."""
    return F.regexp_extract_all(normalized, F.lit(K.WORD_RUN), F.lit(0))


def tokens_of(normalized: Column) -> Column:
    return F.filter(word_runs(normalized), lambda t: (F.length(t) > 1) & ~t.isin(K.STOP_WORDS))


def tokens(text: Column) -> Column:
    return tokens_of(normalize(text))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def detect_language(text: Column, fallback: Column) -> Column:
    """Language of the first script present, in fixed priority; otherwise the caller's language."""
    foreign = F.when(is_ascii(text), "").otherwise(beyond_ascii(text))
    return let(F.struct(foreign.alias("text"), fallback.alias("fallback")), lambda p: _script_language(p["text"], p["fallback"]))


def _script_language(text: Column, fallback: Column) -> Column:
    out = None
    for pattern, code, shared in K.SCRIPT_LANGUAGES:
        value = F.when(fallback == shared, shared).otherwise(code) if shared else F.lit(code)
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    listed = "|".join(pattern for pattern, _, _ in K.SCRIPT_LANGUAGES)
    return F.when((text == "") | ~text.rlike(listed), fallback).otherwise(out.otherwise(fallback))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays without duplicates; two empty sets score 0."""
    common = F.size(F.array_intersect(left, right))
    return let(common, lambda n: n / F.greatest(F.lit(1), F.size(left) + F.size(right) - n))


def lead_sentence(text: Column) -> Column:
    def first(sentences: Column) -> Column:
        return F.get(F.filter(F.transform(sentences, trim_ws), lambda s: F.length(s) > K.MIN_SENTENCE_CHARS), F.lit(0))

    def choose(value: Column) -> Column:
        split = lambda c: F.split(c, rf"(?<=[.!?।]){WS}+")
        # all sentences of the head but its last are whole ones; only a text without a long one among them is split as a whole
        early = let(split(F.substring(value, 1, LEAD_CHARS)), lambda s: first(F.slice(s, F.lit(1), F.size(s) - 1)))
        return F.coalesce(early, first(split(value)), trim_ws(value))

    return let(text, choose)


def java_pattern(pattern: str) -> str:
    r"""Give `\b` and `\w` their ASCII meaning in Java regexes, ignoring case as Unicode does.

    Around a list of words one look-around per side is enough, and a look at the first letter passes over most places; any other `\b` gets the full definition."""
    word = "A-Za-z0-9_"
    plain = re.compile(f"[{word}]")

    def word_list(found: re.Match) -> str:
        options = found[1].split("|")
        ends = [o.rstrip("?+")[-1:] for o in options]
        foreign = lambda c: c.isalpha() and not any(x.isascii() for x in c.lower() + c.upper())
        # an end is a word character, or a letter that is none in any case; the first letter is there for sure
        if not all((plain.match(o) or foreign(o[:1])) and o[1:2] not in ("?", "*", "{") and (plain.match(e) or foreign(e) or o.endswith(r"\w+")) for o, e in zip(options, ends)):
            return found[0]
        groups: dict[tuple[str, str], list[str]] = {}
        for o, e in zip(options, ends):
            left = f"(?<![{word}])" if plain.match(o) else f"(?<=[{word}])"
            right = f"(?![{word}])" if plain.match(e) or o.endswith(r"\w+") else f"(?=[{word}])"
            groups.setdefault((left, right), []).append(o)
        return "(?:" + "|".join(f"(?=[{''.join(sorted({o[0] for o in listed}))}]){left}({'|'.join(listed)}){right}" for (left, right), listed in groups.items()) + ")"

    edge = f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out = re.sub(r"\\b\(([^()]*)\)\\b", word_list, pattern)
    return "(?iu)" + out.replace(r"\b", edge).replace(r"\w", f"[{word}]")


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Ordered rule classifier: label of the first matching pattern."""
    def chain(value: Column) -> Column:
        out = F.when(F.lit(False), "")
        for label, pattern in rules:
            out = out.when(value.rlike(java_pattern(pattern)), label)
        return out.otherwise(default)

    return let(text, chain)


def event_label(title: Column, text: Column, rules=K.EVENT_RULES, default=K.DEFAULT_EVENT) -> Column:
    return classify(F.concat(title, F.lit("\n"), text), rules, default)


def tone_label(
    title: Column, text: Column, positive=K.POSITIVE_TONE, negative=K.NEGATIVE_TONE, negated=K.NEGATED_TONE
) -> Column:
    full = F.concat(title, F.lit("\n"), text)
    flags = let(full, lambda f: F.struct(*[
        f.rlike(java_pattern(p)).alias(n) for n, p in (("pos", positive), ("neg", negative), ("inverted", negated))]))
    return let(flags, lambda f: F.when(f["inverted"], "unclear").when(f["pos"] & f["neg"], "mixed")
               .when(f["pos"], "positive").when(f["neg"], "negative").otherwise("unclear"))


def baseline_analysis(title: Column, text: Column, event_rules=K.EVENT_RULES, tone_rules=None, passage_chars: int | None = None) -> Column:
    """The rule-based analysis struct given to every new article.  Summary and quote are the whole lead sentence, cut to `passage_chars` if given."""
    cut = lambda c: F.substring(c, 1, passage_chars) if passage_chars else c
    tone = tone_label(title, text, *tone_rules) if tone_rules else tone_label(title, text)
    passages = let(lead_sentence(text), lambda s: F.struct(
        F.when(s != "", cut(s)).otherwise(title).alias("summary"),
        cut(F.when(s != "", s).otherwise(title)).alias("quote")))
    impact = "array<struct<stakeholder:string,direction:string,explanation:string>>"
    return let(passages, lambda p: F.struct(
        event_label(title, text, event_rules).alias("event_type"),
        tone.alias("sentiment"),
        p["summary"].alias("summary"),
        F.array(F.struct(F.lit(K.BASELINE_CLAIM).alias("claim"), p["quote"].alias("quote"))).alias("facts"),
        F.array().cast(impact).alias("impacts"),
        F.lit(K.BASELINE_UNCERTAINTY).alias("uncertainty"),
        F.lit("baseline").alias("mode"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("translated_title"),
        F.lit(None).cast("string").alias("translated_text"),
    ))


def quote_supported(quote: Column, original: Column) -> Column:
    """The trimmed quote is long enough and occurs in the original after normalising both."""
    return (F.length(trim_ws(quote)) >= K.QUOTE_MIN_CHARS) & F.contains(normalize(original), normalize(quote))


def citation_markers(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
