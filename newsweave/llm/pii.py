"""Personal data in texts, also when disguised, with exact source offsets.

Three transducers rewrite a text and keep, for every character of their output, the span of source characters it
came from: look-alike and zero-width characters, spelled digits, and at/dot disguises.  Identifiers are detected in the
rewritten text and their spans are mapped back.  A disguised finding is added only if it covers a rewritten character and touches no
finding of its kind in the plain text, so the plain findings always stay.

Detection is linear in the length of the text.  Per kind, matches are leftmost and do not overlap; a match that fails its test is
dropped and the search goes on behind it.

Defined results: null text counts as empty and has no findings; repeated rows are judged each on their own; a column of the input named
like an output column is replaced; an empty table gives an empty result."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsweave.llm.common import slices
from newsweave.llm.host_endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
SLICE = 8 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only: from a later one the outcome would be the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters that look like ASCII letters, digits and signs.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。．﹒＠﹫‐‑‒–—−", "aeopcyxijsdhlABEKMHOPCTXIJSaopviABEZHIKMNOPTYX....@@------"))
ZERO_WIDTH = "​‌‍⁠﻿­"
DIGIT_NAMES = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WIDE = {chr(c): n for first, last in ((0xFF10, 0xFF5E), (0x1D400, 0x1D7FF), (0x2460, 0x2468), (0x24B6, 0x24E9))
         for c in range(first, last + 1) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
_SINGLE = {**_WIDE, **LOOK_ALIKES, **dict.fromkeys(ZERO_WIDTH, "")}
_ODD = re.compile("[" + "".join(map(re.escape, _SINGLE)) + "]")
_NAME = "(?:" + "|".join(DIGIT_NAMES) + ")"
_SPELLED = re.compile(rf"\b(?:plus[ ,-]{{1,2}})?{_NAME}(?:[ ,-]{{1,2}}(?:{_NAME}|[0-9])\b)+|(?<=[0-9])[ -]{_NAME}(?:[ ,-]{{1,2}}(?:{_NAME}|[0-9])\b)*\b|(?<=\bdot ){_NAME}\b|\b{_NAME}(?= dot )", re.I)
_ITEM = re.compile(rf"plus|{_NAME}|[0-9]", re.I)
_ITEM_TEXT = {**DIGIT_NAMES, "plus": "+"}
_BRACKETED = r"\s{0,3}[\[({<]\s{0,3}%s\s{0,3}[\])}>]\s{0,3}"
_AT, _DOT = _BRACKETED % "(?:at|@)", _BRACKETED % r"(?:dot|\.)"
_WORD = r"[A-Za-z0-9_%+-]{1,64}"
_SIGN = re.compile(f"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_DISGUISED = re.compile(rf"{_WORD}(?:(?:\.|{_DOT}| dot ){_WORD}){{0,4}}(?P<at>{_AT}|@| at )[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT}| dot )[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
_ANY_SIGN = re.compile(f"{_AT}|{_DOT}| at | dot ", re.I)
_HINT = re.compile(r"[\[({<]\s{0,3}(?:at|@|dot|\.)\s{0,3}[\])}>]| dot | at [a-z0-9-]{1,63}\.[a-z0-9-]", re.I)


class Rewritten:
    """A text with, in pieces, the source span of each of its characters.  Pieces are (position here, source start, source end, kept): a
    kept piece maps character by character, any other as a whole."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        self.pieces = pieces if pieces is not None else [(0, 0, len(text), True)]
        self.positions = [p[0] for p in self.pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        position, first, last, kept = self.pieces[bisect_right(self.positions, at) - 1]
        return (first + at - position, first + at - position + 1) if kept else (first, last)

    def changed(self, start: int, end: int) -> bool:
        """Does a rewritten or removed character lie inside?"""
        first = bisect_right(self.positions, start) - 1
        inside = self.pieces[first : bisect_right(self.positions, end - 1)]
        return any(not p[3] for p in inside) or any(a[2] != b[1] for a, b in zip(inside, inside[1:]))

    def rewrite(self, changes: Iterator[tuple[int, int, str]]) -> Rewritten:
        """Replace the given spans (in order, not overlapping)."""
        parts, pieces, size, done = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                k = bisect_right(self.positions, a) - 1
                stop = min(b, self.positions[k + 1] if k + 1 < len(self.positions) else len(self.text))
                position, first, last, kept = self.pieces[k]
                pieces.append((size, first + a - position, first + stop - position, True) if kept else (size, first, last, False))
                parts.append(self.text[a:stop])
                size, a = size + stop - a, stop

        for start, end, new in changes:
            keep(done, start)
            if new:
                pieces.append((size, *self.source(start, end), False))
                parts.append(new)
                size += len(new)
            done = end
        keep(done, len(self.text))
        return Rewritten("".join(parts), pieces or [(0, 0, 0, True)])


def plain_characters(text: Rewritten) -> Rewritten:
    """Look-alike, full-width, mathematical and circled characters become ASCII; zero-width ones go."""
    if text.text.isascii() or not _ODD.search(text.text):
        return text
    return text.rewrite((m.start(), m.end(), _SINGLE[m[0]]) for m in _ODD.finditer(text.text))


def plain_digits(text: Rewritten) -> Rewritten:
    """Runs of spelled digits, also mixed with digits, become digits without separators."""
    return text.rewrite((m.start() + i.start(), m.start() + i.end(), _ITEM_TEXT.get(i[0].lower(), i[0])) if i else gap
                        for m in _SPELLED.finditer(text.text) for i, gap in _items(m))


def _items(match: re.Match) -> Iterator[tuple[re.Match | None, tuple[int, int, str]]]:
    """The digits of a run and, between them, the separators to drop."""
    done, offset = 0, match.start()
    for item in _ITEM.finditer(match[0]):
        if item.start() > done:
            yield None, (offset + done, offset + item.start(), "")
        yield item, (0, 0, "")
        done = item.end()


def plain_signs(text: Rewritten) -> Rewritten:
    """at/dot disguises inside something shaped like an address become @ and dots; bracketed dots between digits become dots."""
    if not _HINT.search(text.text):
        return text

    def changes() -> Iterator[tuple[int, int, str]]:
        for m in _DISGUISED.finditer(text.text):
            if m["at"].strip().lower() == "at" and re.split(r"[^a-z0-9-]+", m[0].lower())[-1] not in ENDINGS:
                continue
            for sign in _ANY_SIGN.finditer(text.text, m.start(), m.end()):
                yield sign.start(), sign.end(), "@" if re.search("at|@", sign[0], re.I) else "."

    found = text.rewrite(changes())
    numeric = re.compile(rf"(?<=[0-9])(?:{_DOT}| dot )(?=[0-9])", re.I)
    return found.rewrite((m.start(), m.end(), ".") for m in numeric.finditer(found.text)) if numeric.search(found.text) else found


TRANSDUCERS: dict[str, Callable[[Rewritten], Rewritten]] = {"odd": plain_characters, "spelled": plain_digits, "sign": plain_signs}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def passes_luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-1][::2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])
    return total % 10 == 0


def find(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans of one kind in a plain text."""
    if kind == "email":
        return list(_emails(text))
    if kind == "ip":
        return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if kind == "card":
        return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and passes_luhn(d)]
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def find_all(text: str, may: dict[str, bool] | None = None) -> list[tuple[str, int, int, bool]]:
    """All findings (kind, start, end, disguised), by kind and start, in code points of the source.  `may` tells what the text may hold (see `hints`)."""
    may = may or dict.fromkeys(HINTS, True)
    plain = {kind: find(kind, text) if kind == "email" or may["digit"] else [] for kind in KINDS}
    clear = Rewritten(text)
    for name, step in TRANSDUCERS.items():
        if may[name] or may["odd"] or name == "sign" and may["spelled"]:  # digits once written out may be part of a host
            clear = step(clear)
    out = [(kind, a, b, False) for kind in KINDS for a, b in plain[kind]]
    if clear.text != text:
        for kind in KINDS:
            spans = plain[kind]
            starts = [a for a, _ in spans]
            for a, b in find(kind, clear.text):
                if clear.changed(a, b):
                    start, end = clear.source(a, b)
                    k = bisect_right(starts, end - 1)
                    if not (k and spans[k - 1][1] > start):
                        out.append((kind, start, end, True))
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


# Necessary conditions of the transducers and of the kinds with digits, in the syntax of the column-wise regular expressions of Arrow.
_ANY_NAME = "(?:" + "|".join(DIGIT_NAMES) + ")"
HINTS = {"odd": "[" + "".join(sorted(_SINGLE)).replace("-", r"\-") + "]", "spelled": f"(?i){_ANY_NAME}[ ,-]{{1,2}}(?:{_ANY_NAME}|[0-9]|dot )|[0-9][ -]{_ANY_NAME}|dot {_ANY_NAME}",
         "sign": r"(?i)[\[({<]\s{0,3}(?:at|@|dot|\.)\s{0,3}[\])}>]| dot | at [a-z0-9-]{1,63}\.[a-z0-9-]", "digit": "[0-9]"}


def hints(texts: pa.Array) -> list[dict[str, bool]]:
    """What each text may hold: one scan of the whole column per condition."""
    found = {name: pc.match_substring_regex(texts, pattern).to_pylist() for name, pattern in HINTS.items()}
    return [dict(zip(found, row)) for row in zip(*found.values())]


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "personal_data") -> DataFrame:
    """The documents with an array of findings: kind, start and end (code points of the source, end exclusive) and whether disguised."""
    kept = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, SPANS)])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in slices(batches, SLICE):
            texts = batch.column(text_col).cast(pa.string()).fill_null("")
            found = [[dict(zip(("kind", "start", "end", "disguised"), s)) for s in find_all(text, may)] for text, may in zip(texts.to_pylist(), hints(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, arrow.field(out_col).type)], schema=arrow)

    return docs.mapInArrow(scan, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each finding replaced by its kind in angle brackets; of findings that overlap, the first stays."""
    name = "_personal_data"
    found = find_personal_data(docs, text_col, name)
    ordered = F.array_sort(name, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    step = lambda acc, s: F.when(s["start"] < acc["done"], acc).otherwise(F.struct(F.concat(acc["text"], F.substring(F.col(text_col), (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("text"), s["end"].alias("done")))
    rest = lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), (acc["done"] + 1).cast("int"), F.length(text_col)))
    clean = F.aggregate(ordered, F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done")), step, rest)
    return found.withColumn(text_col, F.when(F.size(name) > 0, clean).otherwise(F.col(text_col))).select(docs.columns)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def same_kind(kind: str) -> Callable[[Column], Column]:
    return lambda value: value == kind
