"""Steps that the readers of articles share: cheaper forms give the same results."""

import random
import re

from pyspark.sql import functions as F

from newsweave.functions import text
from newsweave.operators import matching

def test_word_lists_are_looked_up_by_their_first_letter(spark):
    word = "[A-Za-z0-9_]"
    edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    plain = lambda p: "(?iu)" + p.replace(r"\b", edge).replace(r"\w", word)
    patterns = [r"\b(dans|éeau)\b|étion", r"\b(tha|wÿ|é)\b", r"\b(that|w\w+h)\b", r"\b(not|no)\b[^\n]{0,9}\b(thon|éa)\b", r"\b(a?b|cd)\b"]
    rng = random.Random(2)
    pieces = ["dans", "éeau", "ÉEAU", "étion", "tha", "wÿ", "wÿx", "é", "that", "wash", "w\u017fh", "NOT", "no", "thon", "éa", "b", "cd", " ", " ", "-", "\n", "x", "_"]
    samples = spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randint(1, 9))),) for _ in range(3_000)], "s string")
    for p in patterns:
        assert samples.where(F.col("s").rlike(text.java_pattern(p)) != F.col("s").rlike(plain(p))).isEmpty(), p
    # each word of a list that starts or ends outside ASCII has edges of its own: no general boundary is left
    assert "(?<=[A-Za-z0-9_])(?!" not in text.java_pattern(r"\b(dans|éeau)\b|étion") and text.java_pattern(r"\b(tha|wa)\b").startswith("(?iu)(?:(?=[tw])")


def test_lead_sentence_beyond_its_head(spark, monkeypatch):
    monkeypatch.setattr(text, "LEAD_CHARS", 60)
    rng = random.Random(3)
    pieces = ["A", "word ", "longer words here ", ". ", "! \n", "?", ".", "\u00a0", "é", "\U0001f600", "x" * 40]
    rows = [("".join(rng.choices(pieces, k=rng.randint(0, 14))),) for _ in range(2_000)] + [("",), (None,), ("x" * 60 + ". " + "y" * 50,), ("a. " * 50 + "z" * 36,)]
    df = spark.createDataFrame(rows, "s string")
    early = [r[0] for r in df.select(text.lead_sentence(F.col("s"))).collect()]
    monkeypatch.setattr(text, "LEAD_CHARS", 100_000)
    ws = text.WS

    def whole(s):
        if s is None:
            return None
        trim = lambda t: re.sub(f"^{py}+|{py}+$", "", t)
        parts = [trim(t) for t in re.split(rf"(?<=[.!?।]){py}+", s)]
        return next((p for p in parts if len(p) > 35), trim(s))

    py = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), ws)
    assert early == [r[0] for r in df.select(text.lead_sentence(F.col("s"))).collect()] == [whole(s) for (s,) in rows]


def test_open_aliases_need_their_boundaries(spark):
    items = spark.createDataFrame([(1, "t", "Étoile the  one"), (2, "t", "étoile them"), (3, "t", "xétoile the"), (4, "t", "e\u0301toile\u00a0the"), (5, "étoile", "the"), (6, "étoile", ", the")], "item_id long, title string, text string")
    companies = spark.createDataFrame([("c", "étoile the", None)], "company_id string, name string, aliases array<string>")
    assert [r.item_id for r in matching.entity_match(items, companies).orderBy("item_id").collect()] == [1, 4, 5]  # white space is one space, also at the end of the title
