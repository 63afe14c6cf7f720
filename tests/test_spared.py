"""Searches that most texts are spared: the same results, without the search."""

import random
import re

from pyspark.sql import functions as F

from tidewire.functions import entities, geography, severity
from tidewire.functions import vocabulary as V
from tidewire.functions.text import clean_text, concise_summary

SPACE = "[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
FILL = "it was said that some of them had never been there before and would not come again "


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stories(n):
    chance = random.Random(n)
    names = [*V.ORGANIZATIONS, *entities.ALL_EQUIPMENT, *V.COUNTRIES, *V.KEYWORDS, *geography.PLACE_COUNTRIES, *V.STATES, *geography.STATE_OF_CITY, *V.STRATEGIC]
    names += [w for words in V.LOCATION_TYPES.values() for w in words] + [p.replace(r"\b", "") for patterns in V.REGION_PATTERNS.values() for p in patterns]
    names += ["uri\vsector", "hot  springs\vpatrol", "Delhİ", "Kargil", "Kerala", "PaKistan", "İndia", "İAF"]
    rows = [(0, None, None), (1, "", ""), (2, "line of", "control " + FILL), (3, "India", "short")]
    for i in range(n):
        name = chance.choice([str, str.lower, str.upper, str.title])(chance.choice(names))
        name = chance.choice(["", "", "é", "x", "_", "\u0301", "-", "("]) + name.replace(" ", chance.choice([" ", " ", "\n", "\t"])) + chance.choice(["", "", "é", "s", "_", "\u0301", "-", "."])
        rows.append((i + 4, chance.choice([None, "title", name]), FILL + name + " " + FILL))
    return rows


def test_spared_texts_have_no_name_and_no_place(spark):
    rows = spark.createDataFrame(stories(1500), "id long, title string, body string")
    # All bits set: every text is searched.
    every = rows.withColumns({"_listed": F.lit(-1).cast("long"), "_spots": F.lit(-1).cast("long")})
    got, want = entities.recognise(rows, "title", "body"), geography.located(entities.entities(every, "title", "body"), "title", "body")
    columns = [c for c in want.columns if c not in rows.columns]
    found = {r.id: [r[c] for c in columns] for r in want.collect()}
    assert {r.id: [r[c] for c in columns] for r in got.collect()} == found
    assert sum(any(x for x in v if isinstance(x, list)) for v in found.values()) > 400
    quiet = spark.createDataFrame([(1, "title", FILL)], "id long, title string, body string").withColumn("_both", F.concat_ws("\n", "title", "body"))
    assert tuple(quiet.select(entities.listed_words(F.col("_both")), geography.place_words(F.col("_both"))).first()) == (0, 0)
    assert "seen(" in plan(got)


def test_clean_texts(spark):
    chance = random.Random(3)
    marks = ["a", "b.", " ", " ", "\n", "\xa0", "\u2028", "\u3000", "\t", "<b>", "<", ">", "http://x/y", "https:/", "://", "www.z", "ww", "\x1c"]
    texts = ["".join(chance.choice(marks) for _ in range(chance.randrange(14))) for _ in range(800)] + ["  ", "www.www.a b", "<a", "x" * 50]
    java = lambda t: re.sub(r"www\.[^ \t\n\x0b\f\r]+", "", re.sub(r"https?://[^ \t\n\x0b\f\r]+", "", re.sub("<[^>]+>", " ", t)))
    want = {i: re.sub(f"{SPACE}+", " ", java(t)).strip(" ") for i, t in enumerate(texts)}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", clean_text(F.col("t")).alias("c"))
    assert {r.id: r.c for r in rows.collect()} == want
    # Not every single space is replaced by itself, nor every text searched for tags.
    assert r"(?U)\s+" not in plan(rows) and "Contains" in plan(rows)


def test_only_the_first_sentences_are_cut(spark):
    chance = random.Random(4)
    parts = ["One.", "two three!", "\xa0", ".", " ", "DELHI, INDIA: ", "a b c d e f g h i j k l?", "\n", "word " * 70, "..", "?!"]
    texts = ["".join(chance.choice(parts) + chance.choice(["", " "]) for _ in range(chance.choice([3, 90]))) for _ in range(400)] + [None, "", "a. " * 40, "a. " * 29 + "b. \xa0"]

    def summary(text):
        found = [re.sub(f"{SPACE}+", " ", s).strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text or "")]
        kept, n = [], 0
        for s in filter(None, found):
            words = len(s.split(" "))
            if n >= 30 or n and n + words > 60:
                break
            kept, n = [*kept, s], n + words
        return re.sub(r"^[A-Z][A-Z ,.]{2,40}[:\-][ \t\n\x0b\f\r]+", "", " ".join(kept)) or (text or "")[:250]

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", concise_summary(F.col("t")).alias("s"))
    assert {r.id: r.s for r in rows.collect()} == {i: summary(t) for i, t in enumerate(texts)}
    assert ", 31)" in plan(rows)


def test_heads_without_what_speaks_of_the_author(spark):
    words, rows = ["Staff Reporter", "click here", "SPECIAL correspondent", "all rights reserved"], []
    for at in [0, 5, *range(1170, 1245)]:
        for i, word in enumerate(words):
            rows.append((f"{at} {i}", ("é" * at) + word + " of this\r\nand more \u2028" + "y" * 1300))
    df = spark.createDataFrame([*rows, ("plain", "z" * 3000), ("empty", "")], "id string, t string")
    both = df.select("id", severity.head_without_bio(F.col("t")).alias("head"), F.substring(severity.without_bio(F.col("t")), 1, severity.HEAD).alias("want"))
    assert both.where("head <> want").count() == 0 and both.count() == len(rows) + 2
