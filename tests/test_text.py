"""Column expressions over text, against literal values."""

import string

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T

TEXTS = [
    "",
    " ",
    "The Wolves",
    "the as",
    "s",
    "James",
    "  The  Ring\n",
    "É tés",
    "a b  c",
    "Re-write the_Book by Jane of Ely",
    "x by ",
    "by y",
    "of mice and men by john steinbeck",
    "l'été, «oui»! (don't) — well…",
    "Hello there. I'm \"Bob\"!",
    "tab\there x",
    "O'Neil's iPhone BY the sea",
]

#: Function, and what it makes of each of TEXTS.
CASES = {
    "match_key": (
        T.match_key,
        [
            "",
            "",
            "wolve",
            "a",
            "s",
            "jame",
            " ring",
            "é té",
            "a b  c",
            "re-write the_book by jane of ely",
            "x by",
            "by y",
            "of mice and men by john steinbeck",
            "l'été, «oui»! (don't) — well…",
            "hello there. i'm \"bob\"!",
            "tab\there x",
            "o'neil's iphone by the sea",
        ],
    ),
    "word_count": (
        T.word_count,
        [
            0,
            0,
            2,
            2,
            1,
            1,
            2,
            2,
            3,
            6,
            2,
            2,
            7,
            5,
            4,
            3,
            5,
        ],
    ),
    "strip": (
        T.strip,
        [
            "",
            "",
            "The Wolves",
            "the as",
            "s",
            "James",
            "The  Ring",
            "É tés",
            "a b  c",
            "Re-write the_Book by Jane of Ely",
            "x by",
            "by y",
            "of mice and men by john steinbeck",
            "l'été, «oui»! (don't) — well…",
            "Hello there. I'm \"Bob\"!",
            "tab\there x",
            "O'Neil's iPhone BY the sea",
        ],
    ),
    "slug": (
        T.slugify,
        [
            "book",
            "book",
            "the-wolves",
            "the-as",
            "s",
            "james",
            "the-ring",
            "t-s",
            "a-b-c",
            "re-write-the-book-by-jane-of-ely",
            "x-by",
            "by-y",
            "of-mice-and-men-by-john-steinbeck",
            "l-t-oui-don-t-well",
            "hello-there-i-m-bob",
            "tab-here-x",
            "o-neil-s-iphone-by-the-sea",
        ],
    ),
    "guess": (
        lambda c: F.to_json(T.guess_title_author(c), {"ignoreNullFields": "false"}),
        [
            "{\"title\":\"\",\"author\":null}",
            "{\"title\":\"\",\"author\":null}",
            "{\"title\":\"The Wolves\",\"author\":null}",
            "{\"title\":\"The as\",\"author\":null}",
            "{\"title\":\"S\",\"author\":null}",
            "{\"title\":\"James\",\"author\":null}",
            "{\"title\":\"The Ring\",\"author\":null}",
            "{\"title\":\"É Tés\",\"author\":null}",
            "{\"title\":\"A B C\",\"author\":null}",
            "{\"title\":\"Re Write the Book\",\"author\":\"Jane of Ely\"}",
            "{\"title\":\"X by\",\"author\":null}",
            "{\"title\":\"By Y\",\"author\":null}",
            "{\"title\":\"Of Mice and Men\",\"author\":\"John Steinbeck\"}",
            "{\"title\":\"L'été, «oui»! (don't) — Well…\",\"author\":null}",
            "{\"title\":\"Hello There. I'm \\\"Bob\\\"!\",\"author\":null}",
            "{\"title\":\"Tab Here X\",\"author\":null}",
            "{\"title\":\"O'Neil's IPhone\",\"author\":\"The Sea\"}",
        ],
    ),
    "sentences": (
        lambda c: F.array_join(T.fact_sentences(c), "|"),
        [
            "",
            " ",
            "The Wolves",
            "the as",
            "s",
            "James",
            "  The  Ring\n",
            "É tés",
            "a b  c",
            "Re-write the_Book by Jane of Ely",
            "x by ",
            "by y",
            "of mice and men by john steinbeck",
            "l'été, «oui»!|(don't) — well…",
            "Hello there.|I'm \"Bob\"!",
            "tab\there x",
            "O'Neil's iPhone BY the sea",
        ],
    ),
    "scorecard": (
        lambda c: F.array_join(F.array_sort(T.scorecard_words(c)), "|"),
        [
            "",
            "",
            "wolves",
            "",
            "",
            "james",
            "ring",
            "",
            "",
            "book|jane|write",
            "",
            "",
            "john|mice|steinbeck",
            "don't|well",
            "hello|there",
            "here",
            "iphone|o'neil's",
        ],
    ),
    "raw_question": (
        lambda c: F.array_join(T.raw_question_words(c), "|"),
        [
            "",
            "",
            "the|wolves",
            "the|as",
            "s",
            "james",
            "the|ring",
            "é|tés",
            "a|b|c",
            "re-write|the_book|by|jane|of|ely",
            "x|by",
            "by|y",
            "of|mice|and|men|by|john|steinbeck",
            "l'été|«oui»|don't|—|well…",
            "hello|there|i'm|bob",
            "tab|here|x",
            "o'neil's|iphone|by|the|sea",
        ],
    ),
    "quote": (
        lambda c: T.trimmed_quote(F.repeat(c, 30), 60),
        [
            "",
            "",
            "The WolvesThe WolvesThe WolvesThe WolvesThe WolvesThe...",
            "the asthe asthe asthe asthe asthe asthe asthe asthe asthe...",
            "ssssssssssssssssssssssssssssss",
            "JamesJamesJamesJamesJamesJamesJamesJamesJamesJamesJamesJames...",
            "The Ring The Ring The Ring The Ring The Ring The Ring The...",
            "É tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ tésÉ...",
            "a b ca b ca b ca b ca b ca b ca b ca b ca b ca b ca b ca b...",
            "Re-write the_Book by Jane of ElyRe-write the_Book by Jane...",
            "x by x by x by x by x by x by x by x by x by x by x by x by...",
            "by yby yby yby yby yby yby yby yby yby yby yby yby yby yby...",
            "of mice and men by john steinbeckof mice and men by john...",
            "l'été, «oui»! (don't) — well…l'été, «oui»! (don't) —...",
            "Hello there. I'm \"Bob\"!Hello there. I'm \"Bob\"!Hello there....",
            "tab here xtab here xtab here xtab here xtab here xtab here...",
            "O'Neil's iPhone BY the seaO'Neil's iPhone BY the...",
        ],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_values(spark, name):
    column, expected = CASES[name]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("k", column("t").alias("x")).orderBy("k").collect()
    assert [r.x for r in rows] == expected


def test_quoting(spark):
    names = ["a.b", "x\\Ey", "(z", "$1", "\\Q", string.punctuation]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(F.regexp_like("n", F.concat(F.lit("^"), T.quoted("n"), F.lit("$"))).alias("ok")).collect()
    assert all(r.ok for r in rows)
