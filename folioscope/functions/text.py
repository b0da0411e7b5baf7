"""Column expressions over text. White space and word characters are Unicode's throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.schemas import PASSAGE_STOPWORDS, QUESTION_STOPWORDS, SMALL_TITLE_WORDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literals(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


#: All white space of Unicode: what (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def words(c) -> Column:
    """Runs between white space; none in an empty text."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def match_key(c) -> Column:
    """Lower case, without a leading "the " and one trailing "s"."""
    key = F.regexp_replace(F.lower(strip(c)), "^the ", "")
    return F.regexp_replace(key, r"(?s)(?<=.)s\z", "")


def slugify(c) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "book").otherwise(slug)


def title_case(c) -> Column:
    """First letters in upper case, but of small words after the first; the rest of each word as it is."""
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))
    cased = F.transform(F.split(col(c), " "), lambda w, k: F.when((k > 0) & F.lower(w).isin(*SMALL_TITLE_WORDS), F.lower(w)).otherwise(capital(w)))
    return F.array_join(cased, " ")


def guess_title_author(stem) -> Column:
    """struct(title, author) of a file name's stem."""
    flat = F.regexp_replace(strip(F.regexp_replace(col(stem), "[_-]+", " ")), r"(?U)\s+", " ")
    by = r"(?i)^(.*?)\s+by\s+(.+)$"
    has = F.regexp_like(flat, F.lit(by))
    title = F.when(has, strip(F.regexp_extract(flat, by, 1))).otherwise(flat)
    author = F.when(has, strip(F.regexp_extract(flat, by, 2)))
    return F.struct(title_case(title).alias("title"), F.when(author != "", title_case(author)).alias("author"))


def quoted(c) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def name_tokens(c) -> Column:
    return words(strip(c))


def question_words(c) -> Column:
    """Distinct words of three letters or more that say something: the tokeniser of questions and statements."""
    bare = F.transform(words(F.lower(col(c))), lambda w: F.regexp_replace(w, "^[.,!?;:\"'()\\[\\]\\-—…]+|[.,!?;:\"'()\\[\\]\\-—…]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(*QUESTION_STOPWORDS)))


def raw_question_words(c) -> Column:
    """Words of a question for the comparison with names, edges stripped, in order."""
    return F.filter(F.transform(words(F.lower(col(c))), lambda w: F.regexp_replace(w, "^[.,!?;:\"'()]+|[.,!?;:\"'()]+$", "")), lambda w: w != "")


def passage_words(c, learnt: Column | None = None) -> Column:
    """Distinct words for passage matching; stopwords only where `learnt` says that they are names."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit("([A-Za-z0-9']+)"), 1), F.lower)
    keep = lambda w: (F.length(w) >= 2) & (~w.isin(*PASSAGE_STOPWORDS) | (F.lit(False) if learnt is None else F.coalesce(F.array_contains(learnt, w), F.lit(False))))
    return F.array_distinct(F.filter(found, keep))


def scorecard_words(c) -> Column:
    """Distinct words of four characters or more: the tokeniser of the scorecard."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9']+)"), 1), lambda w: F.length(w) > 3))


def fact_sentences(c) -> Column:
    """Sentences of the deterministic extractor: white space after . ! ? divides."""
    return F.split(F.regexp_replace(col(c), r"(?U)([.!?])\s+", "$1\u0001"), "\u0001")


def trimmed_quote(c, limit: int) -> Column:
    """White space collapsed; cut before the word that crosses the limit, with three dots."""
    flat = F.array_join(words(c), " ")
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.left(flat, F.lit(limit)), r" [^ ]*\z", ""), F.lit("..."))).otherwise(flat)


def initial_upper(c) -> Column:
    first = F.left(col(c), F.lit(1))
    return F.regexp_like(first, F.lit(r"^\p{Lu}"))
