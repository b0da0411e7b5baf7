"""Where in a chapter a statement comes from, and how to cite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.groups import by_group, small_batches
from folioscope.functions.joins import few
from folioscope.functions.lineage import bound
from folioscope.schemas import MAX_QUOTE, MIN_PASSAGE_SCORE, PAIR_PENALTY, PASSAGE_STOPWORDS, UNSEEN_IDF

#: Lengths that are added up in one go: sums run over blocks, then within them.
_BLOCK = 32


def _marked() -> Column:
    """The text with \u0001 before and \u0002 behind each gap between sentences."""
    # fixed value: where sentences end. White space is looked for first, then what stands before it.
    return F.regexp_replace("text", r"(?U)\s(?<=[.!?\"'”’]\s)\s*|\n{2,}", "\u0001$0\u0002")


def sentences(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, i, start, end, sentence): sentences with code point offsets, blank ones left out.

    White space after a full stop, mark or closing quote divides, and so do two line feeds or more.
    """
    key = ["book_id", "chapter_index"]
    rows = bound(chapters.where("text is not null").select("book_id", F.col("index").alias("chapter_index"), "text"), key, F.split(_marked(), "\u0001").alias("p"))
    # a piece after the first is gap and sentence
    rows = bound(rows, key, F.transform("p", lambda p: F.substring_index(p, "\u0002", -1)).alias("s"), F.transform("p", lambda p: F.length(p) - F.contains(p, F.lit("\u0002")).cast("int")).alias("n"))
    add = lambda values, first, count: F.aggregate(F.slice(values, first + 1, count), F.lit(0), lambda total, x: total + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size("n") - 1) / _BLOCK).cast("int"))
    rows = bound(rows, [*key, "s", "n"], F.transform(blocks, lambda b: add(F.col("n"), b * _BLOCK, F.lit(_BLOCK))).alias("sums"))
    rows = bound(rows, [*key, "s", "n"], F.transform("sums", lambda _, b: add(F.col("sums"), F.lit(0), b)).alias("before"))
    ends = F.transform("n", lambda _, k: F.get("before", F.floor(k / _BLOCK).cast("int")) + add(F.col("n"), F.floor(k / _BLOCK).cast("int") * _BLOCK, k % _BLOCK + 1))
    rows = bound(rows, [*key, "s"], ends.alias("ends"))
    spans = F.zip_with("s", "ends", lambda s, e: F.struct((e - F.length(s)).cast("long").alias("start"), e.cast("long").alias("end"), s.alias("sentence")))
    rows = rows.select(*key, F.posexplode(F.filter(spans, lambda x: T.strip(x["sentence"]) != "")).alias("i", "x"))
    return rows.select(*key, "i", "x.start", "x.end", "x.sentence")


def word_weights(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, word, idf): one over the number of a chapter's sentences that have the word.

    A chapter's own row tells all, so its words are counted where it is and never shuffled.
    """
    rows = chapters.where("text is not null").select("book_id", F.col("index").alias("chapter_index"), _marked().alias("marked"))
    types = dict(rows.dtypes)
    stop = frozenset(PASSAGE_STOPWORDS)

    def run(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        find = re.compile("[A-Za-z0-9']+").findall
        for batch in batches:
            words, weights, sizes = [], [], []

            def packed(first, batch=batch):
                at = pa.array(np.repeat(np.arange(first, first + len(sizes)), sizes))
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.string()), pa.array(weights, pa.float64())], ["book_id", "chapter_index", "word", "idf"])

            first = 0
            for text in batch.column(2).to_pylist():
                n: Counter = Counter()
                for sentence in text.split("\u0001"):
                    n.update({w for w in map(str.lower, find(sentence.rpartition("\u0002")[2])) if len(w) >= 2 and w not in stop})
                words += n
                weights += [1.0 / k for k in n.values()]
                sizes.append(len(n))
                if len(words) > 100_000:
                    yield packed(first)
                    first, words, weights, sizes = first + len(sizes), [], [], []
            if words:
                yield packed(first)

    small_batches(rows)
    return rows.mapInArrow(run, f"book_id {types['book_id']}, chapter_index {types['chapter_index']}, word string, idf double")


def located(statements: DataFrame, chapters: DataFrame, every: bool = False, tell: str | None = None) -> DataFrame:
    """(statement_id, book_id, chapter_index, i, pair, start, end, score, passage, n_text, told): `passages` with the number of
    the first sentence, the chapter's length and what its text column `tell` says.

    every: statements without a passage too, if their chapter exists.
    """
    key = ["book_id", "chapter_index"]
    types = dict(statements.dtypes)
    said = statements.select(*key, F.lit(1).alias("kind"), F.col("statement").alias("body"), "statement_id", F.lit(None).cast("string").alias("told"))
    texts = chapters.select("book_id", F.col("index").cast(types["chapter_index"]).alias("chapter_index"), F.lit(0).alias("kind"), F.coalesce(_marked(), F.lit("")).alias("body"), F.lit(None).cast(types["statement_id"]).alias("statement_id"), (F.col(tell) if tell else F.lit(None)).cast("string").alias("told"))
    stop, least, penalty, unseen, white = frozenset(PASSAGE_STOPWORDS), MIN_PASSAGE_SCORE, PAIR_PENALTY, UNSEEN_IDF, T.WHITE

    def work(key, rows_in_order):
        import re

        find, capitals = re.compile("[A-Za-z0-9']+").findall, re.compile("(?<![A-Za-z0-9'])[A-Z][A-Za-z0-9']*").finditer
        own, common, end, about = [], stop, None, None

        def learnt(text):
            """Stopwords that the text uses as names: capitalised, and neither first in it nor after the end of a sentence."""
            for m in capitals(text):
                w = m[0].lower()
                if w in stop:
                    k = m.start() - 1
                    while k >= 0 and text[k] in white:
                        k -= 1
                    if k >= 0 and text[k] not in ".!?\"'”’":
                        yield w

        def words_of(text):
            return {w for w in map(str.lower, find(text)) if len(w) >= 2 and w not in common}

        def best(statement):
            """The place of the best passage, rounded score first, then the earliest, a single sentence before a pair."""
            wanted = sorted(words_of(statement))
            weight = {w: idf.get(w, unseen) for w in wanted}
            total = 0.0
            for w in wanted:
                total += weight[w]
            met, sofar, bar = set(), 0.0, total * (least - 1e-6)
            for w in sorted(wanted, key=lambda w: (weight[w], w)):
                sofar += weight[w]
                if sofar >= bar and w in places:
                    met.update(places[w])
            found, top = None, None
            at = {(i, 0) for i in met} | {(i, 1) for i in met if i + 1 < len(own)} | {(i - 1, 1) for i in met if i}
            for i, pair in at:
                first, score = own[i], 0.0
                if pair:
                    second = own[i + 1]
                    for w in wanted:
                        if w in first or w in second:
                            score += weight[w]
                    score = score / total * penalty
                else:
                    for w in wanted:
                        if w in first:
                            score += weight[w]
                    score = score / total * 1.0
                rank = (int(score * 1e12 + 0.5), -i, -pair)
                if top is None or rank > top:
                    found, top = (i, pair, score), rank
            return found if found and found[2] >= least else None

        for kind, body, statement_id, told in rows_in_order:
            if kind == 0:
                sentences, starts, ends, end, about = [], [], [], 0, told
                for piece in body.split("\u0001"):
                    _, mark, sentence = piece.rpartition("\u0002")
                    end += len(piece) - len(mark)
                    if sentence.strip(white):
                        sentences.append(sentence)
                        starts.append(end - len(sentence))
                        ends.append(end)
                common = stop.difference(learnt(" ".join(sentences)))
                own, places, known = [words_of(s) for s in sentences], {}, {}
                for i, words in enumerate(own):
                    for w in words:
                        places.setdefault(w, []).append(i)
                idf = {w: 1.0 / len(at) for w, at in places.items()}
            elif end is not None and None not in key:
                if body not in known:
                    known[body] = best(body) if own and body is not None else None
                if known[body]:
                    i, pair, score = known[body]
                    yield statement_id, *key, i, pair, starts[i], ends[i + pair], score, " ".join(sentences[i : i + pair + 1]), end, about
                elif every:
                    yield statement_id, *key, None, None, None, None, None, None, end, about

    schema = f"statement_id {types['statement_id']}, book_id {types['book_id']}, chapter_index {types['chapter_index']}, i int, pair int, start long, end long, score double, passage string, n_text long, told string"
    return by_group(texts.union(said), key, ["kind"], work, schema)


def passages(statements: DataFrame, chapters: DataFrame) -> DataFrame:
    """(statement_id, book_id, chapter_index, quote, start, end, score): the best passage for each statement that has one.

    statements: (statement_id, book_id, chapter_index, statement). Candidates are single sentences and, at a
    discount, pairs of neighbours. A word weighs one over the number of the chapter's sentences it is in; the
    score is the weight of the statement's words that the candidate has over that of all of them. Sums run
    in the order of the words. The earliest best wins, a single sentence before a pair, from 0.40 on.

    The lightest words of a statement, so many that together they are below that bound, can't make a passage.
    So statements meet only sentences that have another of their words. Chapters and statements are shuffled
    once, by chapter, and a worker holds one chapter at a time.
    """
    quote = T.trimmed_quote(F.col("passage"), MAX_QUOTE)
    return located(statements, chapters).select("statement_id", "book_id", "chapter_index", quote.alias("quote"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")


def position_in_chapter(start: Column, length: Column) -> Column:
    return F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), start / length)))


def _volume(volumes: Column, chapter: Column) -> Column:
    """The first of a book's volumes with a title around the chapter."""
    return F.get(F.filter(volumes, lambda v: (F.trim(v["title"]) != "") & (v["start"] <= chapter) & (chapter <= v["end"])), 0)


def volumes_at(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, chapter_index, volume, volume_chapter): the first volume with a title around each chapter."""
    spans = books.select("book_id", F.posexplode("volumes").alias("k", "v")).where((F.trim("v.title") != "") & F.col("v.start").isNotNull() & F.col("v.end").isNotNull())
    rows = chapters.select("book_id", F.col("index").alias("chapter_index")).join(spans, "book_id").where("chapter_index between v.start and v.end")
    found = rows.groupBy("book_id", "chapter_index").agg(F.min_by("v", "k").alias("v"))
    return found.select("book_id", "chapter_index", T.strip("v.title").alias("volume"), (F.col("chapter_index") - F.col("v.start") + 1).alias("volume_chapter"))


def citations(statements: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """A citation for each statement whose book and chapter exist: its place in words, and the quote if there is one.

    (statement_id, book_id, chapter_index, where, rendered, quote, score, position)
    All that a chapter says of its place is put into words once, and goes with its text.
    """
    key = ["book_id", "chapter_index"]
    held = chapters.select("book_id", "index", "title", "pages", "text").join(few(books.select("book_id", F.col("title").alias("book"), F.col("volumes"))), "book_id")
    held = bound(held, ["book_id", "index", "title", "pages", "text", "book"], _volume(F.col("volumes"), F.col("index")).alias("v"))
    paged = F.size("pages") > 0
    first, last = F.col("pages")[0], F.element_at("pages", -1)
    place = (
        F.when(paged, F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last)))
        .when(F.col("title") != "", F.col("title"))
        .when(F.col("v").isNotNull(), F.concat(F.lit("chapter "), F.col("index") - F.col("v.start") + 1))
        .otherwise(F.concat(F.lit("chapter "), F.col("index")))
    )
    head = F.concat_ws(", ", F.coalesce(T.strip("v.title"), F.when(F.col("book") != "", F.col("book")), "book_id"), place)
    held = held.select("book_id", "index", "text", F.concat(F.when(F.col("pages").isNull(), "%").otherwise("p"), head).alias("tell"))
    rows = located(statements, held, every=True, tell="tell").withColumn("position", F.when(F.col("score").isNotNull(), position_in_chapter(F.col("start"), F.col("n_text"))))
    rows = rows.withColumn("quote", T.trimmed_quote(F.col("passage"), MAX_QUOTE))
    inside = F.when(F.startswith("told", F.lit("%")), F.concat(F.bround(F.col("position") * 100, 0).cast("int"), F.lit("% in")))
    rows = rows.withColumn("where", F.concat_ws(", ", F.substr("told", F.lit(2)), inside))
    rendered = F.when(F.col("quote").isNull(), F.col("where")).otherwise(F.concat("where", F.lit(' - "'), "quote", F.lit('"')))
    return rows.select("statement_id", *key, "where", rendered.alias("rendered"), "quote", "score", "position")


def source_lines(cited: DataFrame, shown: int = 6) -> list[str]:
    """The first `shown` different citations by chapter, then how many more there are."""
    distinct = cited.groupBy("rendered").agg(F.min(F.struct("chapter_index", "statement_id")).alias("first"))
    rows = distinct.orderBy("first").limit(shown).select("rendered").collect()
    more = distinct.count() - len(rows)
    return [r.rendered for r in rows] + ([f"... and {more} more"] if more else [])
