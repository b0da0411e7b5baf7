"""Chapter tables: consolidation of fragments, splitting, volumes, and the figures an ingestion reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.groups import by_group
from folioscope.schemas import CONSOLIDATE_BELOW, CONSOLIDATE_TARGET, MIN_COVERAGE, MIN_NARRATIVE_WORDS, MIN_VOLUME_WORDS, MIN_VOLUMES, MIN_WINDOW, NUMBER_WORDS, PROMPT_TOKENS, SPLIT_OVERLAP, SPLIT_TARGET, SPLIT_THRESHOLD, TOKENS_PER_WORD


def with_words(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("n_words", T.word_count("text"))


def upper_median(counts: Column) -> Column:
    """Of a column, as an aggregate: the element at n // 2 of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(counts)), (F.floor(F.count(counts) / 2) + 1).cast("int"))


def consolidation(chapters: DataFrame) -> DataFrame:
    """(book_id, median_words, consolidate): books whose upper median chapter is short are to be consolidated."""
    found = with_words(chapters).groupBy("book_id").agg(upper_median(F.col("n_words")).alias("median_words"))
    return found.withColumn("consolidate", F.col("median_words") < CONSOLIDATE_BELOW)


def fragment_groups(chapters: DataFrame, target: int = CONSOLIDATE_TARGET, boundaries: DataFrame | None = None) -> DataFrame:
    """(book_id, index, merged_index): consecutive chapters, gathered until they hold `target` words or a boundary comes.

    boundaries: (book_id, boundaries array<int>) of indexes before which a group must end. A book's word
    counts are folded in order, numbers only and one at a time; texts stay where they are.
    """
    rows = with_words(chapters).select("book_id", "index", "n_words")
    if boundaries is None:
        rows = rows.withColumn("edge", F.lit(False))
    else:
        edges = boundaries.select("book_id", F.explode("boundaries").alias("index")).distinct().withColumn("edge", F.lit(True))
        rows = rows.join(edges, ["book_id", "index"], "left").withColumn("edge", F.coalesce("edge", F.lit(False)))

    def fold(key, chapters_in_order):
        group, held, closed = -1, 0, True
        for index, n_words, edge in chapters_in_order:
            if closed or edge:
                group, held = group + 1, 0
            held += n_words
            closed = held >= target
            yield key[0], index, group

    return by_group(rows, ["book_id"], ["index"], fold, "book_id string, index int, merged_index int")


def consolidate(chapters: DataFrame, target: int = CONSOLIDATE_TARGET, boundaries: DataFrame | None = None) -> DataFrame:
    """Chapters merged by `fragment_groups`: the first title there is, texts joined by a blank line, pages from first to last."""
    rows = chapters.join(fragment_groups(chapters, target, boundaries), ["book_id", "index"])
    parts = F.array_sort(F.collect_list(F.struct("index", "text")))
    merged = rows.groupBy("book_id", "merged_index").agg(
        F.min_by("title", F.when(F.col("title") != "", F.col("index"))).alias("title"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        F.min(F.when(F.size("pages") > 0, F.col("pages")[0])).alias("first"),
        F.max(F.when(F.size("pages") > 0, F.element_at("pages", -1))).alias("last"),
    )
    pages = F.when(F.col("first").isNotNull(), F.array("first", "last"))
    return merged.select("book_id", F.col("merged_index").alias("index"), "title", "text", pages.alias("pages"))


def split_chapters(chapters: DataFrame, target: int = SPLIT_TARGET, overlap: int = SPLIT_OVERLAP, threshold: int | None = None) -> DataFrame:
    """(book_id, index, piece, text): chapters over `threshold` words in pieces of whole paragraphs.

    A piece ends once it holds `target` words; the next starts with the paragraphs at its end that hold
    `overlap` words. What then remains is a piece if it holds more than those. Off by default: threshold None
    leaves chapters whole, SPLIT_THRESHOLD is the usual one.
    """
    whole = F.array("text")
    if threshold is None:
        pieces = whole
    else:
        lines = F.filter(F.split("text", "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), lambda p: T.strip(p) != "")
        start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("count"))
        total = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + T.word_count(p))

        def tail(held):
            """Paragraphs from the end, until they hold the overlap."""
            picked = F.aggregate(F.reverse(held), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n")), lambda s, p: F.when(s["n"] >= overlap, s).otherwise(F.struct(F.concat(F.array(p), s["kept"]).alias("kept"), (s["n"] + T.word_count(p)).alias("n"))))
            return picked["kept"] if overlap > 0 else F.array().cast("array<string>")

        def step(state, paragraph):
            held = F.concat(state["held"], F.array(paragraph))
            count = state["count"] + T.word_count(paragraph)
            rest = tail(held)
            closed = F.struct(F.concat(state["out"], F.array(F.array_join(held, "\n"))).alias("out"), rest.alias("held"), total(rest).alias("count"))
            return F.when(count >= target, closed).otherwise(F.struct(state["out"].alias("out"), held.alias("held"), count.alias("count")))

        done = F.aggregate(lines, start, step)
        cut = F.when((F.size(done["held"]) > 0) & (done["count"] > overlap), F.concat(done["out"], F.array(F.array_join(done["held"], "\n")))).otherwise(done["out"])
        pieces = F.when((T.word_count("text") <= threshold) | (F.size(lines) < 2) | (F.size(cut) == 0), whole).otherwise(cut)
    return chapters.select("book_id", "index", F.posexplode(pieces).alias("piece", "text"))


USUAL_SPLIT = SPLIT_THRESHOLD


def narrative(chapters: DataFrame) -> DataFrame:
    """Adds skipped: chapters too short to hold a story."""
    return with_words(chapters).withColumn("skipped", F.col("n_words") < MIN_NARRATIVE_WORDS)


def context_window(longest: Column, ceiling: int, floor: int = MIN_WINDOW, tokens_per_word: float = TOKENS_PER_WORD) -> Column:
    """The least of floor, 2 floor, 4 floor, ... that holds a chapter of `longest` words and the prompt; `ceiling` at most."""
    needed = F.floor(F.coalesce(longest, F.lit(0)) * tokens_per_word) + PROMPT_TOKENS
    most = max(0, math.ceil(math.log2(max(1.0, ceiling / floor))))
    windows = [floor * 2**k for k in range(most + 1)]
    fitting = F.lit(windows[-1])
    for window in reversed(windows):
        fitting = F.when(needed <= window, window).otherwise(fitting)
    return F.least(fitting, F.lit(ceiling))


def classification(chapters: DataFrame) -> DataFrame:
    """(book_id, kind): chapter-bound if more than half the chapters have titles."""
    titled = F.count_if(F.coalesce(F.col("title"), F.lit("")) != "") / F.count("*")
    return chapters.groupBy("book_id").agg(F.when(titled > 0.5, "chapter-bound").otherwise("text-bound").alias("kind"))


def sanity(chapters: DataFrame, edge: int = 3) -> DataFrame:
    """(book_id, chapters, min_words, median_words, max_words, first_titles, last_titles); the median halves to even."""
    rows = with_words(chapters)
    label = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("chapter "), F.col("index")))
    rows = rows.groupBy("book_id").agg(
        F.count("*").alias("chapters"),
        F.min("n_words").alias("min_words"),
        F.bround(F.median("n_words"), 0).cast("long").alias("median_words"),
        F.max("n_words").alias("max_words"),
        F.transform(F.array_sort(F.collect_list(F.struct("index", label.alias("label")))), lambda x: x["label"]).alias("titles"),
    )
    last = F.when(F.size("titles") > edge, F.slice("titles", -edge, edge)).otherwise(F.col("titles"))
    return rows.select("book_id", "chapters", "min_words", "median_words", "max_words", F.slice("titles", 1, edge).alias("first_titles"), last.alias("last_titles"))


def report_lines(chapters: DataFrame, raw_counts: DataFrame | None = None) -> DataFrame:
    """(book_id, report): the text of an ingestion report. raw_counts: (book_id, raw_chapters) before consolidation."""
    rows = sanity(chapters).join(classification(chapters), "book_id")
    rows = rows.withColumn("raw_chapters", F.lit(None).cast("long")) if raw_counts is None else rows.join(raw_counts, "book_id", "left")
    merged = F.when(F.col("raw_chapters") != F.col("chapters"), F.concat(F.lit("consolidated from "), F.col("raw_chapters"), F.lit(" fragments")))
    words = F.format_string("words per chapter: min %d, median %d, max %d", "min_words", "median_words", "max_words")
    lines = F.array_compact(F.array(F.concat(F.lit("classification: "), "kind"), F.concat(F.lit("chapters: "), "chapters"), merged, words, F.concat(F.lit("first: "), F.array_join("first_titles", " | ")), F.concat(F.lit("last: "), F.array_join("last_titles", " | "))))
    return rows.select("book_id", F.array_join(lines, "\n").alias("report"))


# How a volume is numbered and labelled.
_ORDINAL = r"(?:\d{1,3}|[ivxlIVXL]{1,6}|" + "|".join(NUMBER_WORDS) + ")"
VOLUME_LABEL = r"(?i)^\s*(?:book|volume|vol\.?|part)\s+" + _ORDINAL + r"\b\s*[:.–—-]?\s*"


def volume_title(label: Column, book_title: Column) -> Column:
    """The label without "Book 2:" and the like; the book's title and the label if nothing else is left."""
    bare = T.strip(F.regexp_replace(label, VOLUME_LABEL, ""))
    joined = T.strip(F.concat_ws(" ", book_title, T.strip(label)))
    return F.when(bare != "", bare).otherwise(joined)


def detect_volumes(chapters: DataFrame, sources: DataFrame, toc: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, volumes, chapter_count, total_words, covered_words, coverage, unlabelled_chapters) of omnibuses.

    sources: (book_id, index, source) of chapters; toc: (book_id, root_ord, label, href) of each nested group
    at the top of a table of contents. A group's span reaches from the first to the last chapter of its
    documents. A book qualifies if it has two spans or more, none overlaps, each holds 1,000 words and all
    together 85 % of the text.
    """
    words = with_words(chapters).select("book_id", "index", "n_words")
    seen = sources.where("source is not null").groupBy("book_id", F.col("source").alias("href")).agg(F.min("index").alias("first"), F.max("index").alias("last"))
    spans = toc.join(seen, ["book_id", "href"]).groupBy("book_id", "root_ord", "label").agg(F.min("first").alias("start"), F.max("last").alias("end"))
    order = Window.partitionBy("book_id").orderBy("start", "end", "label")
    spans = spans.withColumn("overlaps", F.coalesce(F.lead("start").over(order) <= F.col("end"), F.lit(False)))
    held = spans.join(words, "book_id").where("index between start and end").groupBy("book_id", "root_ord", "label", "start", "end", "overlaps").agg(F.sum("n_words").alias("words"))
    held = held.join(books.select("book_id", "title"), "book_id").withColumn("v", F.struct(F.col("start"), F.col("end"), "label", volume_title(F.col("label"), F.col("title")).alias("title"), "words"))
    plans = held.groupBy("book_id").agg(F.array_sort(F.collect_list("v")).alias("volumes"), F.count("*").alias("n"), F.bool_or("overlaps").alias("overlap"), F.min("words").alias("least"), F.sum("words").alias("covered_words"))
    totals = words.groupBy("book_id").agg(F.count("*").alias("chapter_count"), F.sum("n_words").alias("total_words"))
    plans = plans.join(totals, "book_id").withColumn("coverage", F.try_divide("covered_words", "total_words"))
    plans = plans.where((F.col("n") >= MIN_VOLUMES) & ~F.col("overlap") & (F.col("least") >= MIN_VOLUME_WORDS) & (F.col("coverage") >= MIN_COVERAGE))
    inside = F.aggregate("volumes", F.lit(0), lambda n, v: n + v["end"] - v["start"] + 1)
    return plans.select("book_id", "volumes", "chapter_count", "total_words", "covered_words", "coverage", (F.col("chapter_count") - inside).alias("unlabelled_chapters"))


def volume_boundaries(plans: DataFrame) -> DataFrame:
    """(book_id, boundaries): where volumes start, and the chapters after their ends."""
    starts, ends = F.transform("volumes", lambda v: v["start"]), F.transform("volumes", lambda v: v["end"] + 1)
    return plans.select("book_id", F.array_sort(F.array_distinct(F.concat(starts, ends))).alias("boundaries"))


def remap_volumes(plans: DataFrame, groups: DataFrame) -> DataFrame:
    """(book_id, volumes) after consolidation: each volume spans the merged chapters that lie in it; one without any goes."""
    merged = groups.groupBy("book_id", "merged_index").agg(F.min("index").alias("first"), F.max("index").alias("last"))
    rows = plans.select("book_id", F.explode("volumes").alias("v")).join(merged, "book_id").where("first >= v.start and last <= v.end")
    rows = rows.groupBy("book_id", "v").agg(F.min("merged_index").alias("start"), F.max("merged_index").alias("end"))
    volume = F.struct("start", "end", "v.label", "v.title", "v.words")
    return rows.groupBy("book_id").agg(F.array_sort(F.collect_list(volume)).alias("volumes"))


def volume_metadata(plans: DataFrame) -> DataFrame:
    """(book_id, volumes) as stored: without word counts."""
    return plans.select("book_id", F.transform("volumes", lambda v: F.struct(v["title"].alias("title"), v["label"].alias("label"), v["start"].alias("start"), v["end"].alias("end"))).alias("volumes"))


def html_segments(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(id, segment, title, text): documents divided at h1, h2 and h3 if they have more than one of them.

    The text before the first heading is a segment without title, if it isn't blank. With one heading at most
    the whole body is one segment, titled by the first heading that holds text. Scripts and styles count as
    text, as they do in a plain text rendering; comments don't. Named entities other than the five of XML and
    nbsp stay as written; the book sources decode all.
    """
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1), F.lit("")), F.col(html))
    body = F.regexp_replace(body, "(?s)<!--.*?-->", "")

    def plain(c):
        c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        return T.strip(c)

    opening = r"(?i)(?=<h[123][\s>])"
    parts = F.split(body, opening)
    count = F.regexp_count(body, F.lit(r"(?i)<h[123][\s>]"))
    rows = pages.select(id_column, body.alias("body"), count.alias("headings"), parts.alias("parts"))
    heading = lambda c, level="[123]": plain(F.regexp_extract(c, rf"(?is)<h{level}(?:\s[^>]*)?>(.*?)</h[123]>", 1))
    whole_title = F.coalesce(*(F.nullif(heading(F.col("body"), str(k)), F.lit("")) for k in (1, 2, 3)))
    many = rows.where("headings > 1").select(id_column, F.posexplode("parts").alias("k", "part"))
    titled = F.regexp_like("part", F.lit(r"(?i)^<h[123][\s>]"))
    many = many.select(id_column, "k", F.when(titled, F.nullif(heading(F.col("part")), F.lit(""))).alias("title"), plain(F.col("part")).alias("text"), titled.alias("titled"))
    many = many.where((F.col("text") != "") | F.col("titled"))
    one = rows.where("headings <= 1").select(id_column, F.lit(0).alias("k"), whole_title.alias("title"), plain(F.col("body")).alias("text"))
    number = F.row_number().over(Window.partitionBy(id_column).orderBy("k")) - 1
    return many.drop("titled").union(one).select(id_column, number.alias("segment"), "title", "text")


def page_number(name: Column) -> Column:
    """Of documents named like page_12.html; else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(?i)(?:^|/)page[_-]?(\d{1,5})\.x?html?$", 1), F.lit("")), F.lit("99999")).cast("int")
