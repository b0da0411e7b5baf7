"""Paged documents (PDF and the like) as chapters, from page texts and outlines that a parser provides.

No PDF parser is at hand here, so page texts come in as a table: (path, page from 0, text), and outlines as
(path, ord, level, title, start_page from 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T


def chapters(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """(path, index, title, text, pages, source null): a chapter for each outline entry of the top level, or of any if none is.

    An entry's pages go up to the next entry's first; a document without outline is one chapter. Chapters
    without text are left out, and don't count.
    """
    tops = outline.groupBy("path").agg(F.bool_or(F.col("level") == 1).alias("has_top"))
    entries = outline.join(tops, "path").where((F.col("level") == 1) | ~F.col("has_top"))
    counts = pages.groupBy("path").agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy("ord")
    entries = entries.join(counts, "path").select("path", "ord", "title", (F.col("start_page") - 1).alias("first"), F.coalesce(F.lead("start_page").over(order) - 1, "n").alias("end"))
    rows = pages.join(entries, "path").where("page >= first and page < end")
    whole = pages.join(tops, "path", "left_anti").select("path", "page", "text", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("long").alias("end"))
    rows = rows.select("path", "page", "text", "ord", "title", F.col("first").cast("int").alias("first"), F.col("end").cast("long").alias("end")).union(whole)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "")
    merged = rows.groupBy("path", "ord", "title", "first", "end").agg(T.strip(joined).alias("text")).where("text <> ''")
    span = F.when(F.col("first").isNotNull(), F.array(F.col("first") + 1, F.greatest(F.col("first") + 1, F.col("end").cast("int"))))
    number = F.row_number().over(Window.partitionBy("path").orderBy("ord")) - 1
    return merged.select("path", number.alias("index"), F.nullif(T.strip("title"), F.lit("")).alias("title"), "text", span.alias("pages"), F.lit(None).cast("string").alias("source"))
