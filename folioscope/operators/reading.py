"""What a reader has read: reading order within a series, and facts as of a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(index: DataFrame) -> DataFrame:
    """(book_id, read_id, book_rank): for each book those to read before it, by position, and itself last.

    Only books of the same series at a strictly lower position come before; a standalone book is alone.
    """
    books = index.select("book_id", F.col("series.name").alias("s"), F.col("series.position").alias("p"), "ord")
    earlier = books.select(F.col("book_id").alias("read_id"), "s", F.col("p").alias("rp"), F.col("ord").alias("ro"))
    before = books.join(earlier, "s").where("rp < p").select("book_id", "read_id", "rp", "ro", F.lit(0).alias("own"))
    own = books.select("book_id", F.col("book_id").alias("read_id"), F.col("p").alias("rp"), F.col("ord").alias("ro"), F.lit(1).alias("own"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("own", "rp", "ro"))
    return before.union(own).select("book_id", "read_id", rank.alias("book_rank"))


def facts_as_of(facts: DataFrame, index: DataFrame, book_id: str, chapter_index: int) -> DataFrame:
    """Facts visible at a chapter of a book: earlier books of the series whole, the book itself up to the chapter.

    Adds book_rank. Two scans however long the series is: of the earlier books, and of the book itself with the
    bound on the chapter, so partitions are pruned and the bound reaches the files. A book that the index lacks
    is read alone.
    """
    order = {r.read_id: r.book_rank for r in reading_order(index).where(F.col("book_id") == book_id).collect()} or {book_id: 1}
    own = order.pop(book_id)
    seen = facts.where((F.col("book_id") == book_id) & (F.col("chapter_index") <= chapter_index)).withColumn("book_rank", F.lit(own))
    if order:
        ranks = F.create_map(*(F.lit(x) for pair in sorted(order.items()) for x in pair))
        seen = seen.union(facts.where(F.col("book_id").isin(*sorted(order))).withColumn("book_rank", ranks[F.col("book_id")]))
    return with_defaults(seen)


def with_defaults(facts: DataFrame) -> DataFrame:
    return facts.withColumn("when", F.coalesce("when", F.lit("present")))


def facts_at_positions(facts: DataFrame, index: DataFrame, positions: DataFrame) -> DataFrame:
    """The same for many (position_id, book_id, chapter_index) at once, as one join on the book to be read."""
    wanted = positions.select("position_id", "book_id", F.col("chapter_index").alias("upto")).join(reading_order(index), "book_id", "left")
    wanted = wanted.select("position_id", F.coalesce("read_id", "book_id").alias("read_id"), F.coalesce("book_rank", F.lit(1)).alias("book_rank"), F.when(F.coalesce("read_id", "book_id") == F.col("book_id"), F.col("upto")).alias("upto"))
    found = facts.join(wanted, (facts["book_id"] == wanted["read_id"]) & (F.col("upto").isNull() | (F.col("chapter_index") <= F.col("upto"))))
    return with_defaults(found.drop("read_id", "upto"))


def ranked(facts: DataFrame) -> DataFrame:
    """Adds rank, the facts' order: by book_rank, then as they were written."""
    return facts.withColumn("rank", F.struct("book_rank", "seq"))


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds name: the entity's canonical name, or its id where the registry lacks it."""
    names = entities.select("entity_id", F.col("canonical_name").alias("name"))
    return facts.join(names, "entity_id", "left").withColumn("name", F.coalesce("name", "entity_id"))


def check_position(chapter_index: int, chapter_count: int) -> None:
    if not 0 <= chapter_index < chapter_count:
        raise ValueError(f"chapter {chapter_index} is not in 0..{chapter_count - 1}")
