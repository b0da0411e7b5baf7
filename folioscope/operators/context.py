"""Facts as the text that an answerer reads: by entity, then by standing in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.reading import with_names
from folioscope.schemas import OCCURRENCES

# The headings of an entity's parts.
HEADINGS = (
    "  Background - happened BEFORE the story's present, however late the chapter that mentions it:",
    "  What happened, in order - each line is a separate moment, not a correction of the one above:",
    "  Expected or planned - had not happened yet as of the chapters below:",
    "  Standing description - a later line refines or supersedes an earlier one:",
)


def bucket(content_type: str = "fiction"):
    """0 background, 1 occurrence, 2 expected, 3 standing description."""
    occurs = OCCURRENCES.get(content_type, OCCURRENCES["fiction"])
    return F.when(F.col("when") == "past", 0).when(F.col("when") == "future", 2).when(F.col("category").isin(*occurs) if occurs else F.lit(False), 1).otherwise(3)


def context_lines(facts: DataFrame, entities: DataFrame, content_type: str = "fiction") -> DataFrame:
    """A row for each fact, with its place in the text: (entity_rank, entity_id, name, bucket, category, category_rank, chapter_index, rank, line).

    Entities come in the order of their first fact, categories of a description in that of theirs, lines by
    chapter and then in the facts' order.
    """
    rows = with_names(facts, entities).withColumn("bucket", bucket(content_type))
    phrase = F.when(F.col("time_phrase") != "", F.concat(F.lit(" - "), F.col("time_phrase"))).otherwise("")
    moment = F.concat(F.lit("    [ch "), F.col("chapter_index"), phrase, F.lit("] ("), F.col("category"), F.lit(") "), F.col("statement"))
    standing = F.concat(F.lit("      [ch "), F.col("chapter_index"), F.lit("] "), F.col("statement"))
    rows = rows.withColumn("line", F.when(F.col("bucket") < 3, moment).otherwise(standing)).withColumn("kind", F.when(F.col("bucket") == 3, F.col("category")).otherwise(""))
    rows = rows.withColumn("entity_rank", F.min("rank").over(Window.partitionBy("entity_id")))
    return rows.withColumn("category_rank", F.min("rank").over(Window.partitionBy("entity_id", "bucket", "kind")))


def entity_blocks(facts: DataFrame, entities: DataFrame, content_type: str = "fiction") -> DataFrame:
    """(entity_id, entity_rank, block): each entity's part of the context."""
    lines = context_lines(facts, entities, content_type)
    join = lambda column, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col(column).alias("x")))), lambda s: s["x"]), "\n")
    kinds = lines.groupBy("entity_id", "name", "entity_rank", "bucket", "kind", "category_rank").agg(join("line", ["chapter_index", "rank"]).alias("part"))
    kinds = kinds.withColumn("part", F.when(F.col("bucket") == 3, F.concat(F.lit("    "), F.col("kind"), F.lit(":\n"), F.col("part"))).otherwise(F.col("part")))
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), F.col("bucket") + 1)
    buckets = kinds.groupBy("entity_id", "name", "entity_rank", "bucket").agg(join("part", ["category_rank"]).alias("part"))
    buckets = buckets.withColumn("part", F.concat(heading, F.lit("\n"), F.col("part")))
    return buckets.groupBy("entity_id", "name", "entity_rank").agg(join("part", ["bucket"]).alias("part")).select("entity_id", "entity_rank", F.concat("name", F.lit("\n"), "part").alias("block"))


def format_context(facts: DataFrame, entities: DataFrame, content_type: str = "fiction") -> str:
    """The whole context as one text, which a question's few facts make; empty without facts."""
    blocks = entity_blocks(facts, entities, content_type).orderBy("entity_rank").select("block").collect()
    return "\n\n".join(r.block for r in blocks)
