"""The library on storage: tables as snapshots of Parquet files, and the older layout of JSON files for interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas

TABLES = {"index": schemas.INDEX, "books": schemas.BOOKS, "chapters": schemas.CHAPTERS, "facts": schemas.FACTS, "entities": schemas.ENTITIES, "declared": schemas.DECLARED, "checkpoints": schemas.CHECKPOINTS}
#: Tables stored by book, so a reader of one book opens its files only.
BY_BOOK = ("chapters", "facts")


class Library:
    """Tables under one root that Spark can reach.

    A write makes a new snapshot and is in force once Spark has marked it complete; until then readers see
    the one before, and a write that fails leaves nothing in force. Files are only touched through Spark's
    own file systems.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def snapshots(self, table: str) -> list[int]:
        fs, path = self._fs()
        top = path(f"{self.root}/{table}")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        """The table, empty before its first write."""
        found, schema = self.snapshots(table), TABLES[table]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{found[-1]}").select(*schema.fieldNames())

    def write(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        """Replaces the table; the last `keep` snapshots stay, for readers that have begun."""
        found = self.snapshots(table)
        fields = TABLES[table]
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields))
        new = (found[-1] if found else 0) + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("book_id") if table in BY_BOOK else writer).parquet(f"{self.root}/{table}/v{new}")
        fs, path = self._fs()
        for old in [*found, new][:-keep]:
            fs.delete(path(f"{self.root}/{table}/v{old}"), True)

    def replace_books(self, table: str, rows: DataFrame, book_ids: list[str]) -> None:
        """Rows of these books in place of those the table has of them."""
        self.write(table, self.read(table).where(~F.col("book_id").isin(*book_ids)).unionByName(rows.select(*TABLES[table].fieldNames())))


def unique_book_id(slug: str, taken: set[str]) -> str:
    """The slug, or with -2, -3 and so on if it is taken."""
    n, found = 1, slug
    while found in taken:
        n += 1
        found = f"{slug}-{n}"
    return found


_BOOK_OF_FILE = r"([^/]+)/[^/]+$"


def _by_book(rows: DataFrame) -> DataFrame:
    return rows.withColumn("book_id", F.url_decode(F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), _BOOK_OF_FILE, 1), r"\+", "%2B")))


def read_json_layout(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a library kept as JSON files: one folder for each book, registry and index beside them.

    Absent keys take their defaults; files that can't be parsed give no rows. Line order becomes seq and ord.
    """
    string = "string"
    chapters = _by_book(spark.read.schema("index int, title string, text string, pages array<int>").json(f"{root}/*/chapters.jsonl")).where(F.col("index").isNotNull())
    facts = spark.read.schema("entity_id string, entity_name string, chapter_index int, category string, statement string, when string, time_phrase string").json(f"{root}/*/facts.jsonl")
    facts = _by_book(facts).withColumn("seq", F.monotonically_increasing_id()).where(F.col("entity_id").isNotNull())
    books = spark.read.schema("book_id string, title string, author string, series struct<name:string,position:int>, content_type string, source_format string, source_filename string, volumes array<struct<title:string,label:string,start:int,end:int>>, ingested_at string, chapter_count int").option("multiLine", True).json(f"{root}/*/metadata.json").where(F.col("book_id").isNotNull())
    index = spark.read.schema("books array<struct<book_id:string,title:string,author:string,series:struct<name:string,position:int>>>").option("multiLine", True).json(f"{root}/index.json")
    registry = spark.read.schema("entities array<struct<entity_id:string,canonical_name:string,type:string,aliases:array<string>,epithets:array<string>,book_ids:array<string>>>").option("multiLine", True).json(f"{root}/entities.json")
    none = F.array().cast("array<string>")
    entities = registry.select(F.posexplode("entities").alias("ord", "e")).select("e.entity_id", "e.canonical_name", "e.type", F.coalesce("e.aliases", none).alias("aliases"), F.coalesce("e.epithets", none).alias("epithets"), "e.book_ids", F.col("ord").cast("long").alias("ord"))
    return {
        "index": index.select(F.posexplode("books").alias("ord", "b")).select("b.book_id", "b.title", "b.author", "b.series", F.col("ord").cast("long").alias("ord")),
        "books": books.withColumn("content_type", F.coalesce("content_type", F.lit("fiction"))),
        "chapters": chapters.select("book_id", "index", F.col("title").cast(string), "text", "pages"),
        "facts": facts.select("book_id", "seq", "entity_id", F.coalesce("entity_name", "entity_id").alias("entity_name"), "chapter_index", "category", "statement", F.coalesce("when", F.lit("present")).alias("when"), "time_phrase"),
        "entities": entities,
    }


def declared_from_json(raw: DataFrame) -> DataFrame:
    """(book_id, gseq, names, epithets, reason) of (book_id, raw) files: objects, or bare lists of names as they once were.

    Groups of fewer than two names are left out, broken files give none.
    """
    v = raw.select("book_id", F.try_parse_json("raw").alias("v")).select("book_id", F.posexplode(F.try_variant_get("v", "$.groups", "array<variant>")).alias("gseq", "g"))
    none = F.array().cast("array<string>")
    names = F.coalesce(F.try_variant_get("g", "$.names", "array<string>"), F.try_variant_get("g", "$", "array<string>"), none)
    rows = v.select("book_id", "gseq", names.alias("names"), F.coalesce(F.try_variant_get("g", "$.epithets", "array<string>"), none).alias("epithets"), F.coalesce(F.try_variant_get("g", "$.reason", "string"), F.lit("")).alias("reason"))
    return rows.where(F.size("names") >= 2)


def facts_to_json(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines, a folder for each book, in the facts' order; absent time phrases are left out."""
    record = F.struct("entity_id", "entity_name", "chapter_index", "category", "statement", "when", "time_phrase")
    rows = facts.repartition("book_id").sortWithinPartitions("book_id", "seq")
    rows.select("book_id", F.to_json(record, {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)
