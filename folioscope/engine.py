"""The engine's commands on a library: ingest, extract, ask, compare, list, show, remove, alias, check."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.lineage import settle
from folioscope.operators import context, extraction, ingest, names, passages, providers, reading, registry, relevance, scorecard, vocatives
from folioscope.schemas import BOOKS, CHECKPOINTS
from folioscope.sources import epub, pages
from folioscope.sources.library import Library, unique_book_id
from folioscope.streaming.extraction import eta_seconds


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.library = spark, Library(spark, root)

    # ingestion

    def ingest_epub(self, path: str, **options) -> tuple[str, list[str]]:
        """Takes in one EPUB file; `ingest` has the options. Returns the book's id and notes."""
        files = self.spark.read.format("binaryFile").load(path)
        contents, found = epub.toc(files), epub.metadata(files)
        meta = epub.resolved_metadata(found, options.pop("title", None), options.pop("author", None)).first()
        rows = epub.chapters(epub.segments(files), contents)
        groups = contents.where("nested and href is not null").join(contents.where("nested").groupBy("root_ord").agg(F.min_by("label", "ord").alias("group")), "root_ord").select("root_ord", F.col("group").alias("label"), "href")
        return self.ingest(rows, meta.title, meta.author, toc=groups, source_format="epub", source_filename=path.rpartition("/")[2], **options)

    def ingest_pages(self, page_texts: DataFrame, outline: DataFrame, title: str, author: str | None = None, **options) -> tuple[str, list[str]]:
        return self.ingest(pages.chapters(page_texts, outline), title, author, source_format="pdf", **options)

    def ingest(self, rows: DataFrame, title: str, author: str | None = None, series: str | None = None, position: int | None = None, content_type: str = "fiction", auto_link: bool = True, toc: DataFrame | None = None, source_format: str = "", source_filename: str = "") -> tuple[str, list[str]]:
        """Stores a book's chapters (index, title, text, pages, source): fragments consolidated, volumes found, names linked."""
        index = self.library.read("index")
        slug = self.spark.range(1).select(T.slugify(F.lit(title))).first()[0]
        ids = index.select("book_id").union(self.library.read("books").select("book_id"))
        taken = {r.book_id for r in ids.where(F.startswith("book_id", F.lit(slug))).collect()}
        book_id = unique_book_id(slug, taken)
        rows = rows.withColumn("book_id", F.lit(book_id))
        chapters = rows.select("book_id", "index", "title", "text", "pages")
        raw_count = chapters.count()
        if not raw_count:
            raise ValueError("no chapters with text")
        book = self.spark.createDataFrame([(book_id, title)], "book_id string, title string")
        plan = ingest.detect_volumes(chapters, rows.select("book_id", "index", "source"), toc.withColumn("book_id", F.lit(book_id)), book) if toc is not None else None
        plan = None if plan is None or plan.isEmpty() else plan
        if ingest.consolidation(chapters).first().consolidate:
            edges = ingest.volume_boundaries(plan) if plan is not None else None
            groups = ingest.fragment_groups(chapters, boundaries=edges)
            merged = ingest.consolidate(chapters, boundaries=edges)
            volumes = ingest.remap_volumes(plan, groups) if plan is not None else None
        else:
            merged, volumes = chapters, plan
        stored = ingest.volume_metadata(volumes).first() if volumes is not None else None
        count = merged.count()
        row = (book_id, title, author, content_type, source_format, source_filename, datetime.now(UTC).isoformat(), count, (series, position) if series is not None else None, [tuple(v) for v in stored.volumes] if stored else None)
        fresh = self.spark.createDataFrame([row], BOOKS)
        report = ingest.report_lines(merged, self.spark.createDataFrame([(book_id, raw_count)], "book_id string, raw_chapters long")).first().report
        self.library.replace_books("chapters", merged, [book_id])
        self.library.replace_books("books", fresh, [book_id])
        self.library.write("index", registry.upsert_index(index, fresh))  # last: a book is there once the index has it
        notes = report.splitlines()
        if auto_link and content_type == "fiction":
            notes += self.auto_link(book_id)
        return book_id, notes

    def auto_link(self, book_id: str) -> list[str]:
        """Links the narrator's names and decorated names that the book's text makes plain."""
        own = self.chapters(book_id)
        notes = []
        for plan in vocatives.link_plan(vocatives.narrator_aliases(own)).collect():
            self.link(book_id, plan.names, plan.epithets, "narrator")
            notes.append(f"linked the narrator's names: {', '.join(plan.names)}")
        for group in names.person_link_groups(own).orderBy("place").collect():
            self.link(book_id, [group.name, *group.decorated], (), "decorated")
            notes.append(f"linked {group.name}: {', '.join(group.decorated)}")
        return notes

    # tables

    def chapters(self, book_id: str) -> DataFrame:
        return self.library.read("chapters").where(F.col("book_id") == book_id)

    def book(self, book_id: str):
        found = self.library.read("books").where(F.col("book_id") == book_id).first()
        if found is None:
            raise ValueError(f"no such book in the library: {book_id!r}")
        return found

    # extraction

    def extract(self, book_id: str, provider: providers.Provider, restart: bool = False, batch: int = 32, progress=None) -> dict:
        """Extracts the chapters that are still to do, `batch` of them at a time in the book's order.

        Each batch stores its facts, then the registry, then the checkpoint, so that a run that was cut short goes
        on at the batch it was in and doubles nothing. The names that a batch accepts are known to the next, as
        are those of the series' registry. progress, if given, is called with (chapters done, chapters in all,
        seconds left or None) after each.
        """
        book, lib, began = self.book(book_id), self.library, time.monotonic()
        chapters = self.chapters(book_id)
        identity = providers.optional(provider, "identity")
        point = extraction.resume_index(lib.read("checkpoints").where(F.col("book_id") == book_id), chapters, restart).first()
        total = chapters.count()
        if point.start >= total:
            return {"already_complete": True, "chapters": total}
        extraction.check_resume(point.provider, identity, point.start)
        longest = ingest.with_words(chapters).agg(F.max("n_words")).first()[0]
        providers.optional(provider, "narrow", self.spark.range(1).select(ingest.context_window(F.lit(longest), 16384)).first()[0])
        entities = lib.read("entities")
        if restart:
            entities = registry.prune_book(entities, book_id)
        for group in lib.read("declared").where(F.col("book_id") == book_id).orderBy("gseq").collect():
            entities = registry.seed_alias_group(entities, book_id, group.names, group.epithets)
        entities = settle(entities)
        order = reading.reading_order(lib.read("index")).where(F.col("book_id") == book_id)
        if order.isEmpty():
            order = self.spark.createDataFrame([(book_id, book_id, 1)], "book_id string, read_id string, book_rank int")
        order, before = settle(order), entities.count()
        tally = dict.fromkeys(("facts", "skipped", "repeated", "ungrounded", "parse_failures"), 0)
        for start in range(point.start, total, batch):
            end = min(start + batch, total)
            entities, counts = self._extract_batch(book, provider, entities, order, chapters.where(F.col("index").between(start, end - 1)), start, point.start)
            tally = {k: n + counts[k] for k, n in tally.items()}
            lib.replace_books("checkpoints", self.spark.createDataFrame([(book_id, total, end, identity)], CHECKPOINTS), [book_id])
            if progress is not None:
                progress(end, total, eta_seconds(time.monotonic() - began, end - point.start, total - end))
        return {"already_complete": False, "chapters": total, "resumed_from": point.start or None, "new_entities": entities.count() - before, **tally}

    def _extract_batch(self, book, provider: providers.Provider, entities: DataFrame, order: DataFrame, chapters: DataFrame, start: int, run_start: int) -> tuple[DataFrame, dict]:
        """(registry, counts) after the chapters, whose facts and registry are stored."""
        lib, here = self.library, F.col("book_id") == book.book_id
        stored = lib.read("facts").where(here & (F.col("chapter_index") < start))
        told = stored.where(F.col("chapter_index") >= run_start).select("book_id", "entity_name", F.lit(None).cast("string").alias("entity_type"))
        known = extraction.known_names(entities, order)
        known = settle(known.unionByName(told).groupBy("book_id", "entity_name").agg(F.max("entity_type").alias("entity_type")))
        todo = ingest.narrative(chapters)
        found, runs = providers.extract(todo.where("not skipped"), provider, book.content_type, known)
        found, runs = settle(found), settle(runs)
        marked = extraction.drop_repeats(found)
        grounded = extraction.ground(marked.where("not repeated"), chapters, known).where("accepted")
        scope = order.groupBy("book_id").agg(F.array_sort(F.collect_list("read_id")).alias("scope")).withColumn("scope_id", F.lit(book.book_id))
        resolved = settle(extraction.resolve(grounded, entities, scope))
        facts = resolved.select("book_id", (F.col("chapter_index").cast("long") * (1 << 32) + F.col("seq")).alias("seq"), "entity_id", "entity_name", "chapter_index", "category", "statement", "when", "time_phrase")
        lib.replace_books("facts", stored.unionByName(facts), [book.book_id])
        entities = settle(extraction.registry_after(resolved, entities))
        lib.write("entities", entities)
        n_found, n_facts, n_repeated = found.count(), facts.count(), marked.where("repeated").count()
        return entities, {
            "facts": n_facts, "skipped": todo.where("skipped").count(), "repeated": n_repeated, "ungrounded": n_found - n_repeated - n_facts, "parse_failures": runs.where("not ok").count(),
        }

    # questions

    def visible(self, book_id: str, chapter: int) -> DataFrame:
        reading.check_position(chapter, self.book(book_id).chapter_count)
        return reading.ranked(reading.facts_as_of(self.library.read("facts"), self.library.read("index"), book_id, chapter))

    def ask(self, book_id: str, chapter: int, question: str, provider: providers.Provider) -> tuple[str, list[str]]:
        """(answer, sources) from what is visible at the chapter and nothing else."""
        content_type = self.book(book_id).content_type or "fiction"
        entities = self.library.read("entities")
        facts = relevance.relevant_facts(question, self.visible(book_id, chapter), entities)
        text = context.format_context(facts, entities, content_type)
        return provider.answer(question, text, content_type), passages.source_lines(self.cited(facts)) if text else []

    def cited(self, facts: DataFrame) -> DataFrame:
        rows = facts.select(F.struct("book_id", "seq").alias("statement_id"), "book_id", "chapter_index", "statement")
        rows = rows.withColumn("statement_id", F.format_string("%s:%015d", "book_id", "statement_id.seq"))
        books = rows.select("book_id").distinct()
        return passages.citations(rows, self.library.read("chapters").join(books, "book_id", "left_semi"), self.library.read("books"))

    def compare(self, book_id: str, indexes: list[int], extractors: dict[str, providers.Provider]) -> list[str]:
        """A scorecard of extractors on the same chapters; nothing is stored. Each knows the names it found in earlier chapters."""
        content_type = self.book(book_id).content_type or "fiction"
        chapters = self.chapters(book_id)
        facts = runs = None
        for label, provider in extractors.items():
            known = self.spark.createDataFrame([], "book_id string, entity_name string, entity_type string")
            for index in sorted(indexes):
                f, r = (settle(x.withColumn("provider", F.lit(label))) for x in providers.extract(chapters.where(F.col("index") == index), provider, content_type, known))
                known = known.union(f.select("book_id", "entity_name", "entity_type")).dropDuplicates(["entity_name"])
                facts, runs = (f, r) if facts is None else (facts.unionByName(f), runs.unionByName(r))
        card = scorecard.scorecard(runs.withColumnRenamed("ok", "parse_ok"), facts, chapters)
        return [line for row in card.orderBy("provider").collect() for line in scorecard.scorecard_lines(row)]

    # catalog and changes

    def catalog(self) -> DataFrame:
        return registry.catalog(*(self.library.read(t) for t in ("index", "books", "facts", "entities")))

    def show(self, book_id: str):
        found = self.catalog().where(F.col("book_id") == book_id).first()
        if found is None:
            raise ValueError(f"no such book in the library: {book_id!r}")
        return found

    def remove(self, book_id: str) -> None:
        lib = self.library
        index, books, entities = registry.remove_book(book_id, lib.read("index"), lib.read("books"), lib.read("entities"))
        lib.write("index", index)
        lib.write("books", books)
        lib.write("entities", entities)
        for table in ("chapters", "facts", "declared", "checkpoints"):
            lib.write(table, lib.read(table).where(F.col("book_id") != book_id))

    def link(self, book_id: str, linked: list[str], epithets=(), reason: str = "") -> None:
        self._change(registry.link_names(*(self.library.read(t) for t in ("entities", "facts", "declared")), book_id, list(linked), list(epithets), reason), ("entities", "facts", "declared"))

    def unlink(self, book_id: str) -> None:
        self._change(registry.unlink_names(self.library.read("entities"), self.library.read("declared"), book_id), ("entities", "declared"))

    def merge(self, ids: list[str], keep: str | None = None) -> str:
        *changed, kept = registry.merge_entities(self.library.read("entities"), self.library.read("facts"), ids, keep)
        self._change(changed, ("entities", "facts"))
        return kept

    def split(self, entity_id: str) -> None:
        self._change(registry.split_cross_book(self.library.read("entities"), self.library.read("facts"), entity_id), ("entities", "facts"))

    def _change(self, tables, names_) -> None:
        for name, rows in zip(names_, [settle(t) for t in tables], strict=True):
            self.library.write(name, rows)

    def doctor(self, fix: bool = False) -> dict[str, list]:
        """Findings by kind; with `fix` the safe ones are mended: orphans, stale references and index entries."""
        index, books, facts, entities, chapters = (self.library.read(t) for t in ("index", "books", "facts", "entities", "chapters"))
        found = {
            "orphaned index entries": registry.orphaned_index_entries(index, books).orderBy("ord").select("book_id"),
            "stale references": registry.stale_references(entities, index, books).orderBy("ord", "k").select("entity_id", "book_id"),
            "orphaned entities": registry.orphaned_entities(entities, facts, index, books).orderBy("ord").select("entity_id"),
            "unnamed references": registry.unnamed_references(entities, facts, index, books).orderBy("book_id", "entity_id"),
            "duplicate entities": registry.duplicate_entities(entities, facts).orderBy("key"),
            "cross-book entities": registry.cross_book_entities(entities, facts, index).orderBy("ord").drop("ord"),
            "name variants": registry.name_variant_clusters(entities, chapters).orderBy("book_id", "members"),
        }
        report = {kind: rows.collect() for kind, rows in found.items()}
        if fix:
            self._change(registry.mend(index, books, entities, facts), ("index", "entities"))
        return report

    def merge_found(self, clusters: list[list[str]], confirmed) -> int:
        """Merges the clusters of entity ids that `confirmed` says yes to; returns how many."""
        done = 0
        for ids in clusters:
            if confirmed(ids):
                self.merge(ids)
                done += 1
        return done

