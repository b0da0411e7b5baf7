"""The engine's operators as queries over the driver's tables, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.lineage import settle
from folioscope.operators import context, extraction, ingest, names, passages, reading, registry, relevance, scorecard, vocatives
from folioscope.plans import tables as D
from folioscope.plans.tables import with_tables
from folioscope.schemas import PASSAGE_STOPWORDS, QUESTION_STOPWORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The reader's position in the fixed questions: chapter 7 of the third book of the second series.
BOOK, CHAPTER = "src7", 7
QUESTION = "who was erinan before the anshha came"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# catalog and reading


@query("chapters_index", with_tables("chapters counted", "SELECT book_id, chapter_index, n_words FROM counted"))
def chapters_index(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_words(D.chapters(spark, sf)).select("book_id", F.col("index").alias("chapter_index"), "n_words")


@query("skipped_short", with_tables("chapters counted", "SELECT book_id, count(*) AS chapters, count_if(n_words < 20) AS skipped FROM counted GROUP BY book_id"))
def skipped_short(spark, sf):
    return ingest.narrative(D.chapters(spark, sf)).groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if("skipped").alias("skipped"))


@query("reading_order", with_tables("books orders", "SELECT book_id, read_id, book_rank FROM orders"))
def reading_order(spark, sf):
    return reading.reading_order(D.index(spark, sf))


@query(
    "books_catalog",
    with_tables(
        "books chapters parts extracted facts entities",
        """SELECT book_id, title, chapter_count, fact_count, chapters_extracted, coalesce(entity_count, 0) AS entity_count, coalesce(chapters_extracted < chapter_count, false) AS partial, false AS orphaned
        FROM books LEFT JOIN (SELECT book_id, count(*) AS fact_count, max(chapter_index) + 1 AS chapters_extracted FROM facts GROUP BY book_id) USING (book_id)
        LEFT JOIN (SELECT book_id, count(*) AS entity_count FROM (SELECT unnest(book_ids) AS book_id FROM entities) GROUP BY book_id) USING (book_id)""",
    ),
)
def books_catalog(spark, sf):
    rows = registry.catalog(D.index(spark, sf), D.books(spark, sf), D.facts(spark, sf), D.entities(spark, sf))
    return rows.select("book_id", "title", "chapter_count", "fact_count", "chapters_extracted", "entity_count", "partial", "orphaned")


# extraction


@query("fake_facts", with_tables("chapters parts extracted", "SELECT book_id, chapter_index, seq, entity_name, statement FROM extracted"))
def fake_facts(spark, sf):
    return D.extracted(spark, sf).select("book_id", "chapter_index", "seq", "entity_name", "statement")


@query(
    "facts_dedup",
    with_tables("chapters parts extracted", """SELECT book_id, count(*) AS facts, count_if(rn > 1) AS repeated FROM (
        SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index % 10, lower(entity_name), lower(statement) ORDER BY chapter_index, seq) AS rn FROM extracted) GROUP BY book_id"""),
)
def facts_dedup(spark, sf):
    """Chapters whose numbers end alike are taken as one, as if their texts were."""
    rows = D.extracted(spark, sf).withColumn("seq", F.col("chapter_index").cast("long") * 1_000_000_000 + F.col("seq")).withColumn("chapter_index", F.col("chapter_index") % 10)
    return extraction.drop_repeats(rows).groupBy("book_id").agg(F.count("*").alias("facts"), F.count_if("repeated").alias("repeated"))


_NEXT = r"""moved AS (SELECT e.book_id, e.chapter_index, e.seq, e.entity_name,
    coalesce(regexp_matches(regexp_replace(n.text, '[À-ÖØ-öø-ÿ]', '_', 'g'), '\b' || stem || '(?:e?s)?\b'), false) AS grounded
    FROM (SELECT *, CASE WHEN length(entity_name) > 3 AND entity_name LIKE '%es' THEN left(entity_name, length(entity_name) - 2)
      WHEN length(entity_name) > 2 AND entity_name LIKE '%s' THEN left(entity_name, length(entity_name) - 1) ELSE entity_name END AS stem FROM extracted) e
    JOIN chapters n ON n.book_id = e.book_id AND n.chapter_index = e.chapter_index + 1)"""


def _moved(spark, sf):
    """Facts held against the chapter after theirs, which has some of the names only."""
    chapters = D.chapters(spark, sf)
    rows = D.extracted(spark, sf).withColumn("chapter_index", F.col("chapter_index") + 1)
    known = spark.createDataFrame([], "book_id string, entity_name string")
    return extraction.ground(rows, chapters, known).withColumn("chapter_index", F.col("chapter_index") - 1)


@query("grounded_names", with_tables("chapters parts extracted", "").strip() + ",\n" + _NEXT + "\nSELECT book_id, chapter_index, seq, entity_name, grounded FROM moved")
def grounded_names(spark, sf):
    return _moved(spark, sf).select("book_id", "chapter_index", "seq", "entity_name", "grounded")


@query(
    "running_known",
    with_tables("chapters parts extracted", "").strip() + ",\n" + _NEXT + """
    SELECT book_id, chapter_index, seq, entity_name, bool_or(grounded) OVER (PARTITION BY book_id, entity_name ORDER BY chapter_index, seq) AS accepted FROM moved""",
)
def running_known(spark, sf):
    return _moved(spark, sf).select("book_id", "chapter_index", "seq", "entity_name", "accepted")


@query("resolve_entities", with_tables("books chapters parts extracted facts", "SELECT book_id, seq, entity_id, entity_name FROM facts"))
def resolve_entities(spark, sf):
    return D.facts(spark, sf).select("book_id", "seq", "entity_id", "entity_name")


@query("entity_registry", with_tables("books chapters parts extracted facts entities", "SELECT entity_id, canonical_name, len(book_ids) AS books FROM entities"))
def entity_registry(spark, sf):
    return D.entities(spark, sf).select("entity_id", "canonical_name", F.size("book_ids").alias("books"))


# as of


_VISIBLE = "visible AS (SELECT f.*, book_rank FROM facts f JOIN orders o ON o.read_id = f.book_id AND o.book_id = 'src7' WHERE f.book_id <> 'src7' OR chapter_index <= 7)"


def _as_of(select: str, more: str = "") -> str:
    return with_tables(f"books chapters parts extracted facts orders {more}", "").strip() + ",\n" + _VISIBLE + "\n" + select


def _visible(spark, sf):
    return reading.ranked(reading.facts_as_of(D.facts(spark, sf), D.index(spark, sf), BOOK, CHAPTER))


@query("facts_as_of", _as_of('SELECT book_id, seq, entity_id, chapter_index, category, statement, "when", time_phrase, book_rank FROM visible'))
def facts_as_of(spark, sf):
    return _visible(spark, sf).select("book_id", "seq", "entity_id", "chapter_index", "category", "statement", "when", "time_phrase", "book_rank")


@query(
    "facts_at_positions",
    with_tables("books chapters parts extracted facts orders", """SELECT o.book_id AS target, count(*) AS facts, count(DISTINCT entity_id) AS entities
        FROM facts f JOIN orders o ON o.read_id = f.book_id JOIN books b ON b.book_id = o.book_id
        WHERE f.book_id <> o.book_id OR f.chapter_index <= b.chapter_count // 2 GROUP BY o.book_id"""),
)
def facts_at_positions(spark, sf):
    """What a reader in the middle of each book has met."""
    positions = D.books(spark, sf).select(F.col("book_id").alias("position_id"), "book_id", F.expr("chapter_count div 2").cast("int").alias("chapter_index"))
    rows = reading.facts_at_positions(D.facts(spark, sf), D.index(spark, sf), positions)
    return rows.groupBy(F.col("position_id").alias("target")).agg(F.count("*").alias("facts"), F.count_distinct("entity_id").alias("entities"))


@query("facts_named", _as_of("SELECT canonical_name AS name, count(*) AS facts FROM visible JOIN entities USING (entity_id) GROUP BY entity_id, canonical_name", "entities"))
def facts_named(spark, sf):
    return reading.with_names(_visible(spark, sf), D.entities(spark, sf)).groupBy("entity_id", "name").agg(F.count("*").alias("facts")).select("name", "facts")


# relevance and context


def _sql_question_words(c: str) -> str:
    edges = "''.,!?;:\"()[]-—…"
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\\s+'), lambda w: trim(w, '{edges}')), lambda w: length(w) > 2 AND w NOT IN ({_quoted(QUESTION_STOPWORDS)})))"


_DF = f"words AS (SELECT book_id, seq, chapter_index, book_rank, unnest({_sql_question_words('statement')}) AS word FROM visible), df AS (SELECT word, count(*) AS df FROM words GROUP BY word)"


@query("statement_df", _as_of("SELECT word, df FROM df").replace(_VISIBLE, _VISIBLE + ",\n" + _DF))
def statement_df(spark, sf):
    return relevance.statement_frequencies(_visible(spark, sf))


_RARE = _DF + ", rare AS (SELECT word, df FROM df WHERE df <= greatest(1, (SELECT count(*) FROM visible) // 10) AND word IN (SELECT unnest(" + _sql_question_words(f"'{QUESTION}'") + ")))"


@query("distinctive_words", _as_of("SELECT word, df FROM rare").replace(_VISIBLE, _VISIBLE + ",\n" + _RARE))
def distinctive_words(spark, sf):
    facts = _visible(spark, sf)
    ceiling = max(1, facts.count() // 10)
    wanted = spark.range(1).select(F.explode(T.question_words(F.lit(QUESTION))).alias("word"))
    return relevance.statement_frequencies(facts).join(wanted, "word").where(F.col("df") <= ceiling)


@query(
    "relevance_top80",
    _as_of("SELECT book_id, seq, round(sum(1.0::DOUBLE / df), 9) AS score FROM words JOIN rare USING (word) GROUP BY book_id, seq, book_rank, chapter_index ORDER BY round(sum(1.0::DOUBLE / df), 12) DESC, chapter_index, book_rank, seq LIMIT 80").replace(_VISIBLE, _VISIBLE + ",\n" + _RARE),
)
def relevance_top80(spark, sf):
    return relevance.facts_by_rare_words(QUESTION, _visible(spark, sf)).select("book_id", "seq", F.round("score", 9).alias("score"))


@query(
    "entities_asked_for",
    _as_of(f"SELECT DISTINCT entity_id FROM visible JOIN entities USING (entity_id) WHERE contains('{QUESTION}', lower(canonical_name)) OR contains('{QUESTION}', CASE WHEN lower(canonical_name) LIKE '%s' AND length(canonical_name) > 1 THEN left(lower(canonical_name), length(canonical_name) - 1) ELSE lower(canonical_name) END)", "entities"),
)
def entities_asked_for(spark, sf):
    names_ = _visible(spark, sf).select("entity_id").distinct().join(relevance.names_for_questions(D.entities(spark, sf)), "entity_id")
    return names_.where(relevance.name_in_question(F.col("name"), F.lit(QUESTION))).select("entity_id").distinct()


@query("relevant_facts")
def relevant_facts(spark, sf):
    return relevance.relevant_facts(QUESTION, _visible(spark, sf), D.entities(spark, sf)).select("book_id", "seq", "entity_id", "statement")


@query(
    "context_buckets",
    _as_of("""SELECT entity_id, CASE WHEN "when" = 'past' THEN 0 WHEN "when" = 'future' THEN 2 WHEN category IN ('status', 'development', 'relationship') THEN 1 ELSE 3 END AS bucket, count(*) AS facts FROM visible GROUP BY ALL"""),
)
def context_buckets(spark, sf):
    return _visible(spark, sf).groupBy("entity_id", context.bucket().alias("bucket")).agg(F.count("*").alias("facts"))


_CONTEXT = (
    """lines AS (SELECT *, CASE WHEN "when" = 'past' THEN 0 WHEN "when" = 'future' THEN 2 WHEN category IN ('status', 'development', 'relationship') THEN 1 ELSE 3 END AS bucket,
      book_rank * 100000000000000000 + seq AS r FROM visible),
    told AS (SELECT *, CASE WHEN bucket = 3 THEN category ELSE '' END AS kind, CASE WHEN bucket < 3 THEN '    [ch ' || chapter_index || coalesce(' - ' || time_phrase, '') || '] (' || category || ') ' || statement
      ELSE '      [ch ' || chapter_index || '] ' || statement END AS line FROM lines),
    kinds AS (SELECT entity_id, bucket, kind, min(r) AS kr, string_agg(line, chr(10) ORDER BY chapter_index, r) AS part FROM told GROUP BY ALL),
    buckets AS (SELECT entity_id, bucket, string_agg(CASE WHEN bucket = 3 THEN '    ' || kind || ':' || chr(10) || part ELSE part END, chr(10) ORDER BY kr) AS part FROM kinds GROUP BY ALL)
    SELECT entity_id, canonical_name || chr(10) || string_agg(list_extract(["""
    + _quoted(context.HEADINGS)
    + """], bucket + 1) || chr(10) || part, chr(10) ORDER BY bucket) AS block FROM buckets JOIN entities USING (entity_id) GROUP BY entity_id, canonical_name"""
)


@query("context_text", _as_of(_CONTEXT, "entities").replace(_VISIBLE + "\n", _VISIBLE + ",\n"))
def context_text(spark, sf):
    return context.entity_blocks(_visible(spark, sf), D.entities(spark, sf)).select("entity_id", "block")


# registry


@query("entity_fact_counts", with_tables("books chapters parts extracted facts", "SELECT entity_id, count(*) AS fact_count FROM facts GROUP BY entity_id"))
def entity_fact_counts(spark, sf):
    return registry.fact_counts(D.entities(spark, sf), D.facts(spark, sf))


@query(
    "duplicate_clusters",
    with_tables("books chapters parts extracted facts entities", """SELECT key, count(*) AS members, sum(n) AS facts FROM (SELECT entity_id, CASE WHEN lower(canonical_name) LIKE '%s' AND length(canonical_name) > 1 THEN left(lower(canonical_name), length(canonical_name) - 1) ELSE lower(canonical_name) END AS key FROM entities)
        JOIN (SELECT entity_id, count(*) AS n FROM facts GROUP BY entity_id) USING (entity_id) GROUP BY key HAVING count(*) > 1"""),
)
def duplicate_clusters(spark, sf):
    rows = registry.duplicate_entities(D.entities(spark, sf), D.facts(spark, sf))
    return rows.select("key", F.size("members").cast("long").alias("members"), F.aggregate("members", F.lit(0).cast("long"), lambda n, m: n + m["fact_count"]).alias("facts"))


def _mixed(spark, sf):
    """The registry as if ids were shared across series: entities of one key are one."""
    rows = D.entities(spark, sf).groupBy(T.match_key("canonical_name").alias("entity_id")).agg(F.min("canonical_name").alias("canonical_name"), F.first("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("book_ids")))).alias("book_ids"))
    none = F.array().cast("array<string>")
    return rows.select("entity_id", "canonical_name", "type", none.alias("aliases"), none.alias("epithets"), "book_ids", F.xxhash64("entity_id").alias("ord"))


_MIXED = """mixed AS (SELECT *, CASE WHEN lower(entity_name) LIKE '%s' AND length(entity_name) > 1 THEN left(lower(entity_name), length(entity_name) - 1) ELSE lower(entity_name) END AS id FROM facts)"""


def _mixed_facts(spark, sf):
    return D.facts(spark, sf).withColumn("entity_id", T.match_key("entity_name"))


@query(
    "cross_book_entities",
    with_tables("books chapters parts extracted facts", "").strip() + ",\n" + _MIXED + """
    SELECT id AS entity_id, count(DISTINCT book_id) AS books, count(*) AS facts FROM mixed JOIN books USING (book_id) GROUP BY id HAVING count(DISTINCT book_id) >= 2 AND count(DISTINCT series) > 1""",
)
def cross_book_entities(spark, sf):
    rows = registry.cross_book_entities(_mixed(spark, sf), _mixed_facts(spark, sf), D.index(spark, sf))
    return rows.select("entity_id", F.size("facts_per_book").cast("long").alias("books"), F.aggregate(F.map_values("facts_per_book"), F.lit(0).cast("long"), lambda n, x: n + x).alias("facts"))


def _thinned(spark, sf):
    """A library with faults: src3 has no book, and names that begin with T no entity."""
    books = D.books(spark, sf).where("book_id <> 'src3'")
    facts = D.facts(spark, sf).where("entity_name not like 'E%'").select("book_id", "entity_id")
    return D.index(spark, sf), books, settle(D.entities(spark, sf).where("canonical_name not like 'T%'")), facts


@query("orphan_index", "SELECT DISTINCT source AS book_id FROM documents WHERE source = 'src3'")
def orphan_index(spark, sf):
    index, books, _, _ = _thinned(spark, sf)
    return registry.orphaned_index_entries(index, books).select("book_id")


@query("stale_references", with_tables("books chapters parts extracted facts entities", "SELECT entity_id, b AS book_id FROM (SELECT entity_id, canonical_name, unnest(book_ids) AS b FROM entities) WHERE b = 'src3' AND canonical_name NOT LIKE 'T%'"))
def stale_references(spark, sf):
    index, books, entities, _ = _thinned(spark, sf)
    return registry.stale_references(entities, index, books).select("entity_id", "book_id")


@query("orphan_entities", with_tables("books chapters parts extracted facts entities", "SELECT entity_id FROM entities WHERE canonical_name NOT LIKE 'T%' AND entity_id NOT IN (SELECT entity_id FROM facts WHERE book_id <> 'src3' AND entity_name NOT LIKE 'E%')"))
def orphan_entities(spark, sf):
    index, books, entities, facts = _thinned(spark, sf)
    return registry.orphaned_entities(entities, facts, index, books).select("entity_id")


@query("dangling_refs", with_tables("books chapters parts extracted facts entities", "SELECT DISTINCT book_id, entity_id FROM facts WHERE book_id <> 'src3' AND entity_name NOT LIKE 'E%' AND entity_id IN (SELECT entity_id FROM entities WHERE canonical_name LIKE 'T%')"))
def dangling_refs(spark, sf):
    index, books, entities, facts = _thinned(spark, sf)
    return registry.unnamed_references(entities, facts, index, books)


@query("mended_registry", with_tables("books chapters parts extracted facts entities", """SELECT entity_id, len(list_filter(book_ids, lambda b: b <> 'src3')) AS books FROM entities WHERE canonical_name NOT LIKE 'T%' AND entity_id IN (SELECT entity_id FROM facts WHERE book_id <> 'src3' AND entity_name NOT LIKE 'E%')"""))
def mended_registry(spark, sf):
    index, books, entities, facts = _thinned(spark, sf)
    return registry.mend(index, books, entities, facts)[1].select("entity_id", F.size("book_ids").alias("books"))


@query("pruned_registry", with_tables("books chapters parts extracted facts entities", "SELECT entity_id, len(list_filter(book_ids, lambda b: b <> 'src0')) AS books FROM entities WHERE book_ids <> ['src0']"))
def pruned_registry(spark, sf):
    return registry.prune_book(D.entities(spark, sf), "src0").select("entity_id", F.size("book_ids").alias("books"))


@query("upserted_index", with_tables("books", "SELECT book_id, CASE WHEN book_id = 'src1' THEN 'new' ELSE title END AS title, CASE WHEN book_id = 'src1' THEN (SELECT max(ord) + 1 FROM books) ELSE ord END AS ord FROM books"))
def upserted_index(spark, sf):
    index = D.index(spark, sf)
    return registry.upsert_index(index, index.where("book_id = 'src1'").withColumn("title", F.lit("new"))).select("book_id", "title", "ord")


_MERGE_IDS = "SELECT entity_id FROM facts WHERE entity_name IN ('Erinan', 'Thand', 'Andre', 'Reand', 'Anthe', 'Thean', 'Erthe')"


@query("merged_entities", with_tables("books chapters parts extracted facts", f"""SELECT entity_id, count(*) AS facts FROM (SELECT CASE WHEN entity_id IN ({_MERGE_IDS}) THEN 'merged' ELSE entity_id END AS entity_id FROM facts) GROUP BY entity_id"""))
def merged_entities(spark, sf):
    """Entities of a few names made one; its id stands as "merged"."""
    entities, facts = settle(D.entities(spark, sf)), settle(D.facts(spark, sf).select("book_id", "entity_id", "entity_name"))
    ids = sorted(r.entity_id for r in facts.where(F.col("entity_name").isin("Erinan", "Thand", "Andre", "Reand", "Anthe", "Thean", "Erthe")).select("entity_id").distinct().collect())
    if len(ids) < 2:
        return facts.groupBy(F.when(F.col("entity_id").isin(*ids), "merged").otherwise(F.col("entity_id")).alias("entity_id")).agg(F.count("*").alias("facts")) if ids else facts.groupBy("entity_id").agg(F.count("*").alias("facts"))
    _, facts, kept = registry.merge_entities(entities, facts, ids)
    return facts.groupBy(F.when(F.col("entity_id") == kept, "merged").otherwise(F.col("entity_id")).alias("entity_id")).agg(F.count("*").alias("facts"))


@query("split_entity", with_tables("books chapters parts extracted facts", "").strip() + ",\n" + _MIXED + """
    SELECT book_id, count(*) AS facts, count(DISTINCT CASE WHEN id = 'and' THEN id || book_id ELSE id END) AS entities FROM mixed GROUP BY book_id""")
def split_entity(spark, sf):
    entities, facts = registry.split_cross_book(settle(_mixed(spark, sf)), settle(_mixed_facts(spark, sf).select("book_id", "entity_id")), "and")
    return facts.groupBy("book_id").agg(F.count("*").alias("facts"), F.count_distinct("entity_id").alias("entities"))


@query("prefix_pairs", with_tables("books chapters parts extracted facts entities", "").strip() + """,
    m AS (SELECT entity_id, canonical_name AS name, lower(canonical_name) AS low, unnest(book_ids) AS book_id FROM entities),
    starts AS (SELECT book_id, entity_id, left(low, k) AS start FROM (SELECT *, unnest(range(3, length(low))) AS k FROM m))
    SELECT m.book_id, m.entity_id AS a, s.entity_id AS b FROM m JOIN starts s ON s.book_id = m.book_id AND s.start = m.low WHERE length(m.low) >= 3 AND m.entity_id <> s.entity_id""")
def prefix_pairs(spark, sf):
    return registry.prefix_pairs(registry.members(D.entities(spark, sf))).select("book_id", "a", "b")


@query("name_components", with_tables("books chapters parts extracted facts entities", "").strip() + """,
    m AS (SELECT DISTINCT b AS scope, lower(canonical_name) AS low FROM (SELECT canonical_name, unnest(book_ids) AS b FROM entities)),
    n AS (SELECT scope, low, CASE WHEN length(low) > 1 AND low LIKE '%s' THEN left(low, length(low) - 1) ELSE low END AS key FROM m),
    ends AS (SELECT scope, low, '=' || key AS spot FROM n UNION SELECT scope, low, '^' || left(low, k) FROM (SELECT *, unnest(range(3, length(low) + 1)) AS k FROM n)),
    hubs AS (SELECT scope, low, '=' || key AS spot FROM n UNION SELECT scope, low, '^' || low FROM n WHERE length(low) >= 3),
    e AS (SELECT DISTINCT h.scope, h.low AS a, x.low AS b FROM hubs h JOIN ends x USING (scope, spot) WHERE h.low <> x.low)
    SELECT scope, count(*) AS names, count_if(NOT EXISTS (SELECT 1 FROM e WHERE e.scope = n.scope AND (e.a = n.low OR e.b = n.low))) AS alone FROM n GROUP BY scope""")
def name_components(spark, sf):
    """Names of each book, and how many are no variant of another."""
    rows = registry.members(D.entities(spark, sf)).select(F.col("book_id").alias("scope"), F.lower("name").alias("name")).distinct()
    groups = registry.name_groups(rows).groupBy("scope", "component").agg(F.count("*").alias("n"))
    return groups.groupBy("scope").agg(F.sum("n").alias("names"), F.count_if(F.col("n") == 1).alias("alone"))


@query("name_variant_clusters")
def name_variant_clusters(spark, sf):
    return registry.name_variant_clusters(D.entities(spark, sf), D.chapters(spark, sf))


# text functions


@query("match_keys", r"SELECT p_partkey, regexp_replace(k, '^(.+)s$', '\1') AS key FROM (SELECT p_partkey, regexp_replace(lower(trim(p_name)), '^the ', '') AS k FROM part)")
def match_keys(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.match_key("p_name").alias("key"))


@query("slugs", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') AS slug FROM part")
def slugs(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.slugify(F.concat_ws(" ", "p_type", "p_name")).alias("slug"))


@query("title_guess", r"""WITH n AS (SELECT o_orderkey, lower(o_orderpriority) || ' of the ' || lower(o_orderstatus) || '_by_' || 'clerk-' || o_custkey AS stem FROM orders),
    f AS (SELECT o_orderkey, regexp_replace(trim(regexp_replace(stem, '[_-]+', ' ', 'g')), '\s+', ' ', 'g') AS flat FROM n),
    w AS (SELECT o_orderkey, string_split(split_part(flat, ' by ', 1), ' ') AS t, string_split(split_part(flat, ' by ', 2), ' ') AS a FROM f)
    SELECT o_orderkey, array_to_string(list_transform(t, lambda x, i: CASE WHEN i > 1 AND x IN ('of', 'the') THEN x ELSE upper(left(x, 1)) || substr(x, 2) END), ' ') AS title,
      array_to_string(list_transform(a, lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS author FROM w""")
def title_guess(spark, sf):
    stem = F.concat(F.lower("o_orderpriority"), F.lit(" of the "), F.lower("o_orderstatus"), F.lit("_by_clerk-"), F.col("o_custkey"))
    return D.table(spark, sf, "orders").select("o_orderkey", T.guess_title_author(stem).alias("g")).select("o_orderkey", "g.title", "g.author")


# passages

_SPLIT = r"""spans AS (SELECT book_id, chapter_index, i, sentence FROM (SELECT book_id, chapter_index, sentence, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY k) - 1 AS i FROM (
    SELECT book_id, chapter_index, unnest(p) AS sentence, generate_subscripts(p, 1) AS k FROM (
      SELECT book_id, chapter_index, string_split(regexp_replace(regexp_replace(text, '([.!?"''”’])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)) AS p FROM chapters))
    WHERE trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) <> ''))"""


@query("sentence_spans", with_tables("chapters", "").strip() + ",\n" + _SPLIT + "\nSELECT book_id, chapter_index, i, sentence FROM spans")
def sentence_spans(spark, sf):
    return passages.sentences(D.chapters(spark, sf)).select("book_id", "chapter_index", "i", "sentence")


def _sql_passage_words(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9'']+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ({_quoted(PASSAGE_STOPWORDS)})))"


@query("sentence_idf", with_tables("chapters", "").strip() + ",\n" + _SPLIT + f"\nSELECT book_id, chapter_index, word, round(1.0::DOUBLE / count(*), 9) AS idf FROM (SELECT book_id, chapter_index, unnest({_sql_passage_words('sentence')}) AS word FROM spans) GROUP BY ALL")
def sentence_idf(spark, sf):
    return passages.word_weights(D.chapters(spark, sf)).select("book_id", "chapter_index", "word", F.round("idf", 9).alias("idf"))


def _statements(spark, sf):
    return D.facts(spark, sf).select(F.concat_ws(":", "book_id", F.col("seq").cast("string")).alias("statement_id"), "book_id", "chapter_index", "statement")


_PASSAGES = f"""toks AS (SELECT book_id, chapter_index, part, k FROM (SELECT book_id, chapter_index, unnest(ps) AS part, generate_subscripts(ps, 1) AS k
      FROM (SELECT book_id, chapter_index, regexp_extract_all(text, '[^A-Za-z0-9'']*[A-Za-z0-9'']+') AS ps FROM chapters))),
    gaps AS (SELECT book_id, chapter_index, k, regexp_extract(part, '[A-Za-z0-9'']+$') AS word, rtrim(regexp_extract(part, '^[^A-Za-z0-9'']*'), ' ' || chr(9) || chr(10) || chr(13)) AS gap FROM toks),
    lasts AS (SELECT *, CASE WHEN gap <> '' THEN right(gap, 1) ELSE right(lag(word) OVER (PARTITION BY book_id, chapter_index ORDER BY k), 1) END AS prev FROM gaps),
    learnt AS (SELECT DISTINCT book_id, chapter_index, lower(word) AS word FROM lasts WHERE lower(word) IN ({_quoted(PASSAGE_STOPWORDS)}) AND regexp_matches(word, '^[A-Z]') AND NOT contains('.!?"''”’', prev)),
    sw AS (SELECT DISTINCT book_id, chapter_index, i, lower(w) AS word FROM (SELECT book_id, chapter_index, i, unnest(regexp_extract_all(sentence, '[A-Za-z0-9'']+')) AS w FROM spans) WHERE length(w) >= 2),
    sk AS (SELECT s.* FROM sw s LEFT JOIN learnt l USING (book_id, chapter_index, word) WHERE l.word IS NOT NULL OR word NOT IN ({_quoted(PASSAGE_STOPWORDS)})),
    idf AS (SELECT book_id, chapter_index, word, 1.0::DOUBLE / count(*) AS idf FROM sk GROUP BY ALL),
    fw AS (SELECT DISTINCT book_id, chapter_index, seq, lower(w) AS word FROM (SELECT book_id, chapter_index, seq, unnest(regexp_extract_all(statement, '[A-Za-z0-9'']+')) AS w FROM facts) WHERE length(w) >= 2),
    wanted AS (SELECT f.*, coalesce(idf, 1.0) AS weight FROM fw f LEFT JOIN learnt l USING (book_id, chapter_index, word) LEFT JOIN idf USING (book_id, chapter_index, word) WHERE l.word IS NOT NULL OR word NOT IN ({_quoted(PASSAGE_STOPWORDS)})),
    total AS (SELECT book_id, seq, sum(weight) AS total FROM wanted GROUP BY ALL),
    pairs AS (SELECT book_id, chapter_index, i, 0 AS pair, word FROM sk UNION SELECT s.book_id, s.chapter_index, s.i, 1, k.word FROM spans s JOIN spans n ON n.book_id = s.book_id AND n.chapter_index = s.chapter_index AND n.i = s.i + 1
      JOIN sk k ON k.book_id = s.book_id AND k.chapter_index = s.chapter_index AND (k.i = s.i OR k.i = n.i)),
    scored AS (SELECT w.book_id, w.seq, p.i, p.pair, sum(weight) AS shared FROM wanted w JOIN pairs p USING (book_id, chapter_index, word) GROUP BY ALL),
    best AS (SELECT book_id, seq, i, pair, shared / total * CASE WHEN pair = 1 THEN 0.95 ELSE 1.0 END AS score FROM scored JOIN total USING (book_id, seq)
      QUALIFY row_number() OVER (PARTITION BY book_id, seq ORDER BY round(shared / total * CASE WHEN pair = 1 THEN 0.95 ELSE 1.0 END, 12) DESC, i, pair) = 1)
    SELECT book_id || ':' || seq AS statement_id, i, pair, round(score, 9) AS score FROM best WHERE score >= 0.4"""


@query("passage_places", with_tables("books chapters parts extracted facts", "").strip() + ",\n" + _SPLIT + ",\n" + _PASSAGES)
def passage_places(spark, sf):
    """Which sentence of its chapter each statement comes from, alone or with the next."""
    return passages.located(_statements(spark, sf), D.chapters(spark, sf)).select("statement_id", "i", "pair", F.round("score", 9).alias("score"))


@query("passage_best")
def passage_best(spark, sf):
    return passages.passages(_statements(spark, sf), D.chapters(spark, sf))


@query("citations")
def citations(spark, sf):
    return passages.citations(_statements(spark, sf), D.chapters(spark, sf), D.books(spark, sf)).select("statement_id", "where", "rendered")


@query("volumes_at", with_tables("books chapters", """SELECT c.book_id, chapter_index, CASE WHEN chapter_index < chapter_count // 2 THEN 'First' ELSE 'Second' END AS volume,
    CASE WHEN chapter_index < chapter_count // 2 THEN chapter_index + 1 ELSE chapter_index - chapter_count // 2 + 1 END AS volume_chapter FROM chapters c JOIN books b USING (book_id) WHERE ord % 3 = 0"""))
def volumes_at(spark, sf):
    return passages.volumes_at(D.chapters(spark, sf), D.books(spark, sf))


# ingestion


@query("upper_medians", with_tables("chapters counted", "SELECT book_id, list_extract(list_sort(list(n_words)), len(list(n_words)) // 2 + 1) AS median_words, list_extract(list_sort(list(n_words)), len(list(n_words)) // 2 + 1) < 600 AS consolidate FROM counted GROUP BY book_id"))
def upper_medians(spark, sf):
    return ingest.consolidation(D.chapters(spark, sf))


_FOLD = """fold AS (SELECT book_id, chapter_index, n_words AS held, 0 AS merged_index FROM counted WHERE chapter_index = 0
    UNION ALL SELECT c.book_id, c.chapter_index, CASE WHEN held >= 2000 THEN n_words ELSE held + n_words END, merged_index + (held >= 2000)::INT FROM fold f JOIN counted c ON c.book_id = f.book_id AND c.chapter_index = f.chapter_index + 1)"""


@query("consolidate_groups", with_tables("chapters counted", "").strip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _FOLD + '\nSELECT book_id, chapter_index AS "index", merged_index FROM fold')
def consolidate_groups(spark, sf):
    return ingest.fragment_groups(D.chapters(spark, sf))


@query("merged_chapters", with_tables("chapters counted", "").strip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _FOLD + """
    SELECT book_id, merged_index AS "index", md5(string_agg(text, chr(10) || chr(10) ORDER BY chapter_index)) AS text_md5 FROM fold JOIN chapters USING (book_id, chapter_index) GROUP BY book_id, merged_index""")
def merged_chapters(spark, sf):
    return ingest.consolidate(D.chapters(spark, sf)).select("book_id", "index", F.md5("text").alias("text_md5"))


@query("split_pieces")
def split_pieces(spark, sf):
    return ingest.split_chapters(D.chapters(spark, sf), threshold=1500, target=800, overlap=60).select("book_id", "index", "piece", T.word_count("text").alias("n_words"))


@query("sanity_figures", with_tables("chapters counted", "SELECT book_id, count(*) AS chapters, min(n_words) AS min_words, CAST(round_even(median(n_words), 0) AS BIGINT) AS median_words, max(n_words) AS max_words FROM counted GROUP BY book_id"))
def sanity_figures(spark, sf):
    return ingest.sanity(D.chapters(spark, sf)).select("book_id", "chapters", "min_words", "median_words", "max_words")


@query("context_windows", with_tables("chapters counted", """SELECT book_id, CASE WHEN need <= 4096 THEN 4096 WHEN need <= 8192 THEN 8192 ELSE 16384 END AS num_ctx FROM (SELECT book_id, floor(max(n_words) * 1.25) + 2600 AS need FROM counted GROUP BY book_id)"""))
def context_windows(spark, sf):
    rows = ingest.with_words(D.chapters(spark, sf)).groupBy("book_id").agg(F.max("n_words").alias("n"))
    return rows.select("book_id", ingest.context_window(F.col("n"), 16384).alias("num_ctx"))


@query("html_headings", r"""SELECT page_id, 0 AS segment, nullif(trim(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h[123](?:\s[^>]*)?>(.*?)</h[123]>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')), '') AS title FROM pages""")
def html_headings(spark, sf):
    return ingest.html_segments(D.table(spark, sf, "pages")).select("page_id", "segment", "title")


# names


@query("capitalised_runs", with_tables("chapters", r"""SELECT book_id, run, count(*) AS n FROM (SELECT book_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,4}')), '[ \t]+', ' ', 'g') AS run FROM chapters) GROUP BY ALL"""))
def capitalised_runs(spark, sf):
    return names.capitalised_runs(D.chapters(spark, sf)).select("book_id", "run", "n")


@query("lowercase_words", with_tables("chapters", "SELECT book_id, word, count(*) AS n FROM (SELECT book_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM chapters) WHERE regexp_full_match(word, '[a-z]+') GROUP BY ALL"))
def lowercase_words(spark, sf):
    return names.lowercase_words(D.chapters(spark, sf))


@query("inside_runs", with_tables("chapters", r"""SELECT book_id, token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT book_id, run, n, unnest(list_distinct(string_split(run, ' '))) AS token FROM (
    SELECT book_id, run, count(*) AS n FROM (SELECT book_id, regexp_replace(unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){0,4}')), '[ \t]+', ' ', 'g') AS run FROM chapters) GROUP BY ALL) WHERE contains(run, ' ')) GROUP BY ALL"""))
def inside_runs(spark, sf):
    return names.inside_runs(names.capitalised_runs(D.chapters(spark, sf)))


@query("person_links")
def person_links(spark, sf):
    return names.person_link_groups(D.chapters(spark, sf))


# dialogue


def _turns(spark, sf):
    """Conversations as chapters: a line for each turn, users in the first person."""
    rows = D.table(spark, sf, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit('I said, "'), "text", F.lit('"'))).otherwise(F.concat(F.lit('"'), "text", F.lit('" said Robin.')))
    return rows.groupBy(F.col("conv_id").cast("int").alias("index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text")).select(F.lit("talk").alias("book_id"), "index", "text")


@query("first_person_chapters")
def first_person_chapters(spark, sf):
    return vocatives.first_person(_turns(spark, sf))


@query("quote_styles")
def quote_styles(spark, sf):
    return vocatives.quote_style(D.chapters(spark, sf))


@query("narrator_aliases")
def narrator_aliases(spark, sf):
    return vocatives.narrator_aliases(_turns(spark, sf))


# scorecard


def _sql_score_words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda w: length(w) > 3))"


@query("near_duplicates", with_tables("books chapters parts extracted facts", f"""SELECT a.book_id, a.chapter_index, a.seq AS a, b.seq AS b FROM (SELECT book_id, chapter_index, seq, {_sql_score_words('statement')} AS w FROM facts) a
    JOIN (SELECT book_id, chapter_index, seq, {_sql_score_words('statement')} AS w FROM facts) b ON a.book_id = b.book_id AND a.chapter_index = b.chapter_index AND a.seq < b.seq
    WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6"""))
def near_duplicates(spark, sf):
    return scorecard.near_duplicate_pairs(D.facts(spark, sf), ["book_id", "chapter_index"])


@query("groundedness", with_tables("books chapters parts extracted facts", """SELECT f.book_id, f.seq, round(coalesce(len(list_filter(w, lambda x: contains(low, x)))::DOUBLE / nullif(len(w), 0), 1.0), 9) AS score FROM (
    SELECT f.*, lower(c.text) AS low, list_transform(list_filter(regexp_split_to_array(statement, '\\s+'), lambda w: length(w) > 3), lambda w: trim(lower(w), '.,;:!?"''')) AS w FROM facts f JOIN chapters c ON c.book_id = f.book_id AND c.chapter_index = f.chapter_index + 1) f""".replace("\\\\s", "\\s")))
def groundedness(spark, sf):
    """Statements held against the chapter after theirs."""
    rows = D.facts(spark, sf).withColumn("next", F.col("chapter_index") + 1)
    return scorecard.grounded_facts(rows, D.chapters(spark, sf), at="next").select("book_id", "seq", F.round("g", 9).alias("score"))


@query("eval_scorecard")
def eval_scorecard(spark, sf):
    """Two extractors on the same chapters: all facts, and those of capitals late in the alphabet."""
    facts = D.facts(spark, sf)
    both = facts.withColumn("provider", F.lit("all")).union(facts.where("entity_name > 'M'").withColumn("provider", F.lit("late")))
    runs = D.chapters(spark, sf).select(F.explode(F.array(F.lit("all"), F.lit("late"))).alias("provider"), "book_id", F.col("index").alias("chapter_index"), F.lit(True).alias("parse_ok"), *(F.lit(None).cast("double").alias(c) for c in ("seconds", "prompt_tokens", "output_tokens", "prompt_seconds")))
    rows = scorecard.scorecard(runs, both, D.chapters(spark, sf))
    return rows.select("provider", "chapters", "facts", "distinct_entities", "quoted", "near_duplicate_pairs", "cap_hits", F.round("groundedness", 6).alias("groundedness"), F.round("citation_coverage", 6).alias("citation_coverage"))


@query("provider_runs", with_tables("chapters", "SELECT p AS provider, book_id, chapter_index FROM chapters, (SELECT unnest(['x', 'y']) AS p) WHERE chapter_index IN (0, 2)"))
def provider_runs(spark, sf):
    return scorecard.runs_to_make(D.chapters(spark, sf), ["x", "y"], [0, 2])


@query("parsed_responses", r"""SELECT doc_id AS response_id, doc_id % 4 <> 3 AS ok, CASE WHEN doc_id % 4 = 3 THEN -1 WHEN doc_id % 4 = 2 OR length(source || ' ' || n_chars) > 500 THEN 0 ELSE 1 END AS facts FROM documents""")
def parsed_responses(spark, sf):
    """Responses made of documents: a list, a wrapped list, an empty object, and no JSON (-1 facts)."""
    docs = D.table(spark, sf, "documents")
    fact = F.to_json(F.struct(F.col("source").alias("entity_name"), F.lit("Monster").alias("entity_type"), F.lit("status").alias("category"), F.concat_ws(" ", "source", "n_chars").alias("statement"), F.lit("Earlier").alias("when")))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n["), fact, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit('{"facts": ['), fact, F.lit("]}"))).when(kind == 2, "{}").otherwise(F.concat(F.lit("["), fact))
    rows = extraction.parse_responses(docs.select(F.col("doc_id").alias("response_id"), raw.alias("raw")))
    return rows.select("response_id", "ok", F.when(F.col("ok"), F.size("facts")).otherwise(-1).alias("facts"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader at a chapter may know: the visible facts of each entity, counted, with its name and first sighting."""
    rows = reading.with_names(_visible(spark, sf), D.entities(spark, sf))
    return rows.groupBy("entity_id", "name").agg(F.count("*").alias("facts"), F.count_if(F.col("when") == "past").alias("background"), F.min("rank").alias("first"))
