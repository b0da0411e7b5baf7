"""From chapters to facts: extract, validate, drop repeats, ground, resolve to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.joins import few
from folioscope.functions.lineage import bound
from folioscope.schemas import CATEGORIES, ENTITY_TYPE_ALIASES, ENTITY_TYPES, FAKE_STOPWORDS, LIST_KEYS, MAX_STATEMENT, MAX_TIME_PHRASE, NAME_CONNECTORS, PROPER_NOUN_TYPES, SUSPICIOUS, WHEN, WHEN_ALIASES

#: A capital with small letters after it, as a whole word. The capital is looked for first, then whether a word starts there.
_CAPITALISED = r"(?U)([A-Z](?<=\b[A-Z])[a-z]+)\b"


def fake_extract(chapters: DataFrame) -> DataFrame:
    """The deterministic extractor: each capitalised word new to its chapter, with the sentence it is in.

    (book_id, chapter_index, seq, entity_name, entity_type, category, statement, when, time_phrase)
    A chapter's own row tells all: nothing is shuffled or sorted but the names within it.
    """
    key = ["book_id", "chapter_index"]
    rows = bound(chapters.select("book_id", F.col("index").alias("chapter_index"), "text"), key, T.fact_sentences("text").alias("sentences"))
    found = F.flatten(F.transform("sentences", lambda sentence, s: F.transform(F.regexp_extract_all(sentence, F.lit(_CAPITALISED), 1), lambda name, t: F.struct(name.alias("name"), s.alias("s"), t.alias("t")))))
    rows = bound(rows, [*key, "sentences"], F.sort_array(F.filter(found, lambda x: ~x["name"].isin(*FAKE_STOPWORDS))).alias("found"))
    first = F.filter("found", lambda x, k: (k == 0) | (x["name"] != F.get("found", k - 1)["name"]))
    placed = F.sort_array(F.transform(first, lambda x: F.struct(x["s"].alias("s"), x["t"].alias("t"), x["name"].alias("name"))))
    rows = rows.select(*key, F.posexplode(F.transform(placed, lambda x: F.struct(x["name"].alias("name"), F.get("sentences", x["s"]).alias("sentence")))).alias("k", "x"))
    return rows.select(*key, (F.col("k") + 1).cast("long").alias("seq"), F.col("x.name").alias("entity_name"), F.lit("character").alias("entity_type"), F.lit("development").alias("category"), T.strip("x.sentence").alias("statement"), F.lit("present").alias("when"), F.lit(None).cast("string").alias("time_phrase"))


def _in(value: Column, allowed) -> Column:
    return value.isin(*allowed) if allowed else F.lit(False)


def normal_when(value: Column) -> Column:
    low = F.lower(T.strip(value))
    aliases = F.create_map(*(F.lit(x) for pair in WHEN_ALIASES.items() for x in pair))
    return F.when(_in(low, WHEN), low).otherwise(F.coalesce(F.try_element_at(aliases, low), F.lit("present")))


def normal_time_phrase(value: Column) -> Column:
    bare = T.strip(value)
    return F.when(bare != "", F.left(bare, F.lit(MAX_TIME_PHRASE)))


def normal_category(value: Column, content_type: str = "fiction") -> Column:
    low = F.lower(T.strip(value))
    return F.when(_in(low, CATEGORIES[content_type]), low).otherwise("description")


def normal_entity_type(value: Column, content_type: str = "fiction") -> Column:
    """Null where the type is unknown, which fails the response."""
    low = F.lower(T.strip(value))
    found = F.when(_in(low, ENTITY_TYPES[content_type]), low)
    for alias, kind in ENTITY_TYPE_ALIASES[content_type].items():
        found = found.when(low == alias, kind)
    return found


def parse_responses(responses: DataFrame, content_type: str = "fiction", raw: str = "raw") -> DataFrame:
    """(response_id, ok, facts): what each extractor response says.

    Code fences go; an object may wrap the list or be a single fact, an empty one is no facts. What isn't
    JSON, no list of objects with the four required texts, or names an unknown entity type fails as a whole.
    A statement over 500 characters, or one that repeats field names, is left out by itself, before its
    entity type is looked at. A statement that is no text fails the response too.
    """
    bare = T.strip(raw)
    unfenced = F.regexp_replace(bare, "^`+|`+$", "")
    unfenced = T.strip(F.when(F.startswith(unfenced, F.lit("json")), F.substr(unfenced, F.lit(5))).otherwise(unfenced))
    rows = responses.select("response_id", F.when(F.startswith(bare, F.lit("```")), unfenced).otherwise(bare).alias("json"))
    rows = bound(rows, ["response_id"], F.try_parse_json("json").alias("v"))
    rows = rows.withColumn("kind", F.schema_of_variant("v"))
    is_list = lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY<"))
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    unwrapped = F.coalesce(*(F.when(is_list(F.try_variant_get("v", f"$.{k}", "variant")), items(F.try_variant_get("v", f"$.{k}", "variant"))) for k in LIST_KEYS))
    empty = F.array().cast("array<variant>")
    listed = F.when(is_list(F.col("v")), items(F.col("v"))).when(F.col("kind") == "OBJECT<>", empty).when(F.startswith("kind", F.lit("OBJECT<")), F.coalesce(unwrapped, F.array("v")))
    rows = rows.select("response_id", listed.alias("items"))
    parts = rows.select("response_id", F.posexplode("items").alias("seq", "x"))
    get = lambda name: F.try_variant_get("x", f"$.{name}", "string")
    text = F.schema_of_variant(F.try_variant_get("x", "$.statement", "variant")) == "STRING"
    required = F.lit(True)
    for name in ("entity_name", "entity_type", "category", "statement"):
        required = required & F.try_variant_get("x", f"$.{name}", "variant").isNotNull()
    fields = ("entity_name", "entity_type", "category", "statement", "when", "time_phrase")
    parts = bound(parts.select("response_id", "seq", "x"), ["response_id", "seq"], F.coalesce(required & text, F.lit(False)).alias("whole"), *(get(name).alias(name) for name in fields))
    dropped = F.length("statement") > MAX_STATEMENT
    for word in SUSPICIOUS:
        dropped = dropped | F.contains("statement", F.lit(word))
    kind, when = normal_entity_type(F.col("entity_type"), content_type), F.when(F.col("when").isNull(), "present").otherwise(normal_when(F.col("when")))
    normal = (kind.alias("entity_type"), normal_category(F.col("category"), content_type).alias("category"), when.alias("when"), normal_time_phrase(F.col("time_phrase")).alias("time_phrase"))
    parts = bound(parts, ["response_id", "seq"], "whole", (F.col("whole") & dropped).alias("dropped"), "entity_name", "statement", *normal)
    parts = parts.withColumn("bad", ~F.col("whole") | (~F.col("dropped") & F.col("entity_type").isNull()))
    fact = F.struct("seq", "entity_name", "entity_type", "category", "statement", "when", "time_phrase")
    found = parts.groupBy("response_id").agg(F.bool_or("bad").alias("bad"), F.array_sort(F.collect_list(F.when(~F.col("bad") & ~F.col("dropped"), fact))).alias("facts"))
    rows = rows.join(found, "response_id", "left")
    ok = F.col("items").isNotNull() & ~F.coalesce("bad", F.lit(False))
    return rows.select("response_id", ok.alias("ok"), F.when(ok, F.coalesce("facts", F.array().cast(found.schema["facts"].dataType))).alias("facts"))


def drop_repeats(facts: DataFrame) -> DataFrame:
    """Adds repeated: facts of a chapter whose name and statement, but for case and outer white space, came before."""
    same = Window.partitionBy("book_id", "chapter_index", F.lower(T.strip("entity_name")), F.lower(T.strip("statement"))).orderBy("seq")
    return facts.withColumn("repeated", F.row_number().over(same) > 1)


def is_proper_noun(name: Column) -> Column:
    """Words in capitals, but for connectors such as "of"; the first in capitals in any case."""
    parts = F.filter(F.split(name, r"(?U)[\s\-']+"), lambda t: F.regexp_like(t, F.lit(r"^\p{L}")))
    upper = lambda t: F.regexp_like(t, F.lit(r"^[\p{Lu}\p{Lt}]"))
    return (F.size(parts) > 0) & F.coalesce(upper(F.try_element_at(parts, F.lit(1))), F.lit(False)) & F.forall(parts, lambda t: upper(t) | F.lower(t).isin(*NAME_CONNECTORS))


def is_grounded(name: Column, entity_type: Column, text: Column) -> Column:
    """Whether the chapter has the name as words, in singular or plural; proper nouns with their capitals."""
    bare = T.strip(name)
    low = F.lower(bare)
    stem = F.when((F.length(bare) > 3) & F.endswith(low, F.lit("es")), F.left(bare, F.length(bare) - 2)).when((F.length(bare) > 2) & F.endswith(low, F.lit("s")), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    wordy = lambda c: F.regexp_like(c, F.lit(r"^[\p{L}\p{N}_]$"))
    first, rest = F.left(stem, F.lit(1)), F.substr(stem, F.lit(2))
    right = F.when(wordy(F.right(stem, F.lit(1))), r"\b").otherwise("")
    exact = entity_type.isin(*PROPER_NOUN_TYPES) & is_proper_noun(bare)
    # the first letter is looked for before the boundary at it, which is dear
    start = F.when(wordy(first), F.concat(T.quoted(first), F.lit(r"(?<=\b"), T.quoted(first), F.lit(")"))).otherwise(T.quoted(first))
    pattern = F.concat(F.when(exact, "(?U)").otherwise("(?iuU)"), start, T.quoted(rest), F.lit("(?:e?s)?"), right)
    # with its capitals the stem must be in the text as it is
    return (bare != "") & (~exact | F.contains(text, stem)) & F.regexp_like(text, pattern)


def ground(facts: DataFrame, chapters: DataFrame, known: DataFrame) -> DataFrame:
    """Adds grounded and accepted. known: (book_id, entity_name) that a book starts with.

    A name that isn't known must be found in its chapter. Once it is, the same spelling is known from there
    on, in the book's order, wherever the extractor puts it. Repeated facts take no part.
    """
    rows = facts.join(chapters.select("book_id", F.col("index").alias("chapter_index"), "text"), ["book_id", "chapter_index"])
    rows = rows.withColumn("grounded", is_grounded(F.col("entity_name"), F.col("entity_type"), F.col("text"))).drop("text")
    rows = rows.join(known.select("book_id", "entity_name", F.lit(True).alias("known")).distinct(), ["book_id", "entity_name"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    sofar = Window.partitionBy("book_id", "entity_name").orderBy("chapter_index", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("accepted", F.col("known") | F.max("grounded").over(sofar))


def entity_keys(entities: DataFrame) -> DataFrame:
    """(type, key, entity_id, book_ids, ord): all names that resolve to an entity, epithets too."""
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", empty), F.coalesce("epithets", empty))
    return entities.select("type", F.explode(F.array_distinct(F.transform(names, T.match_key))).alias("key"), "entity_id", "book_ids", "ord")


def minted_id(entity_type: Column, scope: Column, key: Column) -> Column:
    """A stable id for a new entity: its type and 16 hex digits, so that a billion collide with a chance of 3 %."""
    return F.concat(entity_type, F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0001", scope, entity_type, key), 256), 1, 16))


def resolve(facts: DataFrame, entities: DataFrame, scopes: DataFrame) -> DataFrame:
    """Adds entity_id and is_new: the first entity of the registry that has the name, type and a book in scope.

    scopes: (book_id, scope array of the book ids that the book may share entities with, scope_id). Names
    compare by match key. What finds none is minted once for its scope, type and key.
    """
    rows = facts.withColumn("key", T.match_key("entity_name")).join(few(scopes), "book_id")
    wanted = rows.select("book_id", "entity_type", "key", "scope").distinct()
    keys = entity_keys(entities)
    found = wanted.join(keys, (wanted["entity_type"] == keys["type"]) & (wanted["key"] == keys["key"]) & F.arrays_overlap("scope", "book_ids")).select(wanted["book_id"], wanted["entity_type"], wanted["key"], "entity_id", "ord")
    found = found.groupBy("book_id", "entity_type", "key").agg(F.min_by("entity_id", "ord").alias("entity_id"))
    rows = rows.join(found, ["book_id", "entity_type", "key"], "left").withColumn("is_new", F.col("entity_id").isNull())
    return rows.withColumn("entity_id", F.coalesce("entity_id", minted_id(F.col("entity_type"), F.col("scope_id"), F.col("key")))).drop("scope")


def registry_after(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """The registry with the new entities, named as they first were, and the books that joined old ones."""
    first = resolved.where("is_new").groupBy("entity_id").agg(F.min_by(F.struct(T.strip("entity_name").alias("canonical_name"), F.col("entity_type").alias("type")), F.struct("book_id", "chapter_index", "seq")).alias("f"), F.array_sort(F.collect_set("book_id")).alias("book_ids"), F.min(F.struct("book_id", "chapter_index", "seq")).alias("at"))
    top = entities.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")).first().top
    place = F.row_number().over(Window.orderBy("at")).cast("long")
    none = F.array().cast("array<string>")
    new = first.select("entity_id", "f.canonical_name", "f.type", none.alias("aliases"), none.alias("epithets"), "book_ids", (place + top).alias("ord"))
    joined = resolved.where("not is_new").groupBy("entity_id").agg(F.array_sort(F.collect_set("book_id")).alias("more"))
    old = entities.join(joined, "entity_id", "left").withColumn("book_ids", F.array_distinct(F.concat("book_ids", F.coalesce("more", none)))).drop("more")
    return old.select(*new.columns).union(new)


def run_counters(facts: DataFrame, chapters: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """(book_id, chapters, skipped, facts, repeated, ungrounded, parse_failures) of a run; facts: with repeated and accepted."""
    rows = facts.groupBy("book_id").agg(F.count_if("accepted").alias("facts"), F.count_if("repeated").alias("repeated"), F.count_if(~F.col("accepted") & ~F.col("repeated")).alias("ungrounded"))
    totals = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if(T.word_count("text") < 20).alias("skipped"))
    rows = totals.join(rows, "book_id", "left").na.fill(0)
    if responses is None:
        return rows.withColumn("parse_failures", F.lit(0).cast("long"))
    return rows.join(responses.groupBy("book_id").agg(F.count_if(~F.col("ok")).alias("parse_failures")), "book_id", "left").na.fill(0)


def known_names(entities: DataFrame, order: DataFrame) -> DataFrame:
    """(book_id, entity_name, entity_type): canonical names of entities in a book's reading order, the last type of equals."""
    rows = entities.select("canonical_name", "type", "ord", F.explode("book_ids").alias("read_id")).join(order, "read_id")
    return rows.groupBy("book_id", F.col("canonical_name").alias("entity_name")).agg(F.max_by("type", "ord").alias("entity_type"))


def resume_index(checkpoints: DataFrame, chapters: DataFrame, restart: bool = False) -> DataFrame:
    """(book_id, start, provider): where a run goes on. Anew on restart, without a checkpoint, or if the book's chapters changed in number."""
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    rows = counts.join(checkpoints, "book_id", "left")
    start = F.when(F.lit(restart) | ~F.col("chapter_count").eqNullSafe(F.col("n")), 0).otherwise(F.greatest(F.lit(0), F.least("n", F.coalesce("next_chapter_index", F.lit(0)))))
    return rows.select("book_id", start.cast("int").alias("start"), F.nullif("provider", F.lit("")).alias("provider"))


class ResumeMismatch(Exception):
    """A run would append one extractor's facts to another's."""

    def __init__(self, recorded: str, current: str, next_chapter_index: int) -> None:
        super().__init__(f"facts up to chapter {next_chapter_index} were extracted with {recorded}, this run uses {current}; use {recorded} or restart")
        self.recorded, self.current, self.next_chapter_index = recorded, current, next_chapter_index


def check_resume(recorded: str | None, current: str | None, start: int) -> None:
    if start > 0 and recorded and current and recorded != current:
        raise ResumeMismatch(recorded, current, start)
