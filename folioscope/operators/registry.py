"""The entity registry and the catalog: findings about them, and the changes that mend them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.joins import connected_components, few
from folioscope.functions.lineage import bound, settle
from folioscope.operators.extraction import minted_id
from folioscope.operators.names import capitalised_runs, lowercase_words, residues
from folioscope.schemas import CONJUNCTIONS, NAMING_PHRASES, TITLES

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def extraction_stats(facts: DataFrame) -> DataFrame:
    """(book_id, fact_count, chapters_extracted); a book never extracted has no row."""
    return facts.groupBy("book_id").agg(F.count("*").alias("fact_count"), (F.max("chapter_index") + 1).alias("chapters_extracted"))


def owners(entities: DataFrame) -> DataFrame:
    """(entity_id, book_id), each once."""
    return entities.select("entity_id", F.explode(F.array_distinct("book_ids")).alias("book_id"))


def fact_counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(entity_id, fact_count): facts in the entity's own books."""
    per = facts.groupBy("entity_id", "book_id").agg(F.count("*").alias("n"))
    return owners(entities).join(per, ["entity_id", "book_id"], "left").groupBy("entity_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fact_count"))


def catalog(index: DataFrame, books: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each book of the index, in its order; orphaned if there is no such book, partial if not yet read to the end."""
    own = owners(entities).groupBy("book_id").agg(F.count("*").alias("entity_count"))
    rows = index.join(books.select("book_id", "content_type", "chapter_count", "volumes", F.lit(True).alias("there")), "book_id", "left")
    rows = rows.join(extraction_stats(facts), "book_id", "left").join(own, "book_id", "left")
    there = F.coalesce("there", F.lit(False))
    seen = lambda c: F.when(there, F.col(c))
    partial = there & F.coalesce(F.col("chapters_extracted") < F.col("chapter_count"), F.lit(False))
    return rows.select(
        "book_id", "title", "author", "series", (~there).alias("orphaned"), F.when(there, F.coalesce("content_type", F.lit("fiction"))).alias("content_type"), seen("chapter_count").alias("chapter_count"),
        seen("fact_count").alias("fact_count"), seen("chapters_extracted").alias("chapters_extracted"), F.when(there, F.coalesce("entity_count", F.lit(0))).otherwise(0).alias("entity_count"), seen("volumes").alias("volumes"), partial.alias("partial"), "ord",
    )


# findings


def orphaned_index_entries(index: DataFrame, books: DataFrame) -> DataFrame:
    return index.join(books.select("book_id"), "book_id", "left_anti").select("book_id", "ord")


def valid_books(index: DataFrame, books: DataFrame) -> DataFrame:
    return index.select("book_id").join(books.select("book_id"), "book_id", "left_semi").distinct()


def stale_references(entities: DataFrame, index: DataFrame, books: DataFrame) -> DataFrame:
    rows = entities.select("entity_id", "ord", F.posexplode("book_ids").alias("k", "book_id"))
    return rows.join(valid_books(index, books), "book_id", "left_anti").select("entity_id", "book_id", "ord", "k")


def orphaned_entities(entities: DataFrame, facts: DataFrame, index: DataFrame, books: DataFrame) -> DataFrame:
    """Entities without a fact in any valid book of theirs."""
    used = facts.select("entity_id", "book_id").distinct().join(valid_books(index, books), "book_id", "left_semi")
    live = owners(entities).join(used, ["entity_id", "book_id"], "left_semi").select("entity_id").distinct()
    return entities.join(live, "entity_id", "left_anti").select("entity_id", "ord")


def unnamed_references(entities: DataFrame, facts: DataFrame, index: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, entity_id) that facts of valid books use and the registry lacks."""
    used = facts.select("book_id", "entity_id").distinct().join(valid_books(index, books), "book_id", "left_semi")
    return used.join(entities.select("entity_id"), "entity_id", "left_anti").select("book_id", "entity_id")


def duplicate_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, members): entities whose canonical names have one match key, whatever their types."""
    rows = entities.withColumn("key", T.match_key("canonical_name")).join(fact_counts(entities, facts), "entity_id")
    member = F.struct("ord", "entity_id", "canonical_name", "type", "book_ids", "fact_count")
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)


def cross_book_entities(entities: DataFrame, facts: DataFrame, index: DataFrame) -> DataFrame:
    """(entity_id, canonical_name, type, facts_per_book): entities of several books that aren't all of one series."""
    series = index.groupBy("book_id").agg(F.min_by(F.col("series.name"), "ord").alias("s"))
    per = facts.groupBy("entity_id", "book_id").agg(F.count("*").alias("n"))
    rows = entities.where(F.size("book_ids") >= 2).select("entity_id", "canonical_name", "type", "ord", F.posexplode("book_ids").alias("k", "book_id"))
    rows = rows.join(series, "book_id", "left").join(per, ["entity_id", "book_id"], "left")
    found = rows.groupBy("entity_id", "canonical_name", "type", "ord").agg(F.count_distinct("s").alias("kinds"), F.count_if(F.col("s").isNull()).alias("none"), F.array_sort(F.collect_list(F.struct("k", "book_id", F.coalesce("n", F.lit(0)).alias("n")))).alias("per"))
    found = found.where(~((F.col("kinds") == 1) & (F.col("none") == 0)))
    return found.select("entity_id", "canonical_name", "type", F.map_from_entries(F.array_distinct(F.transform("per", lambda p: F.struct(p["book_id"], p["n"])))).alias("facts_per_book"), "ord")


# name variants


def without_titles(name: Column) -> Column:
    """The name's words after leading titles and ranks."""
    is_title = lambda t: F.lower(F.regexp_replace(t, r"^\.+|\.+$", "")).isin(*TITLES) | F.regexp_like(F.lower(F.regexp_replace(t, r"^\.+|\.+$", "")), F.lit(r"(?U)^\w{4,}master$"))
    rest = F.aggregate(T.name_tokens(name), F.struct(F.lit(True).alias("leading"), _empty().alias("kept")), lambda s, t: F.when(s["leading"] & is_title(t), s).otherwise(F.struct(F.lit(False).alias("leading"), F.concat(s["kept"], F.array(t)).alias("kept"))))
    return F.array_join(rest["kept"], " ")


def members(entities: DataFrame) -> DataFrame:
    """(book_id, ord, entity_id, name, type): an entity in each of its books."""
    return entities.select("entity_id", "ord", F.col("canonical_name").alias("name"), "type", F.explode(F.array_distinct("book_ids")).alias("book_id"))


REASONS = ("same name with and without a title or rank", "a given name and a fuller form of it", "the book states one name is another's", "a decorated form of a name the book uses far more often on its own")  # fixed values


def title_variants(rows: DataFrame) -> DataFrame:
    """Characters equal but for titles, if there are two spellings: pairs with the first of them."""
    people = rows.where("type = 'character'").withColumn("bare", without_titles(F.col("name"))).where(F.length("bare") >= 3).withColumn("key", T.match_key("bare"))
    groups = people.groupBy("book_id", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "entity_id", T.match_key("name").alias("full")))).alias("g"))
    groups = groups.where(F.size(F.array_distinct(F.transform("g", lambda x: x["full"]))) >= 2)
    pairs = groups.select("book_id", F.col("g")[0]["entity_id"].alias("a"), F.explode(F.slice("g", F.lit(2), F.size("g"))).alias("o"))
    return pairs.select("book_id", "a", F.col("o.entity_id").alias("b"), F.lit(0).alias("rule"))


def fuller_names(rows: DataFrame) -> DataFrame:
    """Characters whose name is part of exactly one longer name of the book; names with conjunctions don't count as longer.

    Each name is met by the runs of words within longer names, so the join is on book and run.
    """
    people = rows.where("type = 'character'").withColumn("tokens", F.transform(T.name_tokens("name"), F.lower))
    short = people.where((F.length(without_titles(F.col("name"))) >= 3) & T.initial_upper("name")).select("book_id", F.col("entity_id").alias("a"), F.array_join("tokens", " ").alias("run"))
    joins = F.exists("tokens", lambda t: F.regexp_replace(t, "^[.,]+|[.,]+$", "").isin(*CONJUNCTIONS))
    n = F.size("tokens")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("tokens", i, k), " "))))
    whole = F.array_join("tokens", " ")
    longer = people.where(~joins & (n >= 2)).select("book_id", F.col("entity_id").alias("b"), F.explode(F.array_distinct(F.filter(runs, lambda r: r != whole))).alias("run"))
    found = short.join(longer, ["book_id", "run"]).where("a <> b").groupBy("book_id", "a").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    return found.where("n = 1").select("book_id", "a", "b", F.lit(1).alias("rule"))


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """(book_id, a, a_name, b, b_name): single-word names of one type of which one begins the other, three letters or more.

    Each name is met by the beginnings of longer ones, so the join is on book, type and beginning.
    """
    single = rows.where(F.size(T.name_tokens("name")) == 1).withColumn("low", F.lower("name"))
    short = single.where(F.length("low") >= 3).select("book_id", "type", F.col("low").alias("start"), F.col("entity_id").alias("a"), F.col("name").alias("a_name"))
    starts = F.transform(F.sequence(F.lit(3), F.length("low") - 1), lambda k: F.left(F.col("low"), k))
    long = single.where(F.length("low") >= 4).select("book_id", "type", F.explode(starts).alias("start"), F.col("entity_id").alias("b"), F.col("name").alias("b_name"))
    return short.join(long, ["book_id", "type", "start"]).where("a <> b").select("book_id", "a", "a_name", "b", "b_name")


def stated_variants(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Prefix pairs that the text itself links: one name, a phrase such as "known as", the other.

    Texts are searched for the phrases alone. A name has no white space within, so what stands around a phrase holds
    it between two bounds of words: the names meet these parts of words, and what meets is held against the pattern.
    """
    naming = "(?:" + "|".join(NAMING_PHRASES) + ")"
    single = rows.where(F.size(T.name_tokens("name")) == 1).select("book_id", "type", "entity_id", "name", _folded(T.strip("name")).alias("part"))
    longest = single.agg(F.max(F.length("name"))).first()[0]
    if longest is None:
        return rows.select("book_id", F.col("entity_id").alias("a"), F.col("entity_id").alias("b"), F.lit(2).alias("rule")).where(F.lit(False))
    low, odd = F.lower("text"), F.lit(False)
    for phrase in NAMING_PHRASES:
        odd = odd | F.contains(low, F.lit(phrase))
    for letter in _FOLDS:  # no small letters of theirs are in the phrases, yet the pattern takes them for such
        odd = odd | F.contains("text", F.lit(letter))
    at = bound(chapters.where(odd).select("book_id", "index", "text"), ["book_id", "index", "text"], F.transform(F.split(F.regexp_replace("text", rf"(?iuU)\b(?={naming}\b)", "\u0001"), "\u0001"), F.length).alias("n"))
    at = at.select("book_id", "index", "text", F.explode(F.transform(F.sequence(F.lit(1), F.size("n")), lambda k: F.aggregate(F.slice("n", 1, k), F.lit(0), lambda total, x: total + x))).alias("pos")).where(F.col("pos") < F.length("text"))
    reach = longest + 60  # beyond the name, the gap and the phrase
    start = F.greatest(F.lit(0), F.col("pos") - reach)
    spots = at.select("book_id", "index", "pos", F.substr("text", start + 1, F.col("pos") - start).alias("left"), F.substr("text", F.col("pos") + 1, F.lit(reach)).alias("right"))
    # texts with \u0001 of their own have spots without a phrase, which find nothing
    spots = settle(spots)

    def parts(side):
        """The runs of a word's parts, as the bounds of words divide it."""
        runs = lambda ps: F.flatten(F.transform(F.sequence(F.lit(1), F.size(ps)), lambda k: F.transform(F.sequence(k, F.size(ps)), lambda e: F.array_join(F.slice(ps, k, e - k + 1), ""))))
        words = spots.select("book_id", "index", "pos", F.explode(T.words(side)).alias("w"))
        words = bound(words, ["book_id", "index", "pos"], F.split("w", r"(?U)\b").alias("ps"))
        found = words.select("book_id", "index", "pos", F.explode(runs(F.col("ps"))).alias("part")).where(F.length("part") <= longest)
        return found.select("book_id", "index", "pos", _folded(F.col("part")).alias("part")).distinct().join(single, ["book_id", "part"]).drop("part")

    x = parts("left").select("book_id", "index", "pos", "type", F.col("entity_id").alias("x"), F.col("name").alias("x_name"))
    y = parts("right").select("book_id", "index", "pos", "type", F.col("entity_id").alias("y"), F.col("name").alias("y_name"))
    begins = lambda a, b: (F.length(F.lower(a)) >= 3) & (F.length(F.lower(b)) > F.length(F.lower(a))) & F.startswith(F.lower(b), F.lower(a))
    forth = begins(F.col("x_name"), F.col("y_name"))
    pairs = x.join(y, ["book_id", "index", "pos", "type"]).where(F.col("x") != F.col("y")).where(forth | begins(F.col("y_name"), F.col("x_name")))
    pairs = pairs.join(spots, ["book_id", "index", "pos"]).withColumn("text", F.concat("left", "right"))
    stated = F.regexp_like("text", F.concat(F.lit(r"(?iuU)\b"), T.quoted("x_name"), F.lit(r"\b[^.!?]{0,40}?\b" + naming + r"\b[^.!?]{0,25}?\b"), T.quoted("y_name"), F.lit(r"\b")))
    return pairs.where(stated).select("book_id", F.when(forth, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(forth, F.col("y")).otherwise(F.col("x")).alias("b"), F.lit(2).alias("rule")).distinct()


#: Letters beyond ASCII that a pattern without regard to case takes for s, k, i and i.
_FOLDS = "\u017f\u212a\u0131\u0130"


def _folded(c: Column) -> Column:
    """One for all spellings of a word that differ in case, though not for them alone."""
    return F.regexp_replace(F.lower(F.translate(c, _FOLDS, "skii")), r"[^\x00-\x7f]", "_")


def residue_variants(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Characters with a decorated form of a name that another character of the book has, judged by the text's counts."""
    people = rows.where("type = 'character'").withColumn("key", T.match_key("name"))
    owner = people.groupBy("book_id", "key").agg(F.min_by("entity_id", "ord").alias("b"))
    people = people.where(F.size(T.words("name")) >= 2)  # no other name can be a decorated form
    used = chapters.join(few(people.select("book_id").distinct()), "book_id", "left_semi")
    found = residues(people.select("book_id", "name"), capitalised_runs(used), lowercase_words(used))
    found = found.select("book_id", "name", T.match_key("residue").alias("key")).join(owner, ["book_id", "key"])
    pairs = people.select("book_id", "name", F.col("entity_id").alias("a")).join(found, ["book_id", "name"]).where("a <> b")
    return pairs.select("book_id", "a", "b", F.lit(3).alias("rule"))


def variant_pairs(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    rows = settle(members(entities))
    return title_variants(rows).union(fuller_names(rows)).union(stated_variants(rows, chapters)).union(residue_variants(rows, chapters))


def components(edges: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope, node, component): the smallest node that a node reaches over edges (scope, a, b); itself where it has only loops."""
    scope = list(scope)
    edges = settle(edges.select(*scope, "a", "b").distinct())
    found = connected_components(edges.select(*scope, F.col("a").alias("u"), F.col("b").alias("v")), scope)
    nodes = edges.select(*scope, F.col("a").alias("node")).union(edges.select(*scope, "b")).distinct()
    return nodes.join(found, [*scope, "node"], "left").select(*scope, "node", F.coalesce("component", "node").alias("component"))


def name_variant_clusters(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, members, reasons): entities of a book that are one person, by any of the four rules; each set once."""
    pairs = settle(variant_pairs(entities, chapters))
    found = components(pairs, ["book_id"])
    rules = pairs.join(found.select("book_id", F.col("node").alias("a"), "component"), ["book_id", "a"]).groupBy("book_id", "component").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    sets = found.groupBy("book_id", "component").agg(F.array_sort(F.collect_list("node")).alias("members")).join(rules, ["book_id", "component"])
    once = sets.groupBy("members").agg(F.min_by(F.struct("book_id", "rules"), "book_id").alias("s"))
    reasons = F.array(*map(F.lit, REASONS))
    return once.select("s.book_id", "members", F.transform("s.rules", lambda r: F.element_at(reasons, r + 1)).alias("reasons"))


def is_name_variant(a: Column, b: Column) -> Column:
    """Single words with one match key, or of which one, three letters or more, begins the other."""
    a, b = F.lower(T.strip(a)), F.lower(T.strip(b))
    single = (a != "") & (b != "") & ~F.contains(a, F.lit(" ")) & ~F.contains(b, F.lit(" "))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return single & ((T.match_key(a) == T.match_key(b)) | ((F.length(short) >= 3) & (a != b) & F.startswith(long, short)))


def name_groups(names: DataFrame) -> DataFrame:
    """(scope, name, component): names (scope, name) grouped by `is_name_variant`, joined on keys and beginnings."""
    rows = settle(names.select("scope", "name", F.lower(T.strip("name")).alias("low")).where((F.col("low") != "") & ~F.contains("low", F.lit(" "))))
    ends = F.array_distinct(F.concat(F.array(F.concat(F.lit("="), T.match_key("low"))), F.when(F.length("low") >= 4, F.transform(F.sequence(F.lit(3), F.length("low") - 1), lambda k: F.concat(F.lit("^"), F.left(F.col("low"), k)))).otherwise(_empty())))
    met = rows.select("scope", "name", F.explode(ends).alias("at"))
    hubs = rows.select("scope", "name", F.concat(F.lit("="), T.match_key("low")).alias("at")).union(rows.where(F.length("low") >= 3).select("scope", "name", F.concat(F.lit("^"), "low")))
    hubs = hubs.groupBy("scope", "at").agg(F.min("name").alias("a"))
    edges = met.join(hubs, ["scope", "at"]).select("scope", "a", F.col("name").alias("b"))
    same = rows.where(F.length("low") >= 3).groupBy("scope", "low").agg(F.min("name").alias("a"), F.collect_set("name").alias("all")).select("scope", "a", F.explode("all").alias("b"))
    found = components(edges.union(same).union(rows.select("scope", "name", "name")), ["scope"])
    return found.withColumnRenamed("node", "name")


# changes


def _kept(entities: DataFrame, facts: DataFrame, ids: list[str], keep: str | None) -> str:
    there = entities.where(F.col("entity_id").isin(*ids))
    if there.count() < 2:
        raise ValueError("a merge needs at least two existing entities")
    if keep is None:
        return there.join(fact_counts(there, facts), "entity_id").orderBy(F.col("fact_count").desc(), F.array_position(T.literals(ids), F.col("entity_id"))).first().entity_id
    if keep not in ids or there.where(F.col("entity_id") == keep).isEmpty():
        raise ValueError(f"{keep!r} must be one of the entities to merge")
    return keep


def merge_entities(entities: DataFrame, facts: DataFrame, ids: list[str], keep: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(entities, facts, kept id): the others' facts, books and names go to the one kept, by default that with most facts."""
    keep = _kept(entities, facts, ids, keep)
    gone = [i for i in ids if i != keep]
    away = entities.where(F.col("entity_id").isin(*gone)).withColumn("at", F.array_position(T.literals(gone), F.col("entity_id")))
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", _empty()))
    more = away.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", names.alias("x")))), lambda s: s["x"])).alias("names"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("book_ids").alias("x")))), lambda s: s["x"])).alias("books")).first()
    fresh = F.filter(T.literals(more.names), lambda n: F.lower(n) != F.lower("canonical_name"))
    mine = F.col("entity_id") == keep
    rows = entities.where(~F.col("entity_id").isin(*gone))
    rows = rows.withColumn("aliases", F.when(mine, F.concat("aliases", F.array_except(F.array_distinct(fresh), "aliases"))).otherwise(F.col("aliases")))
    rows = rows.withColumn("book_ids", F.when(mine, F.array_distinct(F.concat("book_ids", T.literals(more.books)))).otherwise(F.col("book_ids")))
    owned = owners(away)
    moved = facts.join(F.broadcast(owned.withColumn("moves", F.lit(True))), ["entity_id", "book_id"], "left")
    return rows, moved.withColumn("entity_id", F.when(F.col("moves"), keep).otherwise(F.col("entity_id"))).select(*facts.columns), keep


def split_cross_book(entities: DataFrame, facts: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame]:
    """(entities, facts): the entity stays with the book that has most facts of it; the other books get entities of their own.

    Books without facts of it are dropped. With facts in one book or none the entity only loses the others.
    """
    found = entities.where(F.col("entity_id") == entity_id).first()
    if found is None:
        raise ValueError(f"no entity {entity_id!r}")
    counts = {r.book_id: r["count"] for r in facts.where(F.col("entity_id") == entity_id).groupBy("book_id").count().collect()}
    used = [b for b in found.book_ids if counts.get(b)]
    keeper = max(used, key=lambda b: counts[b]) if used else None
    stays = [keeper] if len(used) >= 2 else used or found.book_ids[:1]
    mine = F.col("entity_id") == entity_id
    rows = entities.withColumn("book_ids", F.when(mine, T.literals(stays)).otherwise(F.col("book_ids")))
    others = sorted(b for b in used if b != keeper)
    if not others:
        return rows, facts
    new_id = lambda book: minted_id(F.lit(found.type), F.concat(F.lit(entity_id + "\u0001"), book), F.lit("split"))
    top = entities.agg(F.max("ord")).first()[0]
    fresh = rows.where(mine).select(F.explode(T.literals(others)).alias("book"), "canonical_name", "type", "ord")
    fresh = fresh.select(new_id(F.col("book")).alias("entity_id"), "canonical_name", "type", _empty().alias("aliases"), _empty().alias("epithets"), F.array("book").alias("book_ids"), (F.array_position(T.literals(others), F.col("book")) + top).cast("long").alias("ord"))
    moved = facts.withColumn("entity_id", F.when(mine & F.col("book_id").isin(*others), new_id(F.col("book_id"))).otherwise(F.col("entity_id")))
    return rows.select(*fresh.columns).union(fresh), moved


def prune_book(entities: DataFrame, book_id: str) -> DataFrame:
    """Without the book, and without entities that were in no other."""
    return entities.withColumn("book_ids", F.array_remove("book_ids", book_id)).where(F.size("book_ids") > 0)


def seed_alias_group(entities: DataFrame, book_id: str, names: list[str], epithets: list[str] = (), entity_type: str = "character") -> DataFrame:
    """The registry with one entity for all the names: the first of the book and type that has one of them, else a new one.

    Names that are the canonical one, or an alias already, by match key, add nothing; nor do epithets.
    """
    cleaned = [n.strip() for n in names if n.strip()]
    if len(cleaned) < 2:
        raise ValueError("an alias group needs at least two names")
    keys = F.transform(T.literals(cleaned), T.match_key)
    own = F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", _empty())), T.match_key)
    hit = entities.where((F.col("type") == entity_type) & F.array_contains("book_ids", book_id) & F.arrays_overlap(own, keys)).orderBy("ord").select("entity_id").first()
    if hit is None:
        top = entities.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        one = entities.sparkSession.range(1)
        fresh = one.select(minted_id(F.lit(entity_type), F.lit(book_id), T.match_key(F.lit(cleaned[0]))).alias("entity_id"), F.lit(cleaned[0]).alias("canonical_name"), F.lit(entity_type).alias("type"), _empty().alias("aliases"), _empty().alias("epithets"), F.array(F.lit(book_id)).alias("book_ids"), F.lit(top + 1).cast("long").alias("ord"))
        target, entities = fresh.first().entity_id, entities.select(*fresh.columns).union(fresh)
    else:
        target = hit.entity_id
    mine = F.col("entity_id") == target
    key = T.match_key

    def add(held, fresh, but):
        """held, then those of fresh whose keys neither held nor `but` has."""
        taken = lambda kept: F.transform(F.concat(kept, but), key)
        return F.aggregate(T.literals(fresh), F.coalesce(held, _empty()), lambda kept, n: F.when(F.array_contains(taken(kept), key(n)), kept).otherwise(F.concat(kept, F.array(n))))

    rows = entities.withColumn("aliases", F.when(mine, add(F.col("aliases"), cleaned, F.array("canonical_name"))).otherwise(F.col("aliases")))
    words = [w.strip() for w in epithets if w.strip()]
    return rows.withColumn("epithets", F.when(mine, add(F.col("epithets"), words, F.concat(F.array("canonical_name"), "aliases"))).otherwise(F.col("epithets"))) if words else rows


def declare_group(declared: DataFrame, book_id: str, names: list[str], epithets: list[str] = (), reason: str = "") -> DataFrame:
    """The declared groups with the names: added to the book's first group that shares one, else as a new group."""
    cleaned = [n.strip() for n in names if n.strip()]
    key = T.match_key
    keys = F.transform(T.literals(cleaned), key)
    hit = declared.where((F.col("book_id") == book_id) & F.arrays_overlap(F.transform("names", key), keys)).orderBy("gseq").select("gseq").first()
    if hit is None:
        top = declared.where(F.col("book_id") == book_id).agg(F.coalesce(F.max("gseq"), F.lit(-1))).first()[0]
        fresh = declared.sparkSession.range(1).select(F.lit(book_id).alias("book_id"), F.lit(top + 1).cast("int").alias("gseq"), T.literals(cleaned).alias("names"), T.literals(list(epithets)).alias("epithets"), F.lit(reason).alias("reason"))
        return declared.select(*fresh.columns).union(fresh)
    mine = (F.col("book_id") == book_id) & (F.col("gseq") == hit.gseq)
    add = lambda held, fresh: F.aggregate(T.literals(list(fresh)), held, lambda kept, n: F.when(F.array_contains(F.transform(kept, key), key(n)), kept).otherwise(F.concat(kept, F.array(n))))
    rows = declared.withColumn("names", F.when(mine, add(F.col("names"), cleaned)).otherwise(F.col("names"))).withColumn("epithets", F.when(mine, add(F.col("epithets"), epithets)).otherwise(F.col("epithets")))
    return rows.withColumn("reason", F.when(mine & F.lit(bool(reason)), F.lit(reason)).otherwise(F.col("reason")))


def link_names(entities: DataFrame, facts: DataFrame, declared: DataFrame, book_id: str, names: list[str], epithets: list[str] = (), reason: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, facts, declared): the names are one character of the book, and stay so when it is extracted again.

    Characters of the book that hold one of the names are merged first. Doing it twice changes nothing more.
    """
    cleaned = [n.strip() for n in names if n.strip()]
    if len(cleaned) < 2:
        raise ValueError("a link needs at least two names")
    own = F.transform(F.concat(F.array("canonical_name"), F.coalesce("aliases", _empty())), T.match_key)
    held = entities.where((F.col("type") == "character") & F.array_contains("book_ids", book_id) & F.arrays_overlap(own, F.transform(T.literals(cleaned), T.match_key)))
    ids = [r.entity_id for r in held.orderBy("ord").select("entity_id").collect()]
    if len(ids) > 1:
        entities, facts, _ = merge_entities(entities, facts, ids)
    return seed_alias_group(entities, book_id, cleaned, epithets), facts, declare_group(declared, book_id, cleaned, epithets, reason)


def unlink_names(entities: DataFrame, declared: DataFrame, book_id: str) -> tuple[DataFrame, DataFrame]:
    """(entities, declared): the book's declared names leave its entities; facts stay where they are."""
    names = declared.where(F.col("book_id") == book_id).select(F.explode(F.concat("names", F.coalesce("epithets", _empty()))).alias("n")).select(T.match_key("n").alias("k")).distinct()
    keys = T.literals([r.k for r in names.collect()])
    here = F.array_contains("book_ids", book_id)
    keep = lambda c: F.when(here, F.filter(F.coalesce(c, _empty()), lambda n: ~F.array_contains(keys, T.match_key(n)))).otherwise(F.col(c))
    return entities.withColumn("aliases", keep("aliases")).withColumn("epithets", keep("epithets")), declared.where(F.col("book_id") != book_id)


def mend(index: DataFrame, books: DataFrame, entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, entities) after the safe repairs: orphaned index entries, orphaned entities and stale references go."""
    valid = valid_books(index, books)
    live = entities.join(orphaned_entities(entities, facts, index, books).select("entity_id"), "entity_id", "left_anti")
    held = live.select("entity_id", F.posexplode("book_ids").alias("k", "book_id")).join(valid, "book_id", "left_semi").groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "book_id"))), lambda x: x["book_id"]).alias("held"))
    live = live.join(held, "entity_id", "left").withColumn("book_ids", F.coalesce("held", _empty())).select(*entities.columns)
    return index.join(valid, "book_id", "left_semi").select(*index.columns), live


def upsert_index(index: DataFrame, books: DataFrame) -> DataFrame:
    """The index with these books at its end, in place of entries of the same id."""
    fresh = books.select("book_id", "title", "author", "series")
    top = index.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    place = F.row_number().over(Window.orderBy("book_id")).cast("long") + top
    return index.join(fresh.select("book_id"), "book_id", "left_anti").select("book_id", "title", "author", "series", "ord").union(fresh.withColumn("ord", place))


def remove_book(book_id: str, index: DataFrame, books: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, books, entities) without the book; an error if neither index nor books have it."""
    if index.where(F.col("book_id") == book_id).isEmpty() and books.where(F.col("book_id") == book_id).isEmpty():
        raise ValueError(f"no such book in the library: {book_id!r}")
    return index.where(F.col("book_id") != book_id), books.where(F.col("book_id") != book_id), prune_book(entities, book_id)
