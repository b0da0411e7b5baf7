"""Findings about the registry and the changes that mend them."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import registry
from folioscope.schemas import BOOKS, CHAPTERS, DECLARED, ENTITIES, FACTS, INDEX


def entities_of(spark, *rows):
    return spark.createDataFrame([(i, n, t, list(a), list(e), list(b), k) for k, (i, n, t, a, e, b) in enumerate(rows)], ENTITIES)


def facts_of(spark, *rows):
    return spark.createDataFrame([(b, k, e, "N", c, "status", "s", "present", None) for k, (b, e, c) in enumerate(rows)], FACTS)


def index_of(spark, **books):
    return spark.createDataFrame([(b, b.upper(), None, s, k) for k, (b, s) in enumerate(books.items())], INDEX)


def books_of(spark, *ids):
    return spark.createDataFrame([(b, b, None, "fiction", "epub", "f", "now", 3, None, None) for b in ids], BOOKS)


@pytest.fixture(scope="module")
def library(spark):
    entities = entities_of(spark, ("a", "Ann", "character", ["Annie"], [], ["x", "y"]), ("b", "Anns", "theme", [], [], ["x"]), ("c", "Cy", "character", [], [], ["gone", "x"]), ("d", "Dee", "character", [], [], ["gone"]), ("e", "Eve", "character", [], ["Wolf"], ["y"]))
    facts = facts_of(spark, ("x", "a", 0), ("y", "a", 1), ("y", "a", 2), ("x", "c", 0), ("x", "lost", 1), ("x", "e", 0), ("gone", "d", 0))
    return index_of(spark, x=("S", 1), gone=("S", 2), y=None), books_of(spark, "x", "y"), entities, facts


def test_findings(spark, library):
    index, books, entities, facts = library
    assert [r.book_id for r in registry.orphaned_index_entries(index, books).collect()] == ["gone"]
    assert sorted((r.entity_id, r.book_id) for r in registry.stale_references(entities, index, books).collect()) == [("c", "gone"), ("d", "gone")]
    assert sorted(r.entity_id for r in registry.orphaned_entities(entities, facts, index, books).collect()) == ["b", "d", "e"]
    assert [tuple(r) for r in registry.unnamed_references(entities, facts, index, books).collect()] == [("x", "lost")]
    (d,) = registry.duplicate_entities(entities, facts).collect()
    assert [(m.entity_id, m.fact_count) for m in d.members] == [("a", 3), ("b", 0)]
    assert {r.entity_id: r.facts_per_book for r in registry.cross_book_entities(entities, facts, index).collect()} == {"a": {"x": 1, "y": 2}}
    rows = {r.book_id: r for r in registry.catalog(index, books, facts, entities).collect()}
    assert (rows["x"].fact_count, rows["x"].chapters_extracted, rows["x"].entity_count, rows["x"].partial) == (4, 2, 3, True)
    assert rows["gone"].orphaned and rows["gone"].fact_count is None and not rows["y"].partial
    new_index, new_entities = registry.mend(index, books, entities, facts)
    assert {r.book_id for r in new_index.collect()} == {"x", "y"}
    assert {r.entity_id: r.book_ids for r in new_entities.collect()} == {"a": ["x", "y"], "c": ["x"]}


def variants(spark, *named, text="nothing", kind="character"):
    entities = entities_of(spark, *((f"e{k}", n, kind, [], [], ["b"]) for k, n in enumerate(named)))
    chapters = spark.createDataFrame([("b", 0, None, text, None)], CHAPTERS)
    return [(sorted(named[int(m[1:])] for m in r.members), [registry.REASONS.index(x) for x in r.reasons]) for r in registry.name_variant_clusters(entities, chapters).collect()]


@pytest.mark.parametrize(
    ("named", "text", "wanted"),
    [
        (["Baron Arald", "Arald"], "", [(["Arald", "Baron Arald"], [0, 1])]),
        (["Sir Rodney", "Battlemaster Rodney"], "", [(["Battlemaster Rodney", "Sir Rodney"], [0])]),
        (["Ranger Halt", "Ranger Will"], "", []),
        (["George", "George Carter"], "", [(["George", "George Carter"], [1])]),
        (["George", "George Carter", "George Smith"], "", []),
        (["Will", "Will and Evanlyn"], "", []),
        (["will", "Will Treaty"], "", []),
        (["Jen", "Jenny"], "Jenny, who was called Jen by all.", [(["Jen", "Jenny"], [2])]),
        (["Jen", "Jenny"], "Jenny came. They called. Jen left.", []),
        (["Jennifer Best", "Best"], "", [(["Best", "Jennifer Best"], [1])]),
        (["Oldest Erak", "Erak"], "so Erak went. " * 120 + "then Oldest Erak came. " * 12, [(["Erak", "Oldest Erak"], [1, 3])]),
    ],
)
def test_name_variants(spark, named, text, wanted):
    assert variants(spark, *named, text=text) == wanted


def test_concepts_are_no_persons(spark):
    assert variants(spark, "Baron Arald", "Arald", kind="theme") == []


def test_merge(spark, library):
    _, _, entities, facts = library
    rows, moved, kept = registry.merge_entities(entities, facts, ["b", "a", "c"])
    found = {r.entity_id: r for r in rows.collect()}
    assert kept == "a" and set(found) == {"a", "d", "e"}
    assert found["a"].aliases == ["Annie", "Anns", "Cy"] and found["a"].book_ids == ["x", "y", "gone"]
    assert sum(r.entity_id == "a" for r in moved.collect()) == 4 and moved.count() == facts.count()
    assert registry.merge_entities(entities, facts, ["b", "a"], keep="b")[2] == "b"
    with pytest.raises(ValueError):
        registry.merge_entities(entities, facts, ["a", "none"])
    with pytest.raises(ValueError):
        registry.merge_entities(entities, facts, ["a", "b"], keep="c")


def test_split(spark, library):
    _, _, entities, facts = library
    rows, moved = registry.split_cross_book(entities, facts, "a")
    found = {r.entity_id: r for r in rows.collect()}
    (new,) = set(found) - {"a", "b", "c", "d", "e"}
    assert found["a"].book_ids == ["y"] and found[new].book_ids == ["x"] and found[new].aliases == [] and new.startswith("character-")
    assert sorted((r.book_id, r.entity_id) for r in moved.collect() if r.entity_id in ("a", new)) == sorted([("y", "a"), ("y", "a"), ("x", new)])
    trimmed, same = registry.split_cross_book(entities, facts, "c")
    assert {r.entity_id: r.book_ids for r in trimmed.collect()}["c"] == ["x"] and same.count() == facts.count()
    with pytest.raises(ValueError):
        registry.split_cross_book(entities, facts, "none")


def test_links(spark, library):
    _, _, entities, facts = library
    declared = spark.createDataFrame([], DECLARED)
    state = registry.link_names(entities, facts, declared, "x", ["Ann", "Cy", " Nan "], ["Wolf", "Ann"], "told")
    for _ in range(2):  # again changes nothing
        rows, moved, groups = state
        found = {r.entity_id: r for r in rows.collect()}
        assert set(found) == {"a", "b", "d", "e"} and found["a"].aliases == ["Annie", "Cy", "Nan"] and found["a"].epithets == ["Wolf"]
        (g,) = groups.collect()
        assert (g.names, g.epithets, g.reason) == (["Ann", "Cy", "Nan"], ["Wolf", "Ann"], "told")
        state = registry.link_names(rows, moved, groups, "x", ["Cy", "Nan"])
    rows, groups = registry.unlink_names(state[0], state[2], "x")
    found = {r.entity_id: r for r in rows.collect()}
    assert found["a"].aliases == ["Annie"] and found["a"].epithets == [] and found["e"].epithets == ["Wolf"] and groups.isEmpty()
    fresh = registry.seed_alias_group(entities, "y", ["Zed", "Zeds", "Z"])
    new = fresh.where("canonical_name = 'Zed'").first()
    assert new.aliases == ["Z"] and new.book_ids == ["y"] and new.ord == 5
    with pytest.raises(ValueError):
        registry.seed_alias_group(entities, "y", ["Zed", " "])


def test_removal_and_index(spark, library):
    index, books, entities, _ = library
    _, _, rest = registry.remove_book("gone", index, books, entities)
    assert {r.entity_id: r.book_ids for r in rest.collect()} == {"a": ["x", "y"], "b": ["x"], "c": ["x"], "e": ["y"]}
    with pytest.raises(ValueError):
        registry.remove_book("never", index, books, entities)
    again = registry.upsert_index(index, books.where("book_id = 'x'").withColumn("title", F.lit("New")))
    assert [(r.book_id, r.title) for r in again.orderBy("ord").collect()] == [("gone", "GONE"), ("y", "Y"), ("x", "New")]


def test_groups_of_variants(spark):
    names = ["Will", "Wills", "Willie", "Halt", "Hal", "Ha", "Old Will", "HAL", ""]
    rows = spark.createDataFrame([("s", n) for n in names] + [("t", "Will")], "scope string, name string")
    groups = {}
    for r in registry.name_groups(rows).collect():
        groups.setdefault((r.scope, r.component), set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == [["HAL", "Hal", "Halt"], ["Ha"], ["Will"], ["Will", "Willie", "Wills"]]
    pairs = spark.createDataFrame([("Will", "Wills"), ("Wi", "Will"), ("Hal", "Halt"), ("Old Will", "Will"), ("", "x"), ("Ann", "ann")], "a string, b string")
    assert [r.v for r in pairs.select(registry.is_name_variant(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True, False, False, True]
