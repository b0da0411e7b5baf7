import json
import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import extraction
from folioscope.operators.providers import FakeProvider, extract, get_provider, optional, response_schema
from folioscope.schemas import CHAPTERS, CHECKPOINTS, ENTITIES

GOOD = {"entity_name": "Ann", "entity_type": "Monster ", "category": "Status", "statement": "Ann is here", "when": "Earlier", "time_phrase": "  " + "y" * 90}


def fact(**changes):
    found = GOOD | changes
    return {k: v for k, v in found.items() if v is not ...}


RESPONSES = {
    "list": (json.dumps([GOOD]), True, 1),
    "fenced": ("```json\n" + json.dumps([GOOD]) + "\n```", True, 1),
    "wrapped": (json.dumps({"facts": [GOOD, GOOD]}), True, 2),
    "results": (json.dumps({"facts": 3, "results": [GOOD]}), True, 1),
    "single": (json.dumps(GOOD), True, 1),
    "empty object": ("{}", True, 0),
    "empty list": ("[]", True, 0),
    "garbage": ("no json", False, None),
    "empty": ("", False, None),
    "number": ("3", False, None),
    "curly quotes": ("[{“entity_name”: 1}]", False, None),
    "missing key": (json.dumps([GOOD, fact(statement=...)]), False, None),
    "not an object": (json.dumps([GOOD, "x"]), False, None),
    "bad type": (json.dumps([fact(entity_type="spaceship")]), False, None),
    "long": (json.dumps([GOOD, fact(statement="z" * 501)]), True, 1),
    "long and bad type": (json.dumps([fact(statement="z" * 501, entity_type="spaceship")]), True, 0),
    "suspicious": (json.dumps([fact(statement="the entity_name is")]), True, 0),
    "number as statement": (json.dumps([fact(statement=5)]), False, None),
    "unknown category": (json.dumps([fact(category="mood", when="someday", time_phrase=" ")]), True, 1),
}


def test_responses(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in RESPONSES.items()], "response_id string, raw string")
    found = {r.response_id: r for r in extraction.parse_responses(rows).collect()}
    assert {k: (found[k].ok, None if found[k].facts is None else len(found[k].facts)) for k in RESPONSES} == {k: v[1:] for k, v in RESPONSES.items()}
    f = found["list"].facts[0]
    assert (f.entity_type, f.category, f.when, f.time_phrase) == ("character", "status", "past", "y" * 80)
    f = found["unknown category"].facts[0]
    assert (f.category, f.when, f.time_phrase) == ("description", "present", None)
    assert not extraction.parse_responses(rows.where("response_id = 'list'"), "nonfiction").first().ok


GROUNDED = [
    ("Wolf", "character", "The wolf howls", False),
    ("Wolf", "character", "The Wolf howls", True),
    ("Wolves", "character", "a Wolv", True),
    ("wolf", "character", "The Wolf howls", True),
    ("Honour", "theme", "on honours and", True),
    ("Art", "character", "the start", False),
    ("C.J.", "character", "so C.J. said", True),
    ("Duke of York", "character", "the Duke of York came", True),
    ("Duke Of York", "character", "the Duke of York came", False),
    ("É", "setting", "in É today", True),
    (" ", "character", "anything", False),
    ("caf", "theme", "the café", False),
    ("as", "theme", "was", False),
    ("a\\Eb", "theme", "an a\\Eb", True),
]


def loop_grounded(name, kind, text):
    name = name.strip()
    if not name:
        return False
    stem = name[:-2] if len(name) > 3 and name.lower().endswith("es") else name[:-1] if len(name) > 2 and name.lower().endswith("s") else name
    tokens = [t for t in re.split(r"[\s\-']+", name) if t and t[0].isalpha()]
    small = {"of", "the", "a", "an", "and", "de", "du", "di", "la", "le", "van", "von"}
    proper = bool(tokens) and tokens[0][0].isupper() and all(t[0].isupper() or t.lower() in small for t in tokens)
    wordy = lambda c: c.isalnum() or c == "_"
    pattern = (r"\b" if wordy(name[0]) else "") + re.escape(stem) + "(?:e?s)?" + (r"\b" if wordy(stem[-1]) else "")
    return re.search(pattern, text, 0 if kind in ("character", "setting") and proper else re.I) is not None


def test_grounding(spark):
    rows = spark.createDataFrame([(k, *g[:3]) for k, g in enumerate(GROUNDED)], "k int, n string, t string, x string")
    found = [r.g for r in rows.select("k", extraction.is_grounded(F.col("n"), F.col("t"), F.col("x")).alias("g")).orderBy("k").collect()]
    assert found == [loop_grounded(*g[:3]) for g in GROUNDED] == [g[3] for g in GROUNDED]


def test_accepted_and_resolved_as_in_a_sequential_run(spark):
    """The running maximum and the joins give what a loop over the facts in order gives."""
    import random

    rng = random.Random(11)
    names = ["Ann", "Anns", "the Ann", "Bob", "bob", "Cy", "Old Bob", "Dee"]
    chapters, facts = [], []
    for k in range(12):
        chapters.append(("b", k, None, " ".join(rng.sample(["Ann", "Bob", "Cy", "Dee", "x", "y"], 3)), None))
        for s in range(rng.randint(0, 6)):
            facts.append(("b", k, s, rng.choice(names), "character", "status", f"s{rng.randint(0, 3)}"))
    registry = [("e1", "Bob", "character", ["Robert"], ["Old Bob"], ["b"], 0), ("e2", "Cy", "setting", [], [], ["b"], 1), ("e3", "Dee", "character", [], [], ["other"], 2)]
    key = lambda n: (lambda k: k[:-1] if k.endswith("s") and len(k) > 1 else k)(n.lower().removeprefix("the "))
    known, expected, minted, seen = {"Bob", "Cy"}, [], {}, set()
    for book, k, s, name, kind, _, statement in facts:
        if (k, name.lower(), statement) in seen:
            continue
        seen.add((k, name.lower(), statement))
        if name not in known and not loop_grounded(name, kind, chapters[k][3]):
            continue
        known.add(name)
        entity = next((e for e, c, t, al, ep, bs, _ in registry if t == kind and "b" in bs and key(name) in map(key, [c, *al, *ep])), None)
        expected.append((k, s, entity or minted.setdefault(key(name), f"new-{key(name)}")))
    rows = spark.createDataFrame(facts, "book_id string, chapter_index int, seq long, entity_name string, entity_type string, category string, statement string")
    table = spark.createDataFrame(chapters, CHAPTERS)
    marked = extraction.drop_repeats(rows).where("not repeated")
    entities = spark.createDataFrame(registry, ENTITIES)
    order = spark.createDataFrame([("b", "b", 1)], "book_id string, read_id string, book_rank int")
    accepted = extraction.ground(marked, table, extraction.known_names(entities, order)).where("accepted")
    scope = spark.createDataFrame([("b", ["b"], "b")], "book_id string, scope array<string>, scope_id string")
    found = extraction.resolve(accepted, entities, scope).orderBy("chapter_index", "seq").collect()
    assert [(r.chapter_index, r.seq, f"new-{r.key}" if r.is_new else r.entity_id) for r in found] == expected
    after = {r.entity_id: r for r in extraction.registry_after(extraction.resolve(accepted, entities, scope), entities).collect()}
    assert len(after) == 3 + len(minted) and after["e3"].book_ids == ["other"]


def test_resume(spark):
    chapters = spark.createDataFrame([("a", k, None, "x", None) for k in range(5)], CHAPTERS)
    start = lambda rows, **k: extraction.resume_index(spark.createDataFrame(rows, CHECKPOINTS), chapters, **k).first().start
    assert start([]) == 0 and start([("a", 5, 3, "p")]) == 3 and start([("a", 4, 3, "p")]) == 0
    assert start([("a", 5, 99, "p")]) == 5 and start([("a", 5, -2, None)]) == 0 and start([("a", 5, 3, "p")], restart=True) == 0
    extraction.check_resume("x", "y", 0)
    extraction.check_resume(None, "y", 3)
    with pytest.raises(extraction.ResumeMismatch) as error:
        extraction.check_resume("x", "y", 3)
    assert error.value.next_chapter_index == 3


def test_providers(spark):
    chapters = spark.createDataFrame([("a", 0, None, "Ann met Bob. Ann left.", None), ("a", 1, None, "", None)], CHAPTERS)
    facts, runs = extract(chapters, FakeProvider())
    plain = extraction.fake_extract(chapters)
    columns = ["book_id", "chapter_index", "seq", "entity_name", "entity_type", "category", "statement", "when", "time_phrase"]
    assert sorted(facts.select(columns).collect()) == sorted(plain.select(columns).collect())
    assert [r.ok for r in runs.collect()] == [True, True]
    with pytest.raises(ValueError):
        get_provider("nobody")
    assert optional(FakeProvider(), "usage") is None and optional(FakeProvider(), "identity") == "fake"
    assert FakeProvider().answer("q", " ") == "I don't have enough information about that yet."
    assert response_schema("nonfiction")["properties"]["facts"]["maxItems"] == 40
