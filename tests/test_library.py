"""Sources, storage, streams and the commands, from files to answers."""

import json
import re
import zipfile

import pytest

from folioscope import cli
from folioscope.engine import Engine
from folioscope.functions.config import env_number, env_text
from folioscope.operators.extraction import ResumeMismatch
from folioscope.operators.providers import FakeProvider
from folioscope.schemas import CHAPTERS
from folioscope.sources import epub, pages
from folioscope.sources.library import Library, declared_from_json, facts_to_json, read_json_layout, unique_book_id
from folioscope.streaming.extraction import done_chapters, eta_seconds, extract_stream, extracted_facts, format_duration, progress

PADDING = " and then nobody said a word about it for days on end while the rain fell on the quiet hills" * 2


def build(path, documents, toc, title="The Saga", author="A. Writer"):
    """documents: (name, html); toc: (label, href, children)."""
    items = "".join(f'<item id="d{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, (n, _) in enumerate(documents))
    spine = "".join(f'<itemref idref="d{k}"/>' for k in range(len(documents)))

    def points(entries):
        return "".join(f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{href}"/>{points(inner)}</navPoint>' for label, href, inner in entries)

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator></metadata><manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="img" href="a.png" media-type="image/png"/></manifest><spine>{spine}<itemref idref="img"/></spine></package>')
        z.writestr("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points(toc)}</navMap></ncx>')
        for name, html in documents:
            z.writestr(f"OPS/{name}", html)
    return str(path)


def page(body):
    return f"<html><head><title>no</title></head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    documents = [
        ("cover.xhtml", page("  ")),
        ("one.xhtml", page("<p>front</p><h1>First</h1><p>Maren met Abel." + PADDING + "</p><h2>Second</h2><p>Maren left Bryn." + PADDING + "</p>")),
        ("t%20wo.xhtml".replace("%20", "_"), page("<p>Cleo &amp; Maren&nbsp;sang." + PADDING + "</p>")),
        ("page_4.html", page("<h3>Last</h3><p>Dara slept." + PADDING + "</p>")),
    ]
    return build(tmp_path_factory.mktemp("books") / "the_saga.epub", documents, [("Part", "one.xhtml#x", [("Named", "t_wo.xhtml", [])]), ("Other", "t_wo.xhtml", [])])


def test_epub_chapters(spark, book):
    files = spark.read.format("binaryFile").load(book)
    found = epub.chapters(epub.segments(files), epub.toc(files)).orderBy("index").collect()
    assert [(r.title, r.text[:5], r.pages, r.source) for r in found] == [(None, "front", None, "one.xhtml"), ("First", "First", None, "one.xhtml"), ("Second", "Secon", None, "one.xhtml"), ("Named", "Cleo ", None, "t_wo.xhtml"), ("Last", "LastD", [4, 4], "page_4.html")]
    assert epub.resolved_metadata(epub.metadata(files)).first()[1:] == ("The Saga", "A. Writer")
    assert epub.resolved_metadata(epub.metadata(files), title="X").first().title == "X"
    toc = [(r.root_ord, r.label, r.nested) for r in epub.toc(files).orderBy("ord").collect()]
    assert toc == [(0, "Part", True), (0, "Named", True), (1, "Other", False)]


def test_epub_data_source(spark, book):
    epub.register(spark)
    read = lambda what: spark.read.format("epub").option("what", what).load(book)
    assert read("segments").count() == 6 and read("toc").count() == 3 and read("metadata").first().author == "A. Writer"


def test_paged_chapters(spark):
    texts = spark.createDataFrame([("a", k, f"p{k} ") for k in range(5)] + [("b", 0, "x"), ("b", 1, "y"), ("c", 0, " ")], "path string, page int, text string")
    outline = spark.createDataFrame([("a", 0, 1, " One ", 1), ("a", 1, 2, "inner", 2), ("a", 2, 1, "Two", 3), ("a", 3, 1, "", 3)], "path string, ord int, level int, title string, start_page int")
    found = [(r.path, r["index"], r.title, r.text, r.pages) for r in pages.chapters(texts, outline).orderBy("path", "index").collect()]
    assert found == [("a", 0, "One", "p0 p1", [1, 2]), ("a", 1, None, "p2 p3 p4", [3, 5]), ("b", 0, None, "xy", None)]


def test_json_layout(spark, tmp_path):
    root = tmp_path / "old"
    (root / "b-1").mkdir(parents=True)
    (root / "b-1/chapters.jsonl").write_text(json.dumps({"index": 0, "title": None, "text": "t"}) + "\n\n")
    (root / "b-1/facts.jsonl").write_text(json.dumps({"entity_id": "e", "chapter_index": 0, "category": "status", "statement": "s"}) + "\n")
    (root / "b-1/metadata.json").write_text(json.dumps({"book_id": "b-1", "title": "B", "chapter_count": 1}, indent=2))
    (root / "index.json").write_text(json.dumps({"books": [{"book_id": "b-1", "title": "B", "author": None, "series": None}]}))
    (root / "entities.json").write_text(json.dumps({"entities": [{"entity_id": "e", "canonical_name": "E", "type": "character", "aliases": [], "book_ids": ["b-1"]}]}))
    found = {k: v.collect() for k, v in read_json_layout(spark, str(root)).items()}
    assert {k: len(v) for k, v in found.items()} == {"index": 1, "books": 1, "chapters": 1, "facts": 1, "entities": 1}
    assert (found["facts"][0].when, found["facts"][0].book_id, found["facts"][0].entity_name, found["books"][0].content_type, found["entities"][0].epithets) == ("present", "b-1", "e", "fiction", [])
    facts_to_json(read_json_layout(spark, str(root))["facts"], f"{tmp_path}/out")
    assert "time_phrase" not in spark.read.text(f"{tmp_path}/out").first().value
    raw = spark.createDataFrame([("a", '{"groups": [["x", "y"], {"names": ["z"]}, {"names": ["p", "q"], "epithets": ["e"], "reason": "r"}]}'), ("b", "broken"), ("c", "{}")], "book_id string, raw string")
    assert [tuple(r) for r in declared_from_json(raw).orderBy("gseq").collect()] == [("a", 0, ["x", "y"], [], ""), ("a", 2, ["p", "q"], ["e"], "r")]
    assert unique_book_id("a", {"a", "a-2"}) == "a-3"


def test_snapshots(spark, tmp_path):
    library = Library(spark, f"{tmp_path}/lib")
    assert library.read("chapters").count() == 0
    rows = spark.createDataFrame([("a", 0, None, "x", None), ("b", 0, None, "y", [1, 2])], CHAPTERS)
    for _ in range(4):
        library.write("chapters", rows)
    assert library.snapshots("chapters") == [3, 4] and library.read("chapters").count() == 2
    library.replace_books("chapters", rows.limit(0), ["a"])
    assert [r.book_id for r in library.read("chapters").collect()] == ["b"]
    (tmp_path / "lib/chapters/v9").mkdir()  # a write that never ended
    assert library.snapshots("chapters")[-1] == 5


@pytest.fixture(scope="module")
def engine(spark, book, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("library")))
    assert engine.ingest_epub(book, series="S", position=1)[0] == "the-saga"
    return engine


def test_from_file_to_answer(spark, engine):
    assert engine.show("the-saga").fact_count is None
    result = engine.extract("the-saga", FakeProvider())
    assert result["facts"] > 3 and not result["already_complete"] and engine.extract("the-saga", FakeProvider())["already_complete"]
    again = engine.extract("the-saga", FakeProvider(), restart=True)
    assert again["facts"] == result["facts"]
    with pytest.raises(ValueError):
        engine.ask("the-saga", 99, "who?", FakeProvider())
    answer, sources = engine.ask("the-saga", 0, "what of maren?", FakeProvider())
    assert "Maren" in answer and sources and sources[0].startswith("The Saga")
    assert sum(map(len, engine.doctor().values())) == 0
    assert any("citable" in line for line in engine.compare("the-saga", [0], {"fake": FakeProvider(), "x": FakeProvider("other")}))


def test_commands(spark, engine, book):
    said = []

    def run(*argv):
        said.clear()
        code = cli.run(cli.parser().parse_args(argv), engine, say=lambda *a, **k: said.extend(map(str, a)), ask=lambda _: "y")
        return code, "\n".join(said)

    assert run("ingest", "nothing.pdf")[0] == 1
    assert run("ingest", book, "--title", "The Saga")[1].startswith("the-saga-2")
    assert "the-saga-2" in run("list")[1] and "chapter_count" in run("show", "the-saga-2")[1]
    run("aliases", "the-saga", "--link", "Maren,Mara")
    assert engine.library.read("entities").where("canonical_name = 'Maren'").first().aliases == ["Mara"]
    run("aliases", "the-saga", "--unlink")
    assert engine.library.read("declared").isEmpty()
    run("remove", "the-saga-2")
    assert "the-saga-2" not in run("list")[1]
    assert "duplicate entities" in run("doctor", "--fix", "--merge-duplicates")[1]
    assert "facts" in run("extract", "the-saga", "--restart")[1] and "Based on" in run("chat", "the-saga", "--chapter", "0", "--question", "maren")[1]


def test_stream_goes_on_and_repeats_nothing(spark, tmp_path):
    where = [f"{tmp_path}/{x}" for x in ("chapters", "out", "checkpoint")]
    rows = lambda b: spark.createDataFrame([(b, 0, None, f"{b.title()} met Ann." + PADDING, None), (b, 1, None, "Too short.", None)], CHAPTERS)
    rows("bob").coalesce(1).write.mode("append").parquet(where[0])
    extract_stream(spark, *where).awaitTermination()
    first = extracted_facts(spark, where[1]).count()
    rows("cyr").coalesce(1).write.mode("append").parquet(where[0])
    for _ in range(2):
        extract_stream(spark, *where).awaitTermination()
    assert (first, extracted_facts(spark, where[1]).count()) == (2, 4)
    done = done_chapters(spark, where[1])
    assert done.count() == 4 and done.where("skipped").count() == 2
    assert [(r.chapter_count, r.done, r.skipped) for r in progress(spark, where[1], spark.read.parquet(where[0])).collect()] == [(2, 2, 1)] * 2
    with pytest.raises(ResumeMismatch):
        extract_stream(spark, *where, identity="other")
    assert eta_seconds(10, 5, 20) == 40 and eta_seconds(1, 0, 5) is None
    assert [format_duration(s) for s in (5, 65, 3700)] == ["5s", "1m 05s", "1h 01m"]


def test_settings(monkeypatch):
    monkeypatch.setenv("FOLIO_X", " ")
    assert env_text("FOLIO_X", "d") == "d" and env_number("FOLIO_X", 3) == 3
    monkeypatch.setenv("FOLIO_X", "7x")
    with pytest.raises(ValueError, match="FOLIO_X"):
        env_number("FOLIO_X")


def notes(fails_at: str | None = None):
    """A provider that states each capitalised word, and in `when` whether it was told the word; it fails at a chapter with
    `fails_at` in it. A class of its own here, so that workers needn't import this module."""

    class Notes:
        def identity(self) -> str:
            return "notes"

        def respond(self, chapter, known=(), content_type="fiction"):
            if fails_at and fails_at in chapter:
                raise RuntimeError("no reply")
            told = {name for name, _ in known}
            words = dict.fromkeys(re.findall(r"\b[A-Z][a-z]+\b", chapter))
            return json.dumps([{"entity_name": w, "entity_type": "character", "category": "status", "statement": f"{w} is here.", "when": "past" if w in told else "present"} for w in words])

        def answer(self, question, context, content_type="fiction"):
            return ""

    return Notes()


def facts_of(engine):
    return sorted((r.chapter_index, r.seq, r.entity_id, r.entity_name, r.when) for r in engine.library.read("facts").collect())


def test_extraction_by_batches(spark, tmp_path):
    """Interrupted after some chapters a run goes on there and ends as one that wasn't; later batches are told earlier names."""
    filler = " and so it went on and on in the same way as it had been before that day" * 2
    texts = [f"Maren met {name} by the sea{filler}." for name in ("Odo", "Pia", "Quen", "Rolf", "Sten")]
    texts.insert(2, "too short")
    chapters = spark.createDataFrame([(k, None, t, None) for k, t in enumerate(texts)], "index int, title string, text string, pages array<int>")
    engines = []
    for name in ("whole", "cut"):
        engine = Engine(spark, f"{tmp_path}/{name}")
        engine.ingest(chapters, "Shore", auto_link=False)
        engine.library.write("chapters", chapters.selectExpr("'shore' AS book_id", "*"))  # as they are: not consolidated
        book = engine.library.read("books").collect()[0]
        engine.library.write("books", spark.createDataFrame([book[:7] + (len(texts),) + book[8:]], engine.library.read("books").schema))
        engines.append(engine)
    whole, cut = engines
    seen = []
    result = whole.extract("shore", notes(), batch=2, progress=lambda *x: seen.append(x[:2]))
    assert seen == [(2, 6), (4, 6), (6, 6)] and (result["facts"], result["skipped"], result["new_entities"]) == (10, 1, 6)
    whens = {(r[0], r[3]): r[4] for r in facts_of(whole)}
    assert whens[0, "Maren"] == whens[1, "Maren"] == "present" and whens[3, "Maren"] == whens[5, "Maren"] == "past"
    with pytest.raises(Exception, match="no reply"):
        cut.extract("shore", notes("Rolf"), batch=2)
    assert [tuple(r) for r in cut.library.read("checkpoints").collect()] == [("shore", 6, 4, "notes")]
    assert facts_of(cut) == [f for f in facts_of(whole) if f[0] < 4]
    assert cut.extract("shore", notes(), batch=2)["resumed_from"] == 4
    assert facts_of(cut) == facts_of(whole) and cut.extract("shore", notes())["already_complete"]
    key = lambda e: sorted((r.entity_id, r.canonical_name, tuple(r.book_ids), r.ord) for r in e.library.read("entities").collect())
    assert key(cut) == key(whole) and len(key(cut)) == 6
