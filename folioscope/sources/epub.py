"""EPUB files as chapter tables: a Python data source, and the parsing it does with the standard library."""

from __future__ import annotations

import posixpath
import zipfile
from html.parser import HTMLParser
from io import BytesIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.functions import text as T
from folioscope.operators.ingest import page_number

SEGMENTS = "path string, source string, doc_ord int, segment int, title string, text string, segments int"
TOC = "path string, root_ord int, ord int, label string, href string, nested boolean"
_VOID = {"br", "img", "hr", "meta", "link", "input", "col", "wbr", "source", "area", "base", "embed", "param", "track"}


class _Segments(HTMLParser):
    """Collects a document's text, and where its h1, h2 and h3 start; within the body, if it has one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = [[None, []]]  # of each segment: heading's level and parts, text parts
        self.in_body, self.has_body, self.heading = False, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "body" and not self.has_body:
            self.has_body, self.parts = True, [[None, []]]
        if tag in ("h1", "h2", "h3"):
            self.heading = (tag, [])
            self.parts.append([self.heading, []])

    def handle_endtag(self, tag):
        if self.heading and tag == self.heading[0]:
            self.heading = None

    def handle_data(self, data):
        self.parts[-1][1].append(data)
        if self.heading:
            self.heading[1].append(data)


def split_document(html: str) -> list[tuple[str | None, str]]:
    """(title, text) of a document's segments: one at each h1, h2 and h3 if there are several, else one.

    Text before the first of several headings is a segment without title if it isn't blank. With one heading
    at most, the title is the first with text, h1 before h2 before h3.
    """
    parser = _Segments()
    parser.feed(html)
    parser.close()
    texts = ["".join(text) for _, text in parser.parts]
    heads = [(h[0], "".join(h[1]).strip()) for h, _ in parser.parts[1:]]
    if len(heads) <= 1:
        title = next((t for level in ("h1", "h2", "h3") for tag, t in heads if tag == level and t), None)
        return [(title, "".join(texts).strip())]
    first = [(None, texts[0].strip())] if texts[0].strip() else []
    return first + [(title or None, text.strip()) for (_, title), text in zip(heads, texts[1:], strict=True)]


def normal_href(href: str) -> str:
    return posixpath.normpath(unquote(href).split("#")[0])


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _children(node, name):
    return [c for c in node if _local(c) == name]


class Epub:
    """The package document of an EPUB file: metadata, spine and table of contents."""

    def __init__(self, data: bytes):
        self.files = zipfile.ZipFile(BytesIO(data))
        container = ElementTree.fromstring(self.files.read("META-INF/container.xml"))
        self.package = next(n.get("full-path") for n in container.iter() if _local(n) == "rootfile")
        self.base = posixpath.dirname(self.package)
        self.root = ElementTree.fromstring(self.files.read(self.package))
        self.items = {n.get("id"): n for n in self.root.iter() if _local(n) == "item"}

    def metadata(self) -> dict[str, str | None]:
        def first(name):
            return next((n.text.strip() for n in self.root.iter() if _local(n) == name and n.text and n.text.strip()), None)

        return {"title": first("title"), "author": first("creator")}

    def documents(self):
        """(href, html) of the spine's documents, without the navigation."""
        for ref in (n for n in self.root.iter() if _local(n) == "itemref"):
            item = self.items.get(ref.get("idref"))
            if item is None or item.get("media-type") not in ("application/xhtml+xml", "text/html") or "nav" in (item.get("properties") or "").split():
                continue
            href = unquote(item.get("href"))
            yield href, self.files.read(posixpath.normpath(posixpath.join(self.base, href))).decode("utf-8", "replace")

    def toc(self) -> list[tuple[int, int, str, str | None, bool]]:
        """(root_ord, ord, label, href, nested), depth first; root_ord numbers the top entries, nested tells which of them are groups."""
        ncx = next((i for i in self.items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
        nav = next((i for i in self.items.values() if "nav" in (i.get("properties") or "").split()), None)
        chosen = ncx if ncx is not None else nav
        if chosen is None:
            return []
        path = posixpath.normpath(posixpath.join(self.base, unquote(chosen.get("href"))))
        tree = ElementTree.fromstring(self.files.read(path))
        within = posixpath.dirname(chosen.get("href"))
        join = lambda h: posixpath.join(within, h) if h and within else h
        rows: list[tuple[int, int, str, str | None, bool]] = []

        def points(node):
            for p in _children(node, "navPoint"):
                label = "".join(t for n in _children(p, "navLabel") for t in n.itertext()).strip()
                yield label, next((c.get("src") for c in _children(p, "content")), None), p

        def entries(node):
            for li in (c for ol in _children(node, "ol") for c in _children(ol, "li")):
                link = next((n for n in li if _local(n) in ("a", "span")), None)
                yield ("".join(link.itertext()).strip() if link is not None else ""), (link.get("href") if link is not None else None), li

        walk = points if chosen is ncx else entries
        start = next(n for n in tree.iter() if _local(n) == "navMap") if chosen is ncx else next((n for n in tree.iter() if _local(n) == "nav" and any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())), None)
        if start is None:
            return []

        def add(node, root, nested):
            for label, href, child in walk(node):
                top = root if root is not None else (rows[-1][0] + 1 if rows else 0)
                group = nested if root is not None else any(True for _ in walk(child))
                rows.append((top, len(rows), label, normal_href(join(href)) if href else None, group))
                add(child, top, group)

        add(start, None, False)
        return rows


class _Files(DataSourceReader):
    def __init__(self, paths: list[str], what: str):
        self.paths, self.what = paths, what

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as file:
            yield from rows_of(partition.value, file.read(), self.what)


def rows_of(path: str, data: bytes, what: str):
    book = Epub(data)
    if what == "toc":
        for root, place, label, href, nested in book.toc():
            yield path, root, place, label, href, nested
    elif what == "metadata":
        found = book.metadata()
        yield path, found["title"], found["author"]
    else:
        for place, (href, html) in enumerate(book.documents()):
            segments = split_document(html)
            for k, (title, text) in enumerate(segments):
                yield path, normal_href(href), place, k, title, text, len(segments)


class EpubDataSource(DataSource):
    """spark.read.format("epub").option("what", "segments" | "toc" | "metadata").load(path): files of a shared folder.

    A file is a partition. Files in a store that only Spark reads go through `segments`, `toc` and `metadata`
    below, which take them as binary rows.
    """

    @classmethod
    def name(cls):
        return "epub"

    def schema(self):
        return {"toc": TOC, "metadata": "path string, title string, author string"}.get(self.options.get("what", "segments"), SEGMENTS)

    def reader(self, schema):
        import glob
        import os

        path = self.options["path"]
        paths = sorted(glob.glob(os.path.join(path, "*.epub"))) if os.path.isdir(path) else [path]
        return _Files(paths, self.options.get("what", "segments"))


def _binary(files: DataFrame, what: str, schema: str) -> DataFrame:
    """files: (path, content) of spark.read.format("binaryFile")."""

    def run(batches):
        for batch in batches:
            rows = [row for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in rows_of(path, data, what)]
            fields = [part.strip().split(" ") for part in schema.split(",")]
            types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, schema)


def segments(files: DataFrame) -> DataFrame:
    return _binary(files, "segments", SEGMENTS)


def toc(files: DataFrame) -> DataFrame:
    return _binary(files, "toc", TOC)


def metadata(files: DataFrame) -> DataFrame:
    return _binary(files, "metadata", "path string, title string, author string")


def chapters(found: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, index, title, text, pages, source): segments with text, numbered from 0 in the order of the spine.

    A document that is one segment without a heading takes the first label that the table of contents has
    for it. Documents named like page_12.html have page numbers.
    """
    from pyspark.sql import Window

    labels = contents.where((F.trim("label") != "") & F.col("href").isNotNull()).groupBy("path", F.col("href").alias("source")).agg(F.min_by(F.trim("label"), "ord").alias("label"))
    rows = found.where("text <> ''").join(labels, ["path", "source"], "left")
    number = F.row_number().over(Window.partitionBy("path").orderBy("doc_ord", "segment")) - 1
    page = page_number(F.col("source"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.when(F.col("segments") == 1, F.col("label")))
    return rows.select("path", number.alias("index"), title.alias("title"), "text", F.when(page.isNotNull(), F.array(page, page)).alias("pages"), "source")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubDataSource)


def resolved_metadata(found: DataFrame, title: str | None = None, author: str | None = None) -> DataFrame:
    """(path, title, author): what the caller says, else the file, else a guess from its name."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    guess = T.guess_title_author(stem)
    blank = lambda c: F.nullif(T.strip(c), F.lit(""))
    return found.select("path", F.coalesce(F.lit(title), blank("title"), guess["title"]).alias("title"), F.coalesce(F.lit(author), blank("author"), guess["author"]).alias("author"))
