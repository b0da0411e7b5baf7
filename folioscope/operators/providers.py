"""Extractors and answerers: what they must offer, those that come with the engine, and how they run on a cluster."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.extraction import parse_responses
from folioscope.schemas import CATEGORIES, ENTITY_TYPES, FAKE_STOPWORDS, MAX_FACTS, MAX_TIME_PHRASE, SCHEMA_STATEMENT, WHEN


class Provider(Protocol):
    """respond() gives an extractor's raw response to a chapter; answer() replies to a question from a context.

    Optional: identity() -> str, usage() -> dict of the last call's tokens and seconds, placement() -> dict,
    narrow(window) -> int. Where one is missing or fails, its result counts as unknown.
    """

    def respond(self, chapter: str, known: list[tuple[str, str]], content_type: str) -> str: ...

    def answer(self, question: str, context: str, content_type: str) -> str: ...


def optional(provider: object, name: str, *args):
    """The result of an optional capability, or None."""
    try:
        return getattr(provider, name)(*args)
    except Exception:
        return None


class FakeProvider:
    """Deterministic, for tests: each capitalised word that is new to the chapter, with its sentence."""

    def __init__(self, name: str = "fake"):
        self.name = name

    def identity(self) -> str:
        return self.name

    def respond(self, chapter: str, known=(), content_type: str = "fiction") -> str:
        found: dict[str, str] = {}
        for sentence in re.split(r"(?<=[.!?])\s+", chapter):
            for name in re.findall(r"\b[A-Z][a-z]+\b", sentence):
                if name not in FAKE_STOPWORDS:
                    found.setdefault(name, sentence.strip())
        return json.dumps([{"entity_name": n, "entity_type": "character", "category": "development", "statement": s} for n, s in found.items()])

    def answer(self, question: str, context: str, content_type: str = "fiction") -> str:
        return f"[fake answer] Based on: {context}" if context.strip() else "I don't have enough information about that yet."


class HttpProvider:
    """A model behind an HTTP endpoint that takes a prompt and a JSON schema and returns text. Unreachable ends the run."""

    def __init__(self, url: str, model: str, window: int = 16384, timeout: float = 600.0):
        self.url, self.model, self.window, self.timeout, self.last = url, model, window, timeout, {}

    def identity(self) -> str:
        return f"http:{self.model}"

    def usage(self) -> dict:
        return self.last

    def narrow(self, window: int) -> int:
        self.window = min(self.window, window)
        return self.window

    def _call(self, prompt: str, schema: dict | None) -> str:
        import urllib.request

        body = json.dumps({"model": self.model, "prompt": prompt, "format": schema, "stream": False, "options": {"num_ctx": self.window, "temperature": 0.2}}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                found = json.load(reply)
        except OSError as error:
            raise RuntimeError(f"the model server at {self.url} can't be reached: {error}") from error
        self.last = {k: found.get(k) for k in ("prompt_tokens", "output_tokens", "prompt_seconds")}
        return found.get("response", "")

    def respond(self, chapter: str, known=(), content_type: str = "fiction") -> str:
        return self._call(extraction_prompt(chapter, known, content_type), response_schema(content_type))

    def answer(self, question: str, context: str, content_type: str = "fiction") -> str:
        return self._call(answer_prompt(question, context), None)


_PROVIDERS: dict[str, Callable[..., Provider]] = {"fake": lambda **_: FakeProvider(), "http": HttpProvider}


def register_provider(name: str, make: Callable[..., Provider]) -> None:
    _PROVIDERS[name] = make


def get_provider(name: str = "fake", **options) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name](**options)


def response_schema(content_type: str = "fiction") -> dict:
    """The JSON schema that a response should keep to."""
    text = {"type": "string"}
    fact = {
        "entity_name": text,
        "entity_type": text | {"enum": sorted(ENTITY_TYPES[content_type])},
        "category": text | {"enum": sorted(CATEGORIES[content_type])},
        "statement": text | {"maxLength": SCHEMA_STATEMENT},
        "when": text | {"enum": sorted(WHEN)},
        "time_phrase": text | {"maxLength": MAX_TIME_PHRASE},
    }
    items = {"type": "object", "properties": fact, "required": [k for k in fact if k != "time_phrase"]}
    return {"type": "object", "properties": {"facts": {"type": "array", "maxItems": MAX_FACTS, "items": items}}, "required": ["facts"]}


def known_list(known: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} ({kind})" if kind else name for name, kind in known)


def extraction_prompt(chapter: str, known=(), content_type: str = "fiction") -> str:
    return "\n".join((
        f"List the facts that this chapter states about its {', '.join(sorted(ENTITY_TYPES[content_type]))} entities, as JSON.",
        f"Categories: {', '.join(sorted(CATEGORIES[content_type]))}. Time: {', '.join(WHEN)}.",
        f"Names in use, to be spelt like this: {known_list(list(known)) or 'none'}.",
        "Chapter:",
        chapter,
    ))


def answer_prompt(question: str, context: str) -> str:
    return f"Answer from these notes alone; say so if they don't tell.\n\n{context}\n\nQuestion: {question}"


@dataclass
class Usage:
    prompt_tokens: int | None = None
    output_tokens: int | None = None
    prompt_seconds: float | None = None


def extract(chapters: DataFrame, provider: Provider, content_type: str = "fiction", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, runs) of a provider over chapters, in parallel over all of them.

    known: (book_id, entity_name, entity_type) that the prompts name. Each chapter is one call; the provider
    object is sent to the executors. facts: as `fake_extract`; runs: (book_id, chapter_index, ok, seconds,
    prompt_tokens, output_tokens, prompt_seconds).
    """
    rows = chapters.select("book_id", F.col("index").alias("chapter_index"), "text")
    if known is None:
        rows = rows.withColumn("known", F.array().cast("array<struct<n:string,k:string>>"))
    else:
        names = known.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("entity_name").alias("n"), F.col("entity_type").alias("k")))).alias("known"))
        rows = rows.join(names, "book_id", "left")

    def run(batches):
        import time

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for book, index, text, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began = time.monotonic()
                raw = provider.respond(text or "", [(x["n"], x["k"]) for x in names or ()], content_type)
                used = optional(provider, "usage") or {}
                for column, value in zip(out, (book, index, raw, time.monotonic() - began, used.get("prompt_tokens"), used.get("output_tokens"), used.get("prompt_seconds")), strict=True):
                    column.append(value)
            types = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            names_ = ("book_id", "chapter_index", "raw", "seconds", "prompt_tokens", "output_tokens", "prompt_seconds")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], list(names_))

    made = rows.select("book_id", F.col("chapter_index").cast("int").alias("chapter_index"), "text", "known").mapInArrow(run, "book_id string, chapter_index int, raw string, seconds double, prompt_tokens long, output_tokens long, prompt_seconds double")
    made = made.withColumn("response_id", F.struct("book_id", "chapter_index"))
    parsed = parse_responses(made, content_type)
    facts = parsed.where("ok").select("response_id.*", F.posexplode("facts").alias("k", "f"))
    facts = facts.select("book_id", "chapter_index", (F.col("k") + 1).cast("long").alias("seq"), "f.entity_name", "f.entity_type", "f.category", "f.statement", "f.when", "f.time_phrase")
    runs = parsed.select("response_id", "ok").join(made.drop("raw", "book_id", "chapter_index"), "response_id").select("response_id.*", "ok", "seconds", "prompt_tokens", "output_tokens", "prompt_seconds")
    return facts, runs
