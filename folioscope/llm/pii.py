"""Personal data by anchor expansion: an Aho-Corasick scan finds cues, local parsers grow and validate spans."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import body, prepare

KINDS = ("email", "ip", "card", "phone", "account", "url")
#: Words that announce an identifier, and URL schemes' end; in lower, title and upper case.
CUES = ("account", "acct", "iban", "token", "password", "passwd", "secret", "api_key", "apikey", "passport", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IDENTIFIER = re.compile(r"(?:\s*(?:number|no\.?|id|is))?[\s:=\"'#]{1,8}([A-Za-z0-9][A-Za-z0-9_-]{5,})")
ADDRESS = re.compile(r"[^\s<>\"'|]+")


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    found, digits = ahocorasick.Automaton(), "0123456789"
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for a in digits:
        found.add_word("+" + a, ("phone", 2))
        for b in digits:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("card", 2 + len(between)))
    for cue in CUES:
        for form in {cue, cue.title(), cue.upper()}:
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return value.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each kind's in order and disjoint; offsets in code points, ends exclusive.

    Every cue is looked at once, in order, and expansion never goes back over an earlier match of its kind,
    so the work is linear in the text.
    """
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done[kind] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                spans[kind].append((start, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            start = at
            while start > done[kind] and "0" <= text[start - 1] <= "9":
                start -= 1
            m = CHAIN.match(text, start)
            done[kind], at = m.end(), start
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    spans[kind].append((at, end))
                at = end + 1
        elif kind == "card":
            m = CARD.match(text, at)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans[kind].append(m.span())
        elif kind == "phone":
            if m := PHONE.match(text, at):
                done[kind] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans[kind].append(m.span())
        elif kind == "account":
            if m := IDENTIFIER.match(text, last + 1):
                value, iban = m[1], text[at : last + 1].lower() == "iban"
                if (15 <= len(value) <= 34 and _iban(value)) if iban else sum("0" <= c <= "9" for c in value) >= 3:
                    spans[kind].append(m.span(1))
                    done[kind] = m.end()
        else:
            start = at
            while start > max(done[kind], at - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = ADDRESS.match(text, at + 3)
            if start < at and m:
                end = m.start() + len(m[0].rstrip(".,;:!?)]}"))
                if end > m.start():
                    spans[kind].append((start, end))
                    done[kind] = end
    return spans


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) for every row; whole texts, in one pass without a shuffle.

    Base kinds: email, ip, card, phone. The cues add account (an identifier with three digits after a word
    such as token or account; an IBAN by its checksum) and url (scheme to the end of the address). Null and
    empty texts have no spans; null and repeated doc_ids are kept as they come.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]] for found in map(find_spans, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text")).mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
