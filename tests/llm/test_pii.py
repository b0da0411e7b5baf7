import hashlib
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from folioscope.llm.pii import KINDS, find_spans, luhn, op2, pii_spans

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in RULES.items()}


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"@.+-% ()0123456789aZ_é\n", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-99", "x@", "4111-1111-1111-1111", "256.1.1.1"])).map("".join))
@example("a@b@c.d@e.f.g..h@i.j-")
@example("1.2.3.4.5.6.7.8.9 0255.1.1.1 1.2.3.256.7.8.9.1")
@example("")
def test_base_spans_are_those_of_the_patterns(text):
    found = find_spans(text)
    assert {k: found[k] for k in RULES} == brute(text)


def test_cues_add_spans():
    text = 'token = "24be64439e3e49cf" and IBAN DE89370400440532013000, see https://me:pw@example.org/x?q=1. the account of mine'
    found = find_spans(text)
    assert [text[a:b] for a, b in found["account"]] == ["24be64439e3e49cf", "DE89370400440532013000"]
    assert [text[a:b] for a, b in found["url"]] == ["https://me:pw@example.org/x?q=1"]
    assert not find_spans("IBAN DE89370400440532013001")["account"]


def test_table_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a@b.cd", "x"), (None, "+1 555 010 9999", None), (2, None, "y"), (2, "", "y"), (3, "w " * 50_000 + "a@b.cd", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {(r.doc_id, len(r.spans)) for r in pii_spans(docs).collect()}
    assert found == {(1, 1), (None, 1), (2, 0), (3, 1)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    by = {(r.doc_id, r.n_email, r.n_phone): r for r in op2(spark, str(tmp_path)).collect()}
    assert by[1, 1, 0].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest() and by[1, 1, 0].spans == "email:0:6"
    assert by[2, 0, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii_spans(docs.limit(0)).collect() == []
    assert KINDS[:4] == tuple(RULES)
