import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import pii

from . import helpers

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, docs):
    want = sorted(((d, hashlib.sha256(joined(brute(t or "")).encode()).hexdigest()) for d, t in docs), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in rows), key=str) == want


def test_query_equals_plain_patterns(spark):
    rows = pii.op10_pii(spark, helpers.SF).collect()
    docs = helpers.documents()
    check(rows, docs)
    by = {d: brute(t) for d, t in docs}
    assert sum(map(len, by.values())) > 10
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in by[r.doc_id]) for k in pii.KINDS)
        assert {joined([s]) for s in by[r.doc_id]} <= set(r.spans.split(","))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+1234567890 ()\n_ée", max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.matches(text) == brute(text)


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("mail john at example dot com please", "email", "john at example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("john＠example．com", "email", "john＠example．com"),
    ("call plus four nine one seven one two three four five six today", "phone", "plus four nine one seven one two three four five six"),
    ("call five five five one two three four five ok", "phone", "five five five one two three four five"),
    ("host 192(dot)168(dot)1(dot)20 up", "ip", "192(dot)168(dot)1(dot)20"),
    ("pay four one one one, one one one one one one one one one one one one", "card", "four one one one, one one one one one one one one one one one one"),
    ("kss.21 at mail1.example.com asks", "email", "kss.21 at mail1.example.com"),
    ("see john dot doe at example dot com", "email", "john dot doe at example dot com"),
    ("jane_at_example_dot_org", "email", "jane_at_example_dot_org"),
    ("ping 10 dot 0 dot 0 dot 7 now", "ip", "10 dot 0 dot 0 dot 7"),
    ("dial +1 five five five 123 4567 now", "phone", "+1 five five five 123 4567"),
    ("​jo​hn@example.com", "email", "jo​hn@example.com"),
])
def test_disguises_map_back(text, kind, hidden):
    at = text.index(hidden)
    assert pii.Span(kind, at, at + len(hidden), "method") in pii.find(text)
    assert hidden not in pii.redacted(text)


@pytest.mark.parametrize("text", ["we met at noon and ate", "look at example.com", "version two is at example.com", "one two three", "a dot in the sky", "Le point de vue est un point", "un deux trois"])
def test_plain_prose_has_no_spans(text):
    assert pii.find(text) == [] and pii.redacted(text) == text


def test_odd_rows_and_redaction(spark):
    check(pii.scan(helpers.odd(spark)).selectExpr("doc_id", "sha2(array_join(transform(filter(spans, s -> s.origin = 'base'), s -> concat_ws(':', s.kind, s.start, s.end)), ','), 256) base_sha256").collect(), [(r[0], r[1]) for r in helpers.ODD])
    assert pii.scan(helpers.empty(spark)).count() == 0 and pii.redact(helpers.empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "mail a@b.co or +49 171 2345678 now", 9), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, "mail [EMAIL] or [PHONE] now", 27), (2, None, 0)]
