"""Operator 10, personal data: patterns on the source text, and on a text without disguises with its way back.

Base spans are the leftmost non-overlapping matches of each kind in the source. The method adds what disguises hide:
a chain of transducers rewrites the text (homoglyphs and foreign digits to ASCII, invisible characters away, runs of
spelled digits to digits, at/dot disguises to `@` and `.`) and keeps for every character of its output the span of the
source it comes from; the same patterns run on the output and their spans are mapped back. A span that the base has
already, or that lies within a base span of its kind, is not added again.

Positions are code points of the whole text, ends exclusive. Defined results: null and empty texts have no spans;
repeated rows are scanned each for itself; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common

KINDS = ("email", "ip", "card", "phone")

# Letters that look like Latin ones, spelled digits by language, and the words of at/dot disguises.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "․": ".", "。": ".", "‧": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", " ": " ",
}
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "­​‌‍⁠﻿"
AT_WORDS, DOT_WORDS = "at|arroba", "dot|punto|punkt|point"

#: Least digits that are spelled in a row for the run to be read as digits.
SPELLED_RUN = 3

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _homoglyphs() -> dict[int, str]:
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
    for start in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50):  # other scripts' digits
        table |= {start + i: str(unicodedata.digit(chr(start + i))) for i in range(10)}
    return table


HOMOGLYPHS = _homoglyphs()
STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + INVISIBLE + "]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?:\bplus[\s-]{{1,2}})?\b(?:(?:double|triple)\s)?(?:{_WORD})(?:[\s,.-]{{1,3}}(?:(?:double|triple)\s)?(?:{_WORD})){{{SPELLED_RUN - 1},}}\b", re.IGNORECASE)
_SPELLED_WORD = re.compile(rf"(double|triple)\s|({_WORD})|(plus)", re.IGNORECASE)
_OPEN, _CLOSE = r"\s{0,2}[\[({<]\s?", r"\s?[\])}>]\s{0,2}"
_DOT = rf"(?:{_OPEN}(?:{DOT_WORDS}|\.){_CLOSE}|(?<=[a-z0-9])(?:\s{{1,2}}(?:{DOT_WORDS})\s{{1,2}}|[_-](?:{DOT_WORDS})[_-])(?=[a-z]{{2}}|[0-9]))"
_AT = rf"(?:{_OPEN}(?:{AT_WORDS}|@){_CLOSE}|(?<=[a-z0-9])(?:\s{{1,2}}(?:{AT_WORDS})\s{{1,2}}|[_-](?:{AT_WORDS})[_-])(?=[a-z0-9-]+?{_DOT}))"
#: Without any other disguise, `at` before a domain counts only behind a token that looks like a mailbox.
_BARE_AT = rf"(?<=[a-z0-9])\s{{1,2}}(?:{AT_WORDS})\s{{1,2}}(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2}})"
_DISGUISE = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})|(?P<bare>{_BARE_AT})", re.IGNORECASE)
#: Cheap signs of a disguise, on lower case.
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:{AT_WORDS}|@|\.)\s?[\])}}>]")
_AT_DOMAIN = re.compile(rf"\s(?:{AT_WORDS})\s{{1,2}}[a-z0-9-]+\.[a-z0-9]")
_MAILBOX = re.compile(r"(?:[a-z0-9%+]+[._-])+[a-z0-9%+]+$|[a-z]+[0-9]+$", re.IGNORECASE)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    origin: str = "base"


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in a text, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class Tracked:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, n = text, np.arange(len(text) + 1)
        self.start, self.end = n[:-1], n[1:]

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each edit's string for its characters; all of its characters come from all of theirs."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a] if a < b else 0)]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1] if a < b else 0)]
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


def _spelled(t: Tracked) -> list[tuple[int, int]]:
    """Runs of spelled digits become digits, one character a word; returns the places of the runs."""
    edits, runs, shift = [], [], 0
    for m in _RUN.finditer(t.text):
        last, times, grown = m.start(), 1, m.start() + shift
        for w in _SPELLED_WORD.finditer(t.text, *m.span()):
            if w[1]:
                times = 2 if w[1].lower() == "double" else 3
                continue
            new = "+" if w[3] else SPELLED[w[2].lower()] * times
            edits.append((last, w.end(), new))
            shift += len(new) - (w.end() - last)
            last, times = w.end(), 1
        runs.append((grown, last + shift))
    if edits:
        t.replace(edits)
    return runs


def undisguised(text: str) -> tuple[Tracked | None, list[tuple[int, int]]]:
    """The text without disguises, or None where it has none; and the runs of digits that were spelled."""
    strange = not text.isascii() and STRANGE.search(text) is not None
    low = text if text.islower() else text.lower()
    hinted = any(w in low for w in DOT_WORDS.split("|")) or _BRACKETED.search(low) is not None or _AT_DOMAIN.search(low) is not None
    dots = hinted and _DISGUISE.search(text) is not None
    spelled = _RUN.search(text) is not None
    if not (strange or dots or spelled):
        return None, []
    t = Tracked(text)
    if strange:
        t.text = t.text.translate(HOMOGLYPHS)
        t.replace([(i, i + 1, "") for i, c in enumerate(t.text) if c in INVISIBLE])
    runs = _spelled(t) if spelled or strange else []
    edits = []
    for m in _DISGUISE.finditer(t.text) if dots or strange else ():
        if m["bare"] is None or _MAILBOX.search(t.text[max(0, m.start() - 64) : m.start()].rpartition(" ")[2]):
            edits.append((*m.span(), "." if m["dot"] else "@"))
    if edits:
        cuts = np.array([a for a, _, _ in edits])
        gone = np.append([0], np.cumsum([b - a - 1 for a, b, _ in edits]))
        runs = [(int(a - gone[np.searchsorted(cuts, a)]), int(b - gone[np.searchsorted(cuts, b)])) for a, b in runs]
        t.replace(edits)
    return t, runs


def find(text: str | None) -> list[Span]:
    """All spans, by kind as in KINDS, then start."""
    text = text or ""
    base = [Span(*m) for m in matches(text)]
    t, runs = undisguised(text)
    if t is None:
        return base
    held: dict[str, list[Span]] = {k: [s for s in base if s.kind == k] for k in KINDS}
    more = [(k, *t.source(a, b)) for k, a, b in matches(t.text)]
    for a, b in runs:  # spelled digits are a phone number without a plus too, unless another kind has them
        if 8 <= len(_digits(t.text[a:b])) <= 15 and not t.text[a:b].startswith("+"):
            more.append(("phone", *t.source(a, b)))
    for k, a, b in more:
        if not any(s.start <= a and b <= s.end for s in held[k]):
            held[k].append(Span(k, a, b, "method"))
    return [s for k in KINDS for s in sorted(held[k], key=lambda s: (s.start, s.end))]


def redacted(text: str | None) -> str | None:
    """The text with each stretch that spans cover replaced by the kind of its first span in brackets."""
    if text is None or not (spans := find(text)):
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, origin, text) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("origin", pa.string()), ("text", pa.string())]))

    def run(batch):
        found = [[{"kind": s.kind, "start": s.start, "end": s.end, "origin": s.origin, "text": t[s.start : s.end]} for s in find(t)] for t in common.texts_of(batch)]
        return common.rebatch(doc_id=batch.column(0), spans=pa.array(found, kind))

    return common.map_batches(common.doc_columns(docs), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,origin:string,text:string>>")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced, and n_chars, where there is one, counted again."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(redacted, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["origin"] == "base")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
