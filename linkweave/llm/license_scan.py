"""Operator 5, license scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line with words and the lines with words behind it, BLOCK_LINES in all or more, until those behind it hold as
many words as the longest template; so a notice lies in one block however it is wrapped or spaced. A template is found in
a block whose word set holds at least THRESHOLD of the template's words. The join is exact: words are in one global order, the rarest first by their count
over all documents (first pass); a template that overlaps a block in `need` words or more shares one of its first
size - need + 1 words with it (prefix filter), the block has at least `need` words (length filter), and what stands
behind the shared word on either side must suffice (positional filter). The rest is counted. Templates are a fixed
table, so their inverted index of prefixes goes to every task.

Base labels come from phrases whose words stand consecutively. Defined results: null and empty texts have no words,
no places and score 0; repeated rows are scanned each for itself; a text of any length is scanned whole; of blocks that
hold equal shares of a template the first is reported; other columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Container
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common

# Phrases of the base with their labels, and the wording of common notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]
THRESHOLD = 0.8
BLOCK_LINES = 3
#: Separators become blanks and A-Z small letters; line ends stay for the blocks.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]

    def need(self, threshold: float) -> int:
        """Least overlap that meets the threshold."""
        return math.ceil(threshold * len(self.words) - 1e-9)


def templates(table: list[tuple[str, str]] = TEMPLATES) -> list[Template]:
    return [Template(label, frozenset(text.encode().split())) for label, text in table]


def normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def blocks(lines: list[bytes], longest: int, known: Container[bytes], count: int = BLOCK_LINES):
    """(number of the first line, its words in `known`) of every block.

    A block that begins without such a word is left out: the next one holds all that it does.
    """
    at, sizes, sets = [], [], []
    for i, line in enumerate(lines):
        if words := line.split():
            at.append(i)
            sizes.append(len(words))
            sets.append(frozenset(w for w in words if w in known))
    total, end = [0, *accumulate(sizes)], 0
    for i in range(len(at)):
        while end < len(at) and (end < i + count or total[end] - total[i + 1] < longest):
            end += 1
        if sets[i]:
            yield at[i], frozenset().union(*sets[i:end])


class Index:
    """Inverted index of template prefixes under a global order of words."""

    def __init__(self, found: list[Template], frequency: dict[bytes, int], threshold: float):
        self.threshold, self.templates = threshold, found
        words = set().union(*(t.words for t in found))
        self.rank = {w: i for i, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.size, self.need = [], []
        for k, t in enumerate(found):
            need = t.need(threshold)
            self.size.append(len(t.words))
            self.need.append(need)
            for at, w in enumerate(sorted(t.words, key=self.rank.__getitem__)[: len(t.words) - need + 1]):
                self.prefix[w].append((k, at))
        self.first = frozenset(self.prefix)

    def matches(self, block: frozenset[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block holds to the threshold."""
        own = sorted(block & self.rank.keys(), key=self.rank.__getitem__)
        seen: dict[int, bool] = {}
        for at, w in enumerate(own):
            for k, place in self.prefix.get(w, ()):
                if k not in seen:  # the first shared word: nothing before it is shared
                    left = 1 + min(self.size[k] - place - 1, len(own) - at - 1)
                    seen[k] = len(block) >= self.need[k] and left >= self.need[k]
        out = []
        for k, possible in seen.items():
            if possible and (shared := len(self.templates[k].words & block)) >= self.need[k]:
                out.append((k, shared / self.size[k]))
        return out


def phrase_places(words: bytes, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(place of the first word, label) of every phrase in words that single blanks part."""
    padded, out = b" " + words + b" ", []
    for phrase, label in phrases.items():
        p = b" " + phrase.encode() + b" "
        at = padded.find(p)
        while at >= 0:
            out.append((padded.count(b" ", 0, at), label))
            at = padded.find(p, at + 1)
    return sorted(out)


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many lines of all documents each word of the templates stands."""

    def run(batch):
        counts: Counter[bytes] = Counter()
        for t in common.texts_of(batch):
            for line in normal(t).split(b"\n"):
                counts.update(vocabulary.intersection(line.split()))
        return common.rebatch(word=pa.array(list(counts), pa.binary()), n=pa.array(list(counts.values()), pa.int64()))

    counted = common.map_batches(common.doc_columns(docs), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}  # a row for each word of the templates at most


SCHEMA = "doc_id long, n_words long, places array<struct<word:long,label:string>>, found array<struct<label:string,template:int,line:long,containment:double>>"


def scan(docs: DataFrame, table: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, lines: int = BLOCK_LINES) -> DataFrame:
    """doc_id, n_words, places of phrases, and the best block (first line, containment) of each template found."""
    known = templates(table)
    index = Index(known, frequencies(docs, frozenset().union(*(t.words for t in known))), threshold)
    longest = max(len(text.split()) for _, text in table)
    places_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("line", pa.int64()), ("containment", pa.float64())]))

    def one(text: str):
        own = normal(text)
        words = own.split()
        best: dict[int, tuple[float, int]] = {}
        if not index.first.isdisjoint(words):
            for line, block in blocks(own.split(b"\n"), longest, index.rank, lines):
                if not index.first.isdisjoint(block):
                    for k, share in index.matches(block):
                        best[k] = max(best.get(k, (0.0, 0)), (share, -line))
        found = [{"label": known[k].label, "template": k, "line": -line, "containment": share} for k, (share, line) in sorted(best.items())]
        places = phrase_places(b" ".join(words)) if not index.first.isdisjoint(words) or _may_hold(own) else []
        return len(words), [{"word": w, "label": label} for w, label in places], found

    def run(batch):
        n, places, found = zip(*map(one, common.texts_of(batch)), strict=True)
        return common.rebatch(doc_id=batch.column(0), n_words=pa.array(n, pa.int64()), places=pa.array(places, places_type), found=pa.array(found, found_type))

    return common.map_batches(common.doc_columns(docs), run, SCHEMA)


_LAST_WORDS = [p.split()[-2].encode() for p in PHRASES]


def _may_hold(own: bytes) -> bool:
    """Cheap and lossless: a text that holds a phrase holds this word of it."""
    return any(w in own for w in _LAST_WORDS)


def _labels(*of):
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda s: s["label"]) for x in of]))), ",")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda s: s["word"])
    best = F.array_max(F.transform("found", lambda s: s["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("places")).alias("base_labels"),
        _labels(F.col("places"), F.col("found")).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
