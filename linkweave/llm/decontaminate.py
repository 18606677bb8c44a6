"""Operator 9, benchmark decontamination: item-sized windows, exact bounds of their overlap, exact similarity, SimHash distance.

Every item is its 5-word shingles with weights (rare among the items is heavy) and their SimHash. In a document each
run of as many shingles as an item has is a window. A window is a hit if the weighted Jaccard similarity of the
shingles, repeats included, is SIMILARITY or more; `distance` is that of the SimHashes.

Fingerprints do not choose the windows: at 0.8 some percent of them differ by more bits than any blocks find. Two exact
bounds do. A window at SIMILARITY holds that share of the item's weight, so it has one of the item's rarest shingles
that make up the rest (its prefix); items without one in the document are left out. For the others the weight of the
item's shingles in every window, from running sums, bounds its similarity; windows whose bound reaches SIMILARITY are
verified. The items' index goes to every task; its size is checked, and more than INDEX_SHINGLES shingles are taken in
several passes over the documents.

Defined results: null and empty texts have no hits, nor have items without words; items and texts of fewer than five
words are one shingle; of several windows for an item the most similar counts, the first of equals; repeated rows are
reported each for itself; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common
from linkweave.llm.simhash import fingerprint, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Blocks of four bits; all fingerprints within BLOCKS - 1 = 15 bits agree in one.
BLOCKS = 16
INDEX_SHINGLES = 500_000
#: What sums in another order may differ by.
SLACK = 1e-9


class Items:
    """The index of a set of items: shingles, weights, prefixes, and blocks of fingerprints by size."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[int, int], total: int, similarity: float = SIMILARITY, words: int = WORDS):
        self.words, self.similarity = words, similarity
        self.ids, self.counts, hashes, self.fps = [], [], [], []
        for item, text in items:
            h = shingle_hashes(text, words)
            if len(h):
                self.ids.append(item)
                self.counts.append(Counter(h.tolist()))
                hashes.append(h)
                self.fps.append(fingerprint(h))
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.rare = float(np.log(total + 1) + 1)
        self.weight = {h: float(np.log((total + 1) / (n + 1)) + 1) for h, n in frequency.items()}
        self.known_weight = np.array([self.weight.get(h, self.rare) for h in self.known.tolist()])
        self.mass = [sum(n * self.weight.get(h, self.rare) for h, n in c.items()) for c in self.counts]
        self.own = [np.unique(np.searchsorted(self.known, h)) for h in hashes]
        self.prefix: dict[int, list[int]] = {}
        for k, c in enumerate(self.counts):
            rest = self.mass[k]
            for h in sorted(c, key=lambda h: (-self.weight.get(h, self.rare), h)):
                if rest < similarity * self.mass[k] - SLACK:
                    break
                self.prefix.setdefault(int(np.searchsorted(self.known, np.uint64(h))), []).append(k)
                rest -= c[h] * self.weight.get(h, self.rare)
        self.heads = np.array(sorted(self.prefix), np.int64)
        self.blocks: dict[tuple[int, int, int], list[int]] = {}
        for k, (n, fp) in enumerate(zip(self.size.tolist(), self.fps, strict=True)):
            for b in range(BLOCKS):
                self.blocks.setdefault((n, b, fp >> (4 * b) & 15), []).append(k)

    def near(self, size: int, fp: int) -> list[int]:
        """Items of this size within the radius of a fingerprint; hits() does not rely on it."""
        found = {k for b in range(BLOCKS) for k in self.blocks.get((size, b, fp >> (4 * b) & 15), ())}
        return [k for k in found if (self.fps[k] ^ fp).bit_count() < BLOCKS]

    def similar(self, k: int, window: np.ndarray) -> float:
        counts = Counter(window.tolist())
        both = sum(min(n, self.counts[k].get(h, 0)) * self.weight.get(h, self.rare) for h, n in counts.items())
        mass = sum(n * self.weight.get(h, self.rare) for h, n in counts.items())
        return both / (mass + self.mass[k] - both)

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, starts, bounds) of the windows that may be similar enough; no window's similarity is above its bound."""
        if not len(h) or not len(self.known):
            return
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        places = np.flatnonzero(self.known[at] == h)
        if not len(places):
            return
        found = at[places]
        heads = np.intersect1d(found, self.heads)
        if not len(heads):
            return
        weights = np.full(len(h), self.rare)
        weights[places] = self.known_weight[found]
        mass = np.concatenate([[0.0], np.cumsum(weights)])
        for k in sorted({k for x in heads.tolist() for k in self.prefix[x]}):
            n = min(int(self.size[k]), len(h))
            own = places[np.isin(found, self.own[k])]
            shared = np.concatenate([[0.0], np.cumsum(weights[own])])
            starts = np.arange(max(0, int(own[0]) - n + 1), min(int(own[-1]), len(h) - n) + 1)
            both = shared[np.searchsorted(own, starts + n)] - shared[np.searchsorted(own, starts)]
            both = np.minimum(both, self.mass[k])
            bound = both / (mass[starts + n] - mass[starts] + self.mass[k] - both)
            keep = np.flatnonzero(bound >= self.similarity - SLACK)
            if len(keep):
                yield k, starts[keep], bound[keep]

    def hits(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of the best window for each item found in a text."""
        h = shingle_hashes(text or "", self.words)
        out = []
        for k, starts, bounds in self.candidates(h):
            n = min(int(self.size[k]), len(h))
            best: tuple[float, int, float] | None = None
            for i in np.argsort(-bounds, kind="stable").tolist():
                if best and bounds[i] < best[0] - SLACK:
                    break
                s = int(starts[i])
                share = self.similar(k, h[s : s + n])
                if share >= self.similarity and (best is None or (round(share, 12), -s) > best[:2]):
                    best = (round(share, 12), -s, share)
            if best:
                s = -best[1]
                out.append((k, s, n + self.words - 1, best[2], (self.fps[k] ^ fingerprint(h[s : s + n])).bit_count()))
        return out


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY, most: int = INDEX_SHINGLES) -> Iterator[Items]:
    """Indexes of all items, each of about `most` shingles at most; items are dealt to them by hash.

    The frequency of a shingle is the number of items with it, over all of them.
    """
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars, total = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    parts = max(1, -(-int(chars or 0) // (4 * most)))
    rows = common.materialize(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")), "items")

    def run(batch):
        found = [np.unique(shingle_hashes(t, WORDS)).view(np.int64) for t in common.texts_of(batch)]
        part = np.repeat(batch.column(2).to_numpy(), [len(x) for x in found])
        return common.rebatch(part=pa.array(part, pa.int32()), h=pa.array(np.concatenate(found)))

    shingles = common.materialize(common.map_batches(rows, run, "part int, h long"), "shingles")
    frequency = shingles.groupBy("h").agg(F.count("*").alias("n"))
    for k in range(parts):
        own = shingles.where(F.col("part") == k).select("h").distinct().join(frequency, "h").collect()
        items = rows.where(F.col("part") == k).collect()
        yield Items([(r["item_id"], r["text"]) for r in items], {r["h"] % (1 << 64): r["n"] for r in own}, int(total), similarity)


def _shared(docs: DataFrame, items: Items):
    return docs.sparkSession.sparkContext.broadcast(items)


def _hits_of(docs: DataFrame, items: Items) -> DataFrame:
    index = _shared(docs, items)

    def run(batch):
        own = index.value
        rows = [(doc, own.ids[k], *rest) for doc, t in zip(batch.column(0).to_pylist(), common.texts_of(batch), strict=True) for k, *rest in own.hits(t)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        names = ("doc_id", "item_id", "first_word", "n_words", "similarity", "distance")
        return common.rebatch(**{n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return common.map_batches(common.doc_columns(docs), run, "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most: int = INDEX_SHINGLES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity and distance of every item found in a row of `docs`."""
    benchmark = benchmark.withColumn("item_id", F.col("item_id").cast("long"))
    return reduce(DataFrame.unionByName, [_hits_of(docs, items) for items in indexes(benchmark, similarity, most)])


def _without(docs: DataFrame, items: Items) -> DataFrame:
    index = _shared(docs, items)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: not index.value.hits(t))

    return docs.where(clean(F.col("text").cast("string")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` in which no item is found, all columns kept."""
    return reduce(_without, indexes(benchmark, similarity), docs)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
