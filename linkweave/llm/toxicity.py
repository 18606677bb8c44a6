"""Operator 4, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Language model: the words of all documents are counted, and from them the trigrams of characters (the ALPHABET most
frequent letters, one class for the rest, word ends). Channel: a token that shows signs of disguise becomes a lattice;
each run of a character may stand for itself, for letters it is used for (leetspeak), for fewer copies (repetition),
for nothing or for a word's end (separators), each at a cost. Viterbi finds the best path under the model. Letters
spelled with blanks between are read as one token. A token without such signs has one path only and stays as it is.

Score: windows of 5 and 6 characters inside the words of the restored text (a word's end may be first or last) are
hashed to 2 ** BITS buckets. Over all labelled rows the documents of either label that hold a bucket are counted;
buckets that significantly favour the toxic label get their log odds as weight. A logistic regression on a document's
largest weight and sums of weights gives the score; it is fitted on at most SAMPLE labelled rows, numbers only.
Rows whose crc32(doc_id) mod 5 is 0 are held out: nothing is learned from their labels. Inputs of a score are the
text alone.

Defined results: null and empty texts get the score of a text without weights; a null doc_id is held out; a doc_id
with several labels is toxic if one of them says so; without labels of both kinds the score is the share of toxic
labels (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common, simhash

FOLDS = 5
ALPHABET = 62
BITS, SIZES = 18, (5, 6)
#: A bucket counts if its documents favour the toxic label by so many standard errors, and so many hold it.
LEAST_Z, LEAST_DOCS = 4.0, 3
#: Labelled rows that the logistic regression is fitted on at most, by the smallest hash of their doc_id.
SAMPLE = 50_000
#: Words counted in a task before they are sent on, and restored tokens kept by a worker.
WORDS_HELD, TOKENS_KEPT = 200_000, 200_000

# Characters used for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l"}
SEPARATORS = ".-_*~^'"
#: Costs of the channel, in natural logarithms.
SUBSTITUTE, DROP, JOIN, BREAK, REPEAT, DOUBLE = 1.0, 3.0, 0.5, 2.0, 0.3, 2.5

#: Signs that stand for letters, and those that may also stand between letters.
SIGNS, BETWEEN = "0123456789@$!|+€£", "*._~^-"
_L = r"[^\W\d_]"
SUSPECT = re.compile(rf"{_L}[{SIGNS}{BETWEEN}]+{_L}|^[{SIGNS}]+{_L}|{_L}[{SIGNS}]+$|({_L})\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .*_-]{1,2}){2,}[^\W_](?![^\s.,!?;:])")
CLOSING = re.compile(r"(!+|[0-9]{4,})$")
WORD = re.compile(rf"{_L}+")


class CharModel:
    """Trigram model over letters; index 0 is a word's end, the last one any other character."""

    def __init__(self, letters: str, counts: dict[int, int]):
        self.letters, self.size = letters, len(letters) + 2
        self.index = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        n = self.size
        c3 = np.zeros(n**3)
        for k, v in counts.items():
            c3[k] += v
        c3 = c3.reshape(n, n, n)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + n)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
        logp = np.log(p3).ravel()
        self.logp = logp.tolist()
        #: Of all the model's values, to tell models apart.
        self.digest = hashlib.sha256(letters.encode() + logp.tobytes()).hexdigest()

    def of(self, c: str) -> int:
        return self.index.get(c, self.size - 1)


def channel(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n copies of c may have been written for, with costs."""
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLE)] if n == 2 else [(c, REPEAT), (c + c, REPEAT)]
    if c in LEET:
        out = [(x, SUBSTITUTE) for x in LEET[c]] + [("", DROP), (" ", BREAK)]
        return out + ([(x + x, SUBSTITUTE) for x in LEET[c]] if n > 1 else [])
    if c in SEPARATORS:
        return [("", JOIN), (" ", BREAK)]
    return [(" ", 0.0)]


def best_path(token: str, model: CharModel) -> tuple[float, str]:
    """Score and text of the most likely reading of a token's lattice."""
    n, logp, of = model.size, model.logp, model.of
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, run in groupby(token):
        options = [(emit, cost, [of(e) for e in emit]) for emit, cost in channel(c, sum(1 for _ in run))]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for emit, cost, places in options:
                x, y, s = a, b, score - cost
                for k in places:
                    if k or y:  # one word's end is as good as many
                        s += logp[(x * n + y) * n + k]
                        x, y = (y, k) if k else (0, 0)
                old = after.get((x, y))
                if old is None or s > old[0]:
                    after[x, y] = (s, (path, emit) if emit else path)
        states = after
    ends = [(s + (logp[(a * n + b) * n] if b else 0.0), path) for (a, b), (s, path) in states.items()]
    best, path = max(ends, key=lambda e: e[0])
    out = []
    while path is not None:
        path, emit = path
        out.append(emit)
    return best, " ".join("".join(reversed(out)).split())


def viterbi(token: str, model: CharModel) -> str:
    """The most likely reading of a token's lattice."""
    return best_path(token, model)[1]


def plain_path(word: str, model: CharModel) -> float:
    """Score of a word as it is written."""
    n, s, x, y = model.size, 0.0, 0, 0
    for k in [*map(model.of, word), 0]:
        s += model.logp[(x * n + y) * n + k]
        x, y = y, k
    return s


#: Classes of the characters up to U+FFFF: letters, digits or letters, signs of SUSPECT before a letter, and behind one.
_ALPHA = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
_ALNUM = np.fromiter((chr(i).isalnum() for i in range(1 << 16)), bool, 1 << 16)
_BEFORE, _BEHIND = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
_BEFORE[[ord(c) for c in SIGNS + BETWEEN]] = True
_BEHIND[[ord(c) for c in SIGNS]] = True


def codes(text: str) -> np.ndarray:
    """Code points with a blank at either end; those above U+FFFF count as U+FFFF."""
    return np.minimum(np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)


class Restorer:
    """restore(text): lower case, with disguised tokens read through the channel; keeps what it has read.

    Where a disguise may be is found by classes of neighbouring characters; only the tokens there are looked at.
    """

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def token(self, w: str) -> str | None:
        """The reading of a token, or None if it stays."""
        if w not in self.known:
            if len(self.known) > TOKENS_KEPT:
                self.known.clear()
            core = w.strip(".,;:?()[]{}\"'“”«»")
            self.known[w] = self.reading(core) if SUSPECT.search(core) else None
        return self.known[w]

    def reading(self, core: str) -> str | None:
        """The most likely reading; exclamation marks at the end may be punctuation, four digits or more a number."""
        tail = CLOSING.search(core)
        if tail is None or not tail.start():
            return viterbi(core, self.model)
        bare = core[: tail.start()]
        score, read = best_path(core, self.model)
        if SUSPECT.search(bare):
            other, own = best_path(bare, self.model)
        else:
            other, own = plain_path(bare, self.model), None
        return read if score > other - (0.0 if core[-1] == "!" else BREAK) else own

    def spelled(self, m: re.Match) -> str:
        """Letters spelled with signs between as one token; three digits stay."""
        token = re.sub(r"[ .*_-]", "", m[0])
        return m[0] if len(token) < 4 and token.isdigit() else viterbi(token, self.model)

    def restore(self, text: str) -> str:
        text = text.lower()
        code = codes(text)
        single = _ALNUM[code]
        alone = np.flatnonzero(single[1:-1] & ~single[:-2] & ~single[2:])
        if len(alone) > 2 and (alone[2:] - alone[:-2] <= 6).any():  # three characters, each with one or two signs between
            text = SPACED.sub(self.spelled, text)
            code = codes(text)
        letter = _ALPHA[code]
        sign = (_BEFORE[code[:-1]] & letter[1:]) | (letter[:-1] & _BEHIND[code[1:]])
        sign[:-1] |= (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:]) & letter[:-2]
        places = np.flatnonzero(sign)
        if not len(places):
            return text
        blank = np.array([True, *map(str.isspace, text), True])
        ends = np.flatnonzero(blank)
        right = np.searchsorted(ends, places, "right")
        spans = {(int(ends[r - 1]), int(ends[r])) for r in right.tolist()}
        found = {text[a : b - 1] for a, b in spans}
        changed = {w: r for w in found if (r := self.token(w)) is not None}
        return " ".join([changed.get(w, w) for w in text.split()]) if changed else text


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(SIZES))]


def windows(text: str) -> np.ndarray:
    """The bucket of each window of a restored text."""
    code = codes(text)
    letter = _ALPHA[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    gaps = np.append([0], np.cumsum(~letter))
    found = [np.zeros(0, np.uint64)]
    for size in SIZES:
        n = len(code) - size + 1
        if n < 1:
            continue
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h += code[k : k + n] * _POWERS[k]
        h = h[gaps[size - 1 : size - 1 + n] == gaps[1 : n + 1]]
        found.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64)


def buckets(text: str) -> np.ndarray:
    """Distinct buckets of a restored text's windows."""
    return np.unique(windows(text))


def count_words(docs: DataFrame) -> DataFrame:
    """word and n: how often each word of letters stands in all documents."""

    def run(batches):
        held: Counter[str] = Counter()

        def out():
            return common.rebatch(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

        for b in common.sliced(batches):
            for t in common.texts_of(b):
                held.update(WORD.findall(t.lower()))
                if len(held) > WORDS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = common.doc_columns(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> CharModel:
    """The model of all documents; what comes to the driver is ALPHABET letters and a table of their trigrams."""
    words = common.materialize(count_words(docs), "words")
    letters = words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    top = "".join(r["c"] for r in letters.orderBy(F.desc("n"), "c").limit(ALPHABET).collect() if len(r["c"]) == 1)
    empty = CharModel(top, {})
    of, size = empty.index, empty.size

    def run(batches):
        held: Counter[int] = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = y = 0
                for k in [*[of.get(c, size - 1) for c in w], 0]:
                    held[(x * size + y) * size + k] += n
                    x, y = y, k
        if held:
            yield common.rebatch(k=pa.array(list(held), pa.int64()), n=pa.array(list(held.values()), pa.int64()))

    counts = words.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return CharModel(top, {r["k"]: r["n"] for r in counts.collect()})


_restorers: dict[str, tuple[CharModel, Restorer]] = {}


def restorer(model: CharModel) -> Restorer:
    """One for each worker and model."""
    key = model.digest
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = (model, Restorer(model))
    return _restorers[key][1]


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels that may be learned from."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") != 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def bucket_weights(docs: DataFrame, train: DataFrame, model: CharModel) -> np.ndarray | None:
    """The weight of every bucket, from all labelled rows; None if a label is missing."""
    rows = common.doc_columns(docs).join(F.broadcast(train) if train.count() <= simhash.BROADCAST_ROWS else train, "doc_id")

    def run(batches):
        counts, totals = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in common.sliced(batches):
            own = restorer(model)
            for t, y in zip(common.texts_of(b), b.column(2).to_pylist(), strict=True):
                counts[y, buckets(own.restore(t))] += 1
                totals[y] += 1
        at = np.flatnonzero(counts.any(axis=0))
        if totals.any():
            yield common.rebatch(k=pa.array(np.append(at, -1)), bad=pa.array(np.append(counts[1, at], totals[1])), good=pa.array(np.append(counts[0, at], totals[0])))

    summed = rows.select("doc_id", "text", "toxic").mapInArrow(run, "k long, bad long, good long").groupBy("k").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = np.zeros((2, (1 << BITS) + 1))  # the last one has the totals
    for r in summed.collect():  # 2 ** BITS rows at most
        counts[:, r["k"]] = r["good"], r["bad"]
    (n_good, n_bad), (good, bad) = counts[:, -1], counts[:, :-1]
    if not n_good or not n_bad:
        return None
    rate = (good + bad) / (n_good + n_bad)
    z = (bad / n_bad - good / n_good) / np.sqrt(np.maximum(rate * (1 - rate) * (1 / n_good + 1 / n_bad), 1e-12))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return np.where((z >= LEAST_Z) & (bad >= LEAST_DOCS), odds, 0.0).astype(np.float32)


FEATURES = ("top", "total", "density")


def evidence(docs: DataFrame, model: CharModel, weights: np.ndarray) -> DataFrame:
    """doc_id, restored text's evidence (FEATURES) and how many tokens were read anew, of every row."""

    def one(text: str) -> tuple[float, ...]:
        at = windows(restorer(model).restore(text))
        w = weights[np.unique(at[weights[at] > 0])]
        total = float(w.sum())
        return float(w.max(initial=0.0)), math.log1p(total), total / math.sqrt(1 + len(at))

    def run(batch):
        found = np.array([one(t) for t in common.texts_of(batch)])
        return common.rebatch(doc_id=batch.column(0), **{f: pa.array(found[:, k]) for k, f in enumerate(FEATURES)})

    return common.map_batches(common.doc_columns(docs), run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_logistic(x: np.ndarray, y: np.ndarray, copies: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method; a row counts `copies` times."""
    copies = np.ones(len(y)) if copies is None else copies
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (copies * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (copies * (y - p)) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    train = common.materialize(labelled(labels), "labels")
    out = common.doc_columns(docs).select("doc_id")
    model = char_model(docs)
    weights = bucket_weights(docs, train, model)
    if weights is None:
        share = train.join(out.distinct(), "doc_id").agg(F.avg("toxic")).first()[0] or 0.0
        scored = out.withColumn("score", F.lit(float(share)))
    else:
        found = common.materialize(evidence(docs, model, weights), "evidence")
        both = found.join(F.broadcast(train) if train.count() <= simhash.BROADCAST_ROWS else train, "doc_id")
        rows = np.array([list(map(float, r)) for r in common.sample_rows(both.select(*FEATURES, "toxic"), sample)])
        w = fit_logistic(rows[:, :-2], rows[:, -2], rows[:, -1])
        logit = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w, strict=False)), F.lit(float(w[-1])))
        scored = found.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), *FEATURES)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame) -> DataFrame:
    """doc_id and the restored text of every row."""
    model = char_model(docs)

    def run(batch):
        own = restorer(model)
        return common.rebatch(doc_id=batch.column(0), text=pa.array([own.restore(t) for t in common.texts_of(batch)], pa.string()))

    return common.map_batches(common.doc_columns(docs), run, "doc_id long, text string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
