import zlib
from itertools import groupby, product

import numpy as np
import pytest

from linkweave.llm import toxicity as tox

from . import helpers

LATIN = "abcdefghijklmnopqrstuvwxyz"
WORDS = "the and idiot stupid trash house garden window moron clown better little people water summer letter".split()


@pytest.fixture(scope="module")
def model():
    counts = {}
    empty = tox.CharModel(LATIN, {})
    for w in WORDS:
        x = y = 0
        for k in [*map(empty.of, w), 0]:
            key = (x * empty.size + y) * empty.size + k
            counts[key] = counts.get(key, 0) + 50
            x, y = y, k
    return tox.CharModel(LATIN, counts)


def path_score(emits, costs, model):
    x = y = 0
    s, n = -sum(costs), model.size
    for c in "".join(emits):
        k = model.of(c)
        if k or y:
            s += model.logp[(x * n + y) * n + k]
            x, y = (y, k) if k else (0, 0)
    return s + (model.logp[(x * n + y) * n] if y else 0.0)


@pytest.mark.parametrize("token", ["1d10t", "tr4sh", "stuuupid", "m.o.r.o.n", "l3tt3r", "$ummer", "a-b", "c|own", "id1000t", "tt@@r"])
def test_viterbi_is_the_best_of_all_paths(token, model):
    options = [tox.channel(c, len(list(run))) for c, run in groupby(token)]
    best = max(path_score([e for e, _ in p], [c for _, c in p], model) for p in product(*options))
    read = tox.viterbi(token, model)
    ways = [path_score([e for e, _ in p], [c for _, c in p], model) for p in product(*options) if " ".join("".join(e for e, _ in p).split()) == read]
    assert ways and abs(max(ways) - best) < 1e-9


@pytest.mark.parametrize(("text", "want"), [
    ("You 1d10t go", "you idiot go"),
    ("such tr4sh.", "such trash"),
    ("stuuuupid M0RON", "stupid moron"),
    ("an i d i o t here", "an idiot here"),
    ("m.o.r.o.n and c-l-o-w-n", "moron and clown"),
    ("plain water, 2024 and 3 letters", "plain water, 2024 and 3 letters"),
])
def test_disguises_are_read(text, want, model):
    assert tox.Restorer(model).restore(text) == want


def test_buckets_stay_inside_words():
    assert set(tox.buckets("idiot")) == set(tox.buckets("... Idiot!".lower()))
    assert set(tox.buckets("an idiot")) == set(tox.buckets("idiot an"))
    assert len(tox.buckets("")) == len(tox.buckets("a b c d")) == 0


def test_learns_and_sees_through_disguises(spark):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(WORDS[5:8] + WORDS[10:] + ["the", "and"], 30))
        if i % 3 == 0:
            words[5] = str(rng.choice(["idiot", "stupid", "moron"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    hidden = [(1000, "the little house and the 1d10t garden"), (1001, "water and s t u p i d letter"), (1002, "the moooron and summer"), (1003, "the house and garden 2024")]
    rows = tox.score(spark.createDataFrame(docs + hidden, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].predicted for i in range(1000, 1004)] == [1, 1, 1, 0]
    out = [got[i] for i in range(900) if got[i].held_out]
    assert len(out) > 100 and all(r.predicted == (r.doc_id % 3 == 0) for r in out)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{sf}/labels.parquet")
    truth = dict(zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist(), strict=True))
    rows = [r for r in tox.op4_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    score, y = np.array([r.score for r in rows]), np.array([truth[r.doc_id] for r in rows])
    below = (score[y == 1][:, None] > score[y == 0][None, :]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()
    assert below > 0.93 and ((score >= 0.5) == y).mean() > 0.96


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 0), (8, 1), (8, 0), (9, None), (None, 1), (10, 1), (11, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0), labels.where("toxic = 1")):
        rows = tox.score(helpers.odd(spark), own).collect()
        assert len(rows) == len(helpers.ODD) and all(0 <= r.score <= 1 for r in rows)
    assert tox.score(helpers.empty(spark), labels).count() == 0
    assert sorted(r.text for r in tox.restored(helpers.odd(spark)).collect())[:2] == ["", ""]


@pytest.mark.parametrize(("text", "want"), [
    ("such a$$ and a55 here", "such ass and ass here"),
    ("cla55 of b455, sh!7.", "class of bass, shit."),
    ("p!55 ki11 poo£", "piss kill pool"),
    ("so naz! here", "so nazi here"),
    ("an a s s here", "an ass here"),
    ("house! trash!! water2024 1 2 3", "house! trash!! water2024 1 2 3"),
])
def test_signs_at_a_words_end_are_read(text, want):
    counts, empty = {}, tox.CharModel(LATIN, {})
    for w in [*WORDS, *"ass class bass shit piss kill pool nazi such of here so an a".split()]:
        x = y = 0
        for k in [*map(empty.of, w), 0]:
            key = (x * empty.size + y) * empty.size + k
            counts[key] = counts.get(key, 0) + 50
            x, y = y, k
    got = tox.Restorer(tox.CharModel(LATIN, counts)).restore(text)
    assert [w.strip(".,") for w in got.split()] == [w.strip(".,") for w in want.split()]


def test_prefilter_has_the_gates_signs():
    for c in tox.SIGNS:
        assert tox._BEFORE[ord(c)] and tox._BEHIND[ord(c)] and tox.SUSPECT.search(f"evi{c}") and tox.SUSPECT.search(f"{c}vil")
