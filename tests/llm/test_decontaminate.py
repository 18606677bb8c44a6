from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import decontaminate as dc
from linkweave.llm import simhash

from . import helpers


def brute(docs, items):
    """Every window of every item's size, its fingerprint and its weighted similarity."""
    known = [(k, simhash.shingle_hashes(t or "", 5).tolist()) for k, t in items if t]
    known = [(k, h) for k, h in known if h]
    df = Counter(x for _, h in known for x in set(h))
    total = sum(t is not None for _, t in items)
    weight = lambda x: np.log((total + 1) / (df.get(x, 0) + 1)) + 1
    out = {}
    for doc, text in docs:
        h = simhash.shingle_hashes(text or "", 5)
        for k, item in known:
            n = min(len(item), len(h))
            for s in range(len(h) - n + 1 if n else 0):
                w = h[s : s + n]
                a, b = Counter(w.tolist()), Counter(item)
                share = sum(min(a[x], b[x]) * weight(x) for x in a) / sum(max(a[x], b[x]) * weight(x) for x in a | b)
                d = (simhash.fingerprint(w) ^ simhash.fingerprint(np.array(item, np.uint64))).bit_count()
                if share >= 0.8 and d < dc.BLOCKS and share > out.get((doc, k), (0,))[0] + 1e-12:
                    out[doc, k] = (share, s, n + 4, d)
    return out


def sample():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(14, 40)))) for i in range(12)]
    items += [(50, None), (51, " "), (52, "only three words"), (53, items[0][1]), (54, "a a a a a a a a a a a a")]
    docs = []
    for i in range(40):
        words = list(rng.choice(vocabulary, rng.integers(0, 60)))
        own = items[i % 12][1].split()
        for _ in range(i // 14):
            own[int(rng.integers(len(own)))] = "changed"
        at = int(rng.integers(0, len(words) + 1))
        docs.append((i, " ".join(words[:at] + own + words[at:]) if i % 4 else " ".join(words)))
    docs += [(100, items[3][1].upper()), (101, " ".join(items[4][1].split()[:-2])), (102, "only three words"), (103, None), (104, "b a a a a a a a a a a a a a c")]
    return docs, items


def as_dict(rows):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_words, r.distance) for r in rows}


def test_equals_brute_force(spark):
    docs, items = sample()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {k: (round(v[0], 9), *v[1:]) for k, v in brute(docs, items).items()}
    assert len(want) > 12 and (101, 4) in want
    assert as_dict(dc.contaminated(df, bench).collect()) == want
    assert as_dict(dc.contaminated(df, bench, most=60).collect()) == want  # several passes
    kept = {r.doc_id for r in dc.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_query_finds_every_planted_passage(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{helpers.SF}/benchmark.parquet")
    items = list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    planted = {(d, k) for d, text in helpers.documents() for k, item in items if item in text}
    found = {(r.doc_id, r.item_id) for r in dc.op9_decontaminate(spark, helpers.SF).collect()}
    assert planted and planted <= found


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = dc.Items([(i, " ".join(rng.choice(list("abcdefghij"), 20))) for i in range(40)], {}, 40)
    for _ in range(300):
        k = int(rng.integers(40))
        fp = items.fps[k] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 16)), replace=False))
        assert k in items.near(int(items.size[k]), fp)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "twice the same row"), (1, "twice the same row"), (None, "no id here")], "item_id int, text string")
    docs = helpers.odd(spark).withColumn("item_id", F.lit(3))
    found = dc.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == {(8, 1): 4, (None, None): 1}
    assert dc.keep_clean(docs, bench).columns == docs.columns and dc.keep_clean(docs, bench).count() == len(helpers.ODD) - 3
    assert dc.contaminated(helpers.empty(spark), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.keep_clean(docs, bench.limit(0)).count() == len(helpers.ODD)


def test_far_fingerprints_are_no_miss():
    """Windows at 0.8 or more are found whatever their fingerprints' distance; brute force without a radius."""
    rng = np.random.default_rng(11)
    far = 0
    for size in (13, 40, 49, 94):
        texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, size))) for i in range(150)]
        items = dc.Items(texts, {}, len(texts))
        for k, text in texts:
            words, shingles = text.split(), size - 4
            cut = shingles - int(np.ceil(0.8 * shingles / 0.9)) if k % 2 else 0  # an end of other words on one side
            words = words[: size - cut] + [f"x{x}" for x in rng.integers(0, 10**6, cut)]
            h = simhash.shingle_hashes(" ".join(words), 5)
            item = simhash.shingle_hashes(text, 5)
            a, b = Counter(h.tolist()), Counter(item.tolist())
            share = (a & b).total() / (a | b).total()
            d = (simhash.fingerprint(h) ^ items.fps[k]).bit_count()
            found = {i: (s, dist) for i, _, _, s, dist in items.hits(" ".join(words))}
            assert (k in found) == (share >= 0.8)
            if k in found:
                assert abs(found[k][0] - share) < 1e-9 and found[k][1] == d
                far += d >= dc.BLOCKS
    assert far > 0
