import numpy as np
import pytest
import xxhash

from linkweave.llm import components, simhash

from . import helpers


def brute_fp(text, words=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    n = len(fps)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        r = find(i)
        low[r] = min((v for v in (low.get(r), ids[i]) if v is not None), default=None)
    return [low[find(i)] for i in range(n)]


def check(rows, docs):
    fps = [brute_fp(t) for _, t in docs]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, brute_components([d for d, _ in docs], fps), strict=True)]
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], r[1], r[2]))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_query_equals_brute_force(spark):
    check(simhash.op8_simhash(spark, helpers.SF).collect(), helpers.documents())


def near_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = list(rng.choice(words, 400))
    out = []
    for i in range(60):
        t = base.copy()
        for at in rng.integers(0, 400, i % 9):
            t[at] = str(rng.choice(words))
        out.append((i, " ".join(t)))
    return out + [(100 + i, " ".join(rng.choice(words, 60))) for i in range(30)]


def test_odd_rows_and_near_copies(spark):
    fps = simhash.groups(helpers.odd(spark))
    check([(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in fps.collect()], [(r[0], r[1]) for r in helpers.ODD])
    docs = near_texts()
    rows = simhash.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check([(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in rows], docs)
    assert simhash.groups(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_are_whole_in_tiles_of_any_size(spark, tile):
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for s in seeds for n in range(7) for _ in range(12)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in simhash.signed(fps)], "node long, fp long")
    roots = {r.node: r.root for r in components.components(simhash.links_within(nodes, tile=tile)).collect()}
    want = brute_components(simhash.signed(fps).tolist(), fps)
    assert [roots.get(int(x), int(x)) for x in simhash.signed(fps)] == want


def test_masks_lose_no_pair():
    rng = np.random.default_rng(0)
    for n in (10, 10**6, 10**10):
        masks = simhash.block_masks(4, n)
        for _ in range(200):
            d = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            assert any(not d & m for m in masks)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t or "", 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_deduplicate_equals_brute_force(spark):
    docs = helpers.documents()
    own = spark.read.parquet(f"{helpers.SF}/documents.parquet")
    kept = simhash.deduplicate(own)
    assert kept.columns == own.columns
    up = {d: d for d, _ in docs}
    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if jaccard(s, t) >= 0.8:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up.values()))


def test_deduplicate_odd_rows(spark):
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.deduplicate(helpers.odd(spark)).collect())
    assert kept == sorted({(r[0] or 0, r[1] or "") for r in helpers.ODD if r[0] not in (6, 7)})
    assert simhash.deduplicate(helpers.empty(spark)).count() == 0
    near = [(i, t) for i, t in near_texts()]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert 0 in kept and set(range(100, 130)) <= kept and len(kept) == 31


def test_no_pair_of_short_texts_is_lost(spark):
    """Nine words and the first eight of them have Jaccard 0.8; those whose fingerprints are too far apart must meet too."""
    rng, far = np.random.default_rng(5), []
    while len(far) < 6:
        text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 9))
        a, b = (np.unique(simhash.shingle_hashes(t, 5)) for t in (text, text.rsplit(" ", 1)[0]))
        bits = (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() + (simhash.fingerprint(simhash._second(a)) ^ simhash.fingerprint(simhash._second(b))).bit_count()
        if bits > simhash.NEAR_RADIUS:
            far.append(text)
    docs = [(2 * i + k, t) for i, text in enumerate(far) for k, t in enumerate((text, text.rsplit(" ", 1)[0]))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()}
    assert kept == {2 * i for i in range(len(far))}


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        n = int(rng.integers(1, simhash.SMALL))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 60, int(rng.integers(0, 3))).astype(np.uint64)))
        if len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, 0.8), simhash.prefix(b, 0.8)))
