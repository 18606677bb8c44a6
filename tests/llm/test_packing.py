import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkweave.llm import packing, tokens

from . import helpers


def plain(texts):
    tok = Tokenizer.from_file(tokens.default_vocabulary())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(docs):
    out = []
    for (doc, _), ids in zip(docs, plain(t for _, t in docs), strict=True):
        ids = ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            out.append((doc, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_query_equals_plain_tokenizing(spark):
    rows = packing.op1_best_fit_packing(spark, helpers.SF).collect()
    want = expected(helpers.documents())
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert gapless(rows) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_closing_signs_behind_letters_that_fall_apart():
    letters = [chr(c) for c in [0x130, *range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xA33, 0xA36, 0xB5C, 0xFB1D, 0xFB2A, 0xF43]]
    texts = [f"{x}{sign} a{x}{sign} b" for x in letters for sign in tokens.TAIL] + ["İ!", "e\u0301. e\u0301!", "a\u0301"]
    ids, counts = tokens.encoder().encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain(texts)


def test_odd_rows_and_sequences(spark):
    docs = helpers.odd(spark)
    rows = packing.packed(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected([(r[0], r[1]) for r in helpers.ODD]), key=key)
    gapless(rows)
    cut, placed = packing.pack_documents(docs)
    for r in packing.sequences(cut, placed).collect():
        assert r.n_tokens <= 2048 and len(r.ids) == 4 * r.n_tokens
    assert packing.packed(helpers.empty(spark)).count() == 0


def test_groups_are_packed_again(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 3000)
    cut = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    rows = packing.place(cut, group_pieces=300).collect()
    assert sorted(r.uid for r in rows) == list(range(3000))
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += int(sizes[r.uid])
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sizes.sum() // 2048) + 12


@pytest.mark.parametrize("seed", range(6))
def test_local_search_empties_bins(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(300, 1100, 200)
    bins = packing.Bins(sizes, 2048)
    for i in range(200):  # one bin an item: the search has all to do
        bins.members.append([i])
        bins.fill.append(int(sizes[i]))
    squared = sum(f * f for f in bins.fill)
    bins.local_search()
    used = [f for f in bins.fill if f]
    assert sorted(i for m in bins.members for i in m) == list(range(200))
    assert all(f == sum(int(sizes[i]) for i in m) <= 2048 for f, m in zip(bins.fill, bins.members, strict=True))
    assert sum(f * f for f in used) > squared and len(used) <= 1.12 * bins.fewest() + 1


@pytest.mark.parametrize("seed", range(4))
def test_every_step_raises_the_squared_fill(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    bins = packing.Bins(rng.integers(200, 1200, 300), 2048)
    bins.best_fit()
    seen, close = [], bins._close

    def watched(b):
        seen.append(sum(f * f for f in bins.fill))
        close(b)

    monkeypatch.setattr(bins, "_close", watched)
    bins.local_search()
    assert seen == sorted(seen) and seen[-1] > seen[0] and bins.steps["one_for_one"] > 0


def test_two_for_one():
    bins = packing.Bins(np.array([500, 400, 700, 1000]), 2048)
    bins.members, bins.fill = [[0, 1], [2, 3]], [900, 1700]
    assert bins._exchange(list(packing.pairs_of([0, 1], bins.size)), 0, "two_for_one") is None
    bins._open(1)
    kind, give, b, take = bins._exchange(list(packing.pairs_of([0, 1], bins.size)), bins.rooms, "two_for_one")
    assert (kind, sorted(give), b, take) == ("two_for_one", [0, 1], 1, [2])


def test_report(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(50, 1500, 3000)
    cut = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    rows = packing.report(cut, group_pieces=1000).collect()
    first = [r for r in rows if r.level == 0]
    assert sum(r.pieces for r in first) == 3000 and all(r.bins_after < r.bins_before and r.move + r.one_for_one + r.two_for_one > 0 for r in first)
