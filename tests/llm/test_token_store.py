import zlib

import numpy as np
import pytest

from linkweave.llm import common, token_store

from . import helpers
from .test_packing import plain


def test_query_equals_plain_tokenizing(spark):
    rows = token_store.op3_token_store(spark, helpers.SF).collect()
    docs, at, want = sorted(helpers.documents()), 0, []
    for (doc, _), ids in zip(docs, plain(t for _, t in docs), strict=True):
        ids = ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows)) == want


def test_odd_rows(spark):
    manifest = token_store.write(helpers.odd(spark), common.scratch(spark, "t"), shard_ids=100)
    assert manifest.count() > 1
    rows = sorted(token_store.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 5, 6, 7, 8, 8, 8, 9, 10, 11]
    ids = {(r[0], r[1]): i + [2] for r, i in zip(helpers.ODD, plain(r[1] for r in helpers.ODD), strict=True)}
    at = 0
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and got in [v for (d, _), v in ids.items() if d == r.doc_id]
        at += len(got)
    assert token_store.read(token_store.write(helpers.empty(spark), common.scratch(spark, "t"))).count() == 0


def test_starts_go_on_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_PARTS", 4)
    sizes = [(p, 10 * p + s) for p in (0, 1, 3, 4, 9, 17) for s in range(2)]
    got = {r.part: r.before for r in token_store.starts(spark.createDataFrame(sizes, "part int, n_tokens long")).collect()}
    assert got == {p: sum(n for q, n in sizes if q < p) for p, _ in sizes}


def test_repair_ends_only_when_no_pair_is_frequent():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 30000).clip(max=3000)
    seq, _, rules, _ = token_store.repair(ids, np.array([len(ids)]))
    pairs = np.unique((seq[:-1] << 32) | seq[1:], return_counts=True)[1]
    assert len(rules) > 100 and pairs.max() < 2 * token_store.LEAST_COUNT


@pytest.mark.parametrize("seed", range(5))
def test_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(0, rng.integers(1, 30), rng.integers(0, 400)), 2).astype(np.uint32) for _ in range(40)]
    docs += [np.array([3] * 500 + [2], np.uint32), np.array([2], np.uint32), np.array([70000, 2], np.uint32)]
    ids = np.concatenate(docs)
    data = token_store.to_bytes(list(range(len(docs))), ids, np.cumsum([len(d) for d in docs]), 17)
    shard = token_store.Shard(data)
    assert shard.start == 17 and len(shard.rules) > 10 and len(shard.symbols) < 0.8 * len(ids)
    for k, (own, all_) in enumerate(zip(docs, shard.documents(), strict=True)):
        assert own.tolist() == all_.tolist() == shard.document(k).tolist()
        a, b = sorted(rng.integers(0, len(own) + 1, 2))
        if a < b:
            assert shard.tokens(k, int(a), int(b)).tolist() == own[a:b].tolist()


@pytest.mark.parametrize("least", [2, 3, 16])
def test_repair_ends_on_runs_with_no_frequent_pair_left(least):
    rng = np.random.default_rng(least)
    for symbols in (1, 1, 2, 2, 3, 3):
        n = int(rng.integers(1, 600))
        ids = rng.integers(0, symbols, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n + 1, 4), n))
        seq, cuts, rules, base = token_store.repair(ids, ends, least)
        whole = []
        for left, right in rules.tolist():
            whole.append((whole[left - base] if left >= base else [left]) + (whole[right - base] if right >= base else [right]))
        assert [x for v in seq.tolist() for x in (whole[v - base] if v >= base else [v])] == ids.tolist()
        places: dict = {}
        for a, b in zip(np.append([0], cuts), cuts, strict=False):
            doc, skip = seq[a:b].tolist(), {}
            for k, pair in enumerate(zip(doc, doc[1:], strict=False)):
                if skip.get(pair) != k:
                    places[pair] = places.get(pair, 0) + 1
                    skip[pair] = k + 1
        assert max(places.values(), default=0) < least
