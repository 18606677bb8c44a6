"""Operator 8, SimHash near duplicates by tiled exact comparison.

A fingerprint's bit is 1 where over half of the shingles' hashes have it. Fingerprints are compared in tiles with
numpy: exclusive-or, bit count, radius; tiles are in order of population count and a pair of tiles whose counts
differ by more than the radius is skipped, since the Hamming distance is at least that difference.

Comparing all tiles with all would be quadratic. So tiles are formed inside buckets that lose no link: of B blocks of
the fingerprint, at most `radius` can differ, hence two linked fingerprints agree on some B - radius blocks. B grows
with the number of fingerprints, so that a bucket keeps its size. A bucket above TILE is split into tiles by
population count and hash, and each pair of its tiles within the radius is a unit of work of bounded size.

Units return a spanning forest of their links, never all pairs; `components` joins the forests.

`near_duplicates`, the pipeline's stage, asks for shingle similarity (Jaccard of sets of five words, 0.8 or more),
where fingerprints differ by some ten bits and no blocks of bits are shared. Its buckets are MIN_KEYS min-wise
shingle hashes instead (a pair at 0.8 shares none of them in 0.2 ** 4 = 0.16 % of cases), its tiles the same with a
radius of NEAR_RADIUS bits in two fingerprints together, and each candidate pair is verified by the shingle sets
themselves. At 0.8 two sets differ by 19.4 of the 128 bits, four standard deviations below that radius; unrelated
ones, of which a common passage brings many into one bucket, by 64, seven of them above it.

Sets of fewer than SMALL shingles differ by more bits than that often enough. They stand in buckets of their own as
well, without any comparison of bits: those of the shingles in their prefix, the smallest hashes that two sets at 0.8
cannot but share one of. So no pair of small sets is missed.

Defined results: null, empty and wordless texts have fingerprint zero; fewer words than a shingle are one shingle;
equal rows are one group; a null doc_id is larger than every other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import common
from linkweave.llm.components import components

SEED = 42
WORDS, RADIUS = 4, 4
NEAR_WORDS, NEAR_SIMILARITY, NEAR_RADIUS, MIN_KEYS = 5, 0.8, 36, 4
#: Sets of fewer shingles are compared without fingerprints.
SMALL = 16
#: Fingerprints in a tile, and in the squares inside a unit that are skipped or compared at once.
TILE, SQUARE = 4096, 256
#: Expected fingerprints in a bucket that the number of blocks is chosen for.
BUCKET = 256
#: Rows of one long that are broadcast at most; above, the join shuffles.
BROADCAST_ROWS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words (ASCII lower case, split at ASCII white space), in order, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.append([0], ends[:-1] + 1)
    k = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[:k].tolist(), ends[len(w) - k :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, k)


#: BITS[v] are the eight bits of byte v.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits, unsigned; counted through a histogram of each byte."""
    if not len(hashes):
        return 0
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: np.ndarray | list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def run(batch):
        fp = signed([fingerprint(shingle_hashes(t, words, seed)) for t in common.texts_of(batch)])
        return common.rebatch(doc_id=batch.column(0), fp=pa.array(fp))

    return common.map_batches(common.doc_columns(docs), run, "doc_id long, fp long")


def block_masks(radius: int, n: int) -> list[int]:
    """Masks of the blocks that linked fingerprints may agree on; fingerprints within `radius` agree under one of them."""
    blocks = radius + 1
    while blocks < radius + 6 and n >> (64 * (blocks - radius) // blocks) > BUCKET:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(kept) for kept in combinations(parts, blocks - radius)]


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_rows(nodes: DataFrame, radius: int) -> DataFrame:
    """node, fp, j and v: a row for every mask j, v the fingerprint under it."""
    masks = block_masks(radius, nodes.count())
    keys = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_as_long(m))).alias("v")) for j, m in enumerate(masks)])
    return nodes.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.j", "k.v")


def units(rows: DataFrame, radius: int, tile: int = TILE, lanes: tuple[str, ...] = ("fp",)) -> DataFrame:
    """`rows` with the column unit: buckets (j, v) of two rows or more, the large ones as pairs of tiles."""
    carried = [c for c in rows.columns if c not in ("j", "v")]
    sizes = common.materialize(rows.groupBy("j", "v").count().where("count > 1"), "buckets")
    large = sizes.where(F.col("count") > tile).select("j", "v")
    small = rows.join(sizes.where(F.col("count") <= tile).select("j", "v"), ["j", "v"], "left_semi").withColumn("unit", F.lit(""))
    if not large.head(1):
        return small
    pop = sum((F.bit_count(c) for c in lanes[1:]), F.bit_count(lanes[0]))
    big = rows.join(large, ["j", "v"], "left_semi").withColumn("p", pop)
    tiles = big.groupBy("j", "v", "p").count().select("j", "v", "p", F.ceil(F.col("count") / tile).cast("int").alias("n"))
    tiles = common.materialize(tiles, "tiles")
    other = tiles.select("j", "v", F.col("p").alias("p2"), F.col("n").alias("n2"))
    near = tiles.join(other, ["j", "v"]).where(F.abs(F.col("p") - F.col("p2")) <= radius)
    partners = near.groupBy("j", "v", "p").agg(F.first("n").alias("n"), F.collect_list(F.struct("p2", "n2")).alias("o"))
    dealt = big.join(partners, ["j", "v", "p"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    to = F.flatten(F.transform("o", lambda o: F.transform(F.sequence(F.lit(0), o["n2"] - 1), lambda c: F.struct(o["p2"].alias("p"), c.alias("c")))))
    dealt = dealt.select("j", "v", *carried, F.struct("p", "c").alias("own"), F.explode(to).alias("to"))
    lo, hi = F.least("own", "to"), F.greatest("own", "to")
    name = F.concat_ws(":", lo["p"], lo["c"], hi["p"], hi["c"])
    return small.unionByName(dealt.select("j", "v", *carried, name.alias("unit")))


class Forest:
    """Union-find over 0..n-1, many links at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.up[a], self.up[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            ra, rb = ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.up != (up := self.up[self.up])).any():
                self.up = up


class Prints:
    """Fingerprints of one or more lanes of 64 bits, and sizes whose ratio must not fall below `least`."""

    def __init__(self, lanes: list[np.ndarray], radius: int, sizes: np.ndarray | None = None, least: float = 0.0):
        self.lanes, self.radius, self.sizes, self.least = lanes, radius, sizes, least

    def __len__(self) -> int:
        return len(self.lanes[0])

    def take(self, at) -> Prints:
        return Prints([x[at] for x in self.lanes], self.radius, None if self.sizes is None else self.sizes[at], self.least)

    def population(self) -> np.ndarray:
        return sum(np.bitwise_count(x).astype(np.int64) for x in self.lanes)

    def close(self, a, b) -> np.ndarray:
        """Whether prints at places (or slices, broadcast) a and b are within the radius."""
        apart = np.bitwise_count(self.lanes[0][a] ^ self.lanes[0][b])
        for x in self.lanes[1:]:
            apart = apart + np.bitwise_count(x[a] ^ x[b])
        near = apart <= self.radius
        if self.sizes is not None:
            m, n = self.sizes[a], self.sizes[b]
            near &= np.minimum(m, n) >= self.least * np.maximum(m, n)
        return near


def close_pairs(prints: Prints):
    """Places (a, b) of close fingerprints, square by square; they are in order of population count."""
    pop, n = prints.population(), len(prints)
    for s in range(0, n, SQUARE):
        e = min(n, s + SQUARE)
        rows = np.arange(s, e)[:, None]
        for t in range(s, n, SQUARE):
            if pop[t] - pop[e - 1] > prints.radius:
                break
            a, b = np.nonzero(prints.close(rows, np.arange(t, min(n, t + SQUARE))[None, :]))
            a, b = a + s, b + t
            if len(a := a[keep := a < b]):
                yield a, b[keep]


def _forest_of(prints: Prints) -> np.ndarray:
    """Root of each place within one unit; the root is a place."""
    order = np.argsort(prints.population(), kind="stable")
    forest = Forest(len(prints))
    for a, b in close_pairs(prints.take(order)):
        forest.join(a, b)
    out = np.empty(len(prints), np.int64)
    out[order] = order[forest.up]
    return out


def unit_roots(key: np.ndarray, prints: Prints, small: int = 48) -> np.ndarray:
    """Root of every row within its unit; `key` numbers the units, rows of a unit stand together."""
    starts = np.flatnonzero(np.append([True], key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    root = np.arange(len(key))
    at = np.flatnonzero(np.repeat(sizes <= small, sizes))
    k, own = key[at], prints.take(at)
    found = []
    for d in range(1, int(sizes[sizes <= small].max(initial=1))):  # all units of few rows at once
        hit = np.flatnonzero((k[d:] == k[:-d]) & own.close(slice(d, None), slice(None, -d)))
        found.append((at[hit], at[hit + d]))
    if found:
        forest = Forest(len(key))
        forest.join(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        root = forest.up
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        root[s : s + n] = s + _forest_of(prints.take(slice(s, s + n)))
    return root


def by_unit(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(table) over runs of whole units; a unit's rows stand together and are never split between calls."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = {k: t.column(k)[-1].as_py() for k in keys}
            same = np.ones(t.num_rows, bool)
            for k, v in last.items():
                same &= np.array(t.column(k).to_pylist(), object) == v
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            held = t.slice(cut)
            if cut:
                yield from fn(t.slice(0, cut))
        if held is not None and held.num_rows:
            yield from fn(held)
        common.release()

    return dealt.mapInArrow(run, schema)


def _numbered(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of the unit of each row."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        col = t.column(k).to_pylist()
        new[1:] |= np.fromiter((x != y for x, y in zip(col[1:], col[:-1], strict=True)), bool, t.num_rows - 1)
    return np.cumsum(new)


UNIT = ["j", "v", "unit"]


def links_within(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span all fingerprints of `nodes` (node, fp; fp distinct) within the radius."""

    def run(t: pa.Table):
        node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        root = unit_roots(_numbered(t, UNIT), Prints([fp], radius))
        at = np.flatnonzero(root != np.arange(len(root)))
        if len(at):
            yield common.rebatch(a=pa.array(node[at]), b=pa.array(node[root[at]]))

    return by_unit(units(block_rows(nodes, radius), radius, tile), UNIT, run, "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links within the radius) of every row."""
    fps = common.materialize(fingerprints(docs, words, seed), "fingerprints")
    nodes = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("node"), "fp", "least"), "nodes")
    roots = components(links_within(nodes.select("node", "fp"), radius))
    rooted = nodes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def few_or_shuffled(rows: DataFrame) -> DataFrame:
    """`rows` (one long) for the small side of a join: broadcast if its count allows, else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


LANES = ("fp", "fp2")


def _second(h: np.ndarray) -> np.ndarray:
    """Hashes for another fingerprint of the same shingles."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix(h: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest of a set's hashes (`h`, in order) of which any set that is similar enough has one in its own prefix."""
    return h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def _signatures(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """uid, doc_id, key (of the set of shingles), fingerprints, size, min-wise hashes and a small set's prefix of every row of `rows` (uid, doc_id, text)."""

    def run(batch):
        keys, fps, seconds, sizes, mins, heads = [], [], [], [], [], []
        for t in common.texts_of(batch):
            h = np.unique(shingle_hashes(t, words))
            keys.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()))
            fps.append(fingerprint(h))
            seconds.append(fingerprint(_second(h)))
            sizes.append(len(h))
            mins.append(signed((h[:, None] * _ODD[None, :MIN_KEYS]).min(axis=0)) if len(h) else np.zeros(MIN_KEYS, np.int64))
            heads.append(signed(prefix(h, similarity)).tolist() if 0 < len(h) < SMALL else [])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mins) + 1) * MIN_KEYS, pa.int32()), pa.array(np.concatenate(mins)))
        return common.rebatch(uid=batch.column(2), doc_id=batch.column(0), key=pa.array(keys, pa.binary()), fp=pa.array(signed(fps)), fp2=pa.array(signed(seconds)), size=pa.array(sizes, pa.int64()), mins=lists, heads=pa.array(heads, pa.list_(pa.int64())))

    return common.map_batches(rows, run, "uid long, doc_id long, key binary, fp long, fp2 long, size long, mins array<long>, heads array<long>")


def _prints(t: pa.Table, radius: int, similarity: float) -> Prints:
    return Prints([t.column(c).to_numpy().view(np.uint64) for c in LANES], radius, t.column("size").to_numpy(), similarity)


def _spanned(prints: Prints, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root of each place within one unit by verified links; a pair that is joined already is not verified again."""
    order = np.argsort(prints.population(), kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    flat, starts = np.concatenate([sets[i] for i in order]), np.cumsum(sizes) - sizes
    _, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    forest = Forest(len(order))
    for a, b in close_pairs(prints.take(order)):
        for x in np.unique(a).tolist():
            y = b[a == x]
            y = y[forest.up[y] != forest.up[x]]
            if not len(y):
                continue
            own = flat[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            lens = sizes[y]
            ends = np.cumsum(lens)
            shared = mark[flat[np.repeat(starts[y] - (ends - lens), lens) + np.arange(int(ends[-1]))]]
            both = np.add.reduceat(shared.astype(np.int64), ends - lens)
            mark[own] = False
            y = y[both >= similarity * (sizes[x] + lens - both)]
            forest.join(np.full(len(y), x), y)
    out = np.empty(len(order), np.int64)
    out[order] = order[forest.up]
    return out


def _verified(candidates: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links between rows of a unit (keys UNIT and part) whose shingle sets are similar enough."""

    def run(t: pa.Table):
        key = _numbered(t, [*UNIT, "part"])
        node, prints = t.column("node").to_numpy(), _prints(t, radius, similarity)
        sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        starts = np.append(np.flatnonzero(np.append([True], key[1:] != key[:-1])), len(key))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            root = _spanned(prints.take(slice(s, e)), sets[s:e], similarity)
            at = np.flatnonzero(root != np.arange(e - s))
            if len(at):
                yield common.rebatch(a=pa.array(node[s + at]), b=pa.array(node[s + root[at]]))

    return by_unit(candidates, [*UNIT, "part"], run, "a long, b long")


def _candidates(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Rows of `rows` (node, LANES, size, j, v) with a close one in their unit, and their part of it."""

    def run(t: pa.Table):
        node = t.column("node").to_numpy()
        root = unit_roots(_numbered(t, UNIT), _prints(t, radius, similarity))
        at = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        if len(at):
            yield common.rebatch(**{k: t.column(k).take(pa.array(at)).combine_chunks() for k in (*UNIT, "node", *LANES, "size")}, part=pa.array(node[root[at]]))

    return by_unit(units(rows, radius, lanes=LANES), UNIT, run, "j int, v long, unit string, node long, fp long, fp2 long, size long, part long")


def near_duplicates(rows: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """uid, root: for every row of `rows` (doc_id, text, uid), the uid of the row that stays for its group.

    Groups are the components of links at `similarity` or more; the row with the smallest doc_id stays, of these the
    one with the smallest uid.
    """
    rows = rows.select("doc_id", "text", "uid")
    sig = common.materialize(_signatures(rows, words, similarity), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("best")
    same = [F.min(c).alias(c) for c in (*LANES, "size", "mins", "heads")]  # equal for equal sets
    nodes = common.materialize(sig.groupBy("key").agg(F.min("uid").alias("node"), *same, best), "nodes")
    keyed = nodes.select("node", *LANES, "size", F.posexplode("mins").alias("j", "v"))
    blind = nodes.select("node", *[F.lit(0).cast("long").alias(c) for c in LANES], "size", F.lit(MIN_KEYS).alias("j"), F.explode("heads").alias("v"))
    keyed = keyed.unionByName(blind)
    candidates = common.materialize(_candidates(keyed, NEAR_RADIUS, similarity), "candidates")
    wanted = few_or_shuffled(candidates.select(F.col("node").alias("uid")).distinct())

    def sets(batch):
        h = [np.unique(shingle_hashes(t, words)).astype("<u8").tobytes() for t in common.texts_of(batch)]
        return common.rebatch(node=batch.column(batch.schema.get_field_index("uid")), shingles=pa.array(h, pa.binary()))

    shingles = common.map_batches(rows.join(wanted, "uid", "left_semi"), sets, "node long, shingles binary")
    links = _verified(candidates.join(shingles, "node"), similarity, NEAR_RADIUS)
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("key", "best", F.coalesce("root", "node").alias("c"))
    stays = rooted.groupBy("c").agg(F.min("best").alias("best")).select("c", F.col("best.uid").alias("root"))
    of_key = rooted.join(stays, "c").select("key", "root")
    return sig.select("uid", "key").join(of_key, "key").select("uid", "root")


def deduplicate(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay: one of each group of near duplicates, all columns kept."""
    kept = docs.columns
    uid = "__linkweave_uid"
    own = common.materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(uid).alias("uid"))
    gone = common.materialize(near_duplicates(rows, words, similarity).where("uid <> root").select(F.col("uid").alias(uid)), "dropped")
    return own.join(few_or_shuffled(gone), uid, "left_anti").select(*[F.col(f"`{c}`") for c in kept])
