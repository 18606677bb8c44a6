"""Operator 3, token-ID output: shards compressed by Re-Pair, with rules and expansion lengths for random access.

Documents go to partitions by ranges of doc_id, so that shards in order of their number hold the ids in ascending
doc_id order. In a shard the frequent id pairs are replaced by nonterminals, many pairs that do not overlap in one
round, round after round until no pair is frequent or the rules are used up. Pairs never reach over a document's
end, so a document is a run of symbols and can be decoded alone; expansion lengths find a token inside it.

A shard file, little-endian: magic `LWRP`, version u32, base u32 (first nonterminal), rules u32, documents u32,
symbol width in bytes u32, symbols u64, start u64 (its place in its partition's ids); then rule pairs (2 x u32),
expansion lengths (u32), doc_ids (i64) with a flag for null (u8), symbol offsets (u64, documents + 1), and symbols.

Defined results: null or empty text is the end id alone; a null doc_id comes first; equal doc_ids are in order of
their text's hash, equal rows next to each other; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm import common, tokens

END_ID = 2
MAGIC = b"LWRP"
HEAD = struct.Struct("<4sIIIIIQQ")
#: A shard closes once it has this many ids; a longer document has a shard of its own.
SHARD_IDS = 1_000_000
#: Bytes of the table, as stored, that a partition gets, about.
PARTITION_BYTES = 12_000_000
#: Partitions whose sizes are summed in one task.
BLOCK_PARTS = 2048
#: A pair is replaced if the shard holds it this often.
LEAST_COUNT = 16
#: Nonterminals keep below 2 ** 16 where the ids do, so that a symbol takes two bytes.
NARROW = 1 << 16
#: Buckets that pairs are counted and looked up through, as a power of two.
BUCKETS = 18


class _Pairs:
    """The sequence as a linked list, with the pair that begins at each symbol and how full each bucket of pairs is."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.seq = np.append(ids.astype(np.int64), 0)
        self.next = np.arange(1, n + 2)
        self.prev = np.arange(-1, n)
        self.last = np.zeros(n + 1, bool)  # of a document; the place behind all counts as one
        self.last[np.asarray(ends, np.int64) - 1] = True
        self.last[n] = True
        self.alive = np.ones(n + 1, bool)
        self.alive[n] = False
        self.key = np.full(n + 1, -1, np.int64)
        self.bucket = np.full(n + 1, 1 << BUCKETS, np.int32)  # the bucket behind all holds no pair
        self.full = np.zeros((1 << BUCKETS) + 1, np.int64)
        self.fresh = np.zeros((1 << BUCKETS) + 1, bool)  # buckets that grew since they were found without a frequent pair
        self._set(np.arange(n))

    def _set(self, at: np.ndarray) -> None:
        """Pairs that begin at these symbols, and their buckets."""
        at = at[~self.last[at]]
        self.key[at] = (self.seq[at] << 32) | self.seq[self.next[at]]
        self.bucket[at] = ((self.key[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int32)
        self.full += np.bincount(self.bucket[at], minlength=len(self.full))
        self.fresh[self.bucket[at]] = True

    def _unset(self, at: np.ndarray) -> None:
        self.full -= np.bincount(self.bucket[at], minlength=len(self.full))
        self.key[at], self.bucket[at] = -1, 1 << BUCKETS

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that occur `least` times or more, and their ranks by falling count, then key.

        A pair that overlaps itself along a run counts at every second place there, so no place here overlaps another of
        its own pair. A bucket's count is no less than that of its pairs, so only full buckets are counted exactly. Of
        several such pairs in a bucket the most frequent one is returned; the others have their turn in later rounds.
        """
        some = self.fresh & (self.full >= least)
        some[-1] = False
        at = np.flatnonzero(some[self.bucket])
        if not len(at):
            return at, at
        begins = np.append([True], (at[1:] != self.next[at[:-1]]) | (self.key[at[1:]] != self.key[at[:-1]]))
        along = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        at = at[along % 2 == 0]
        keys = np.sort(self.key[at])
        first = np.flatnonzero(np.append([True], keys[1:] != keys[:-1]))
        counts = np.diff(np.append(first, len(keys)))
        keep = counts >= least
        pairs, counts = keys[first[keep]], counts[keep]
        self.fresh[some] = False
        pairs = pairs[np.lexsort((pairs, -counts))]
        home = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int32)
        self.fresh[home] = True
        of = np.sort(np.unique(home, return_index=True)[1])
        pairs = pairs[of]
        table = np.full(len(self.full), -1, np.int32)
        table[home[of]] = np.arange(len(of))
        rank = table[self.bucket[at]]
        mine = rank >= 0
        at, rank = at[mine], rank[mine]
        mine = pairs[rank] == self.key[at]
        return at[mine], rank[mine]

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> None:
        """The pairs that begin at `at`, none of which overlap, become these symbols."""
        right, before = self.next[at], self.prev[at]
        touched = np.zeros(len(self.seq), bool)
        touched[at] = touched[right] = True
        touched[before[before >= 0]] = True
        self._unset(np.flatnonzero(touched))
        self.seq[at] = symbols
        self.last[at] = self.last[right]
        self.alive[right] = False
        after = self.next[right]
        self.next[at] = after
        self.prev[np.minimum(after, len(self.seq) - 1)] = at
        touched[right] = False
        self._set(np.flatnonzero(touched))


def repair(ids: np.ndarray, ends: np.ndarray, least: int = LEAST_COUNT):
    """Symbols, symbol offset of each document's end, rules and the first nonterminal, for ids whose documents end at `ends`.

    `least` is 2 or more.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    room = NARROW - base if base < NARROW else 1 << 20
    rules = np.zeros((0, 2), np.int64)
    if not len(ids):
        return ids.astype(np.int64), np.zeros(0, np.int64), rules, base
    state = _Pairs(ids, ends)
    none = np.iinfo(np.int32).max
    ranks = np.full(len(ids) + 2, none, np.int32)
    while len(rules) < room:
        at, rank = state.frequent(least)
        if not len(at):
            break
        # of overlapping pairs the more frequent one wins; the first of all wins everywhere, so every round makes a rule
        ranks[at] = rank
        wins = (rank < ranks[state.prev[at]]) & (rank < ranks[state.next[at]])
        ranks[at] = none
        at, rank = at[wins], rank[wins]
        uses = np.bincount(rank)
        used = np.flatnonzero(uses > 1)[: room - len(rules)]
        new = np.full(len(uses), -1, np.int64)
        new[used] = base + len(rules) + np.arange(len(used))
        at, symbol = at[new[rank] >= 0], new[rank[new[rank] >= 0]]
        pairs = np.zeros(len(used), np.int64)
        pairs[symbol - base - len(rules)] = state.key[at]
        rules = np.concatenate([rules, np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)])
        state.replace(at, symbol)
    alive = np.flatnonzero(state.alive)
    return state.seq[alive], np.flatnonzero(state.last[alive]) + 1, rules, base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids below each nonterminal; a rule's parts come before it."""
    out: list[int] = []
    for left, right in rules.tolist():
        out.append((out[left - base] if left >= base else 1) + (out[right - base] if right >= base else 1))
    return np.array(out, np.int64)


def to_bytes(doc_ids: list, ids: np.ndarray, ends: np.ndarray, start: int) -> bytes:
    seq, cuts, rules, base = repair(ids, ends)
    wide = 2 if base + len(rules) <= NARROW else 4
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, 1, base, len(rules), len(doc_ids), wide, len(seq), start),
        rules.astype("<u4").tobytes(),
        expansion_lengths(rules, base).astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        null.tobytes(),
        np.append([0], cuts).astype("<u8").tobytes(),
        seq.astype(f"<u{wide}").tobytes(),
    ])


class Shard:
    """A shard file's content; documents are decoded one by one or all at once."""

    def __init__(self, data: bytes):
        magic, version, self.base, rules, docs, wide, symbols, self.start = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        self.at = HEAD.size

        def read(kind: str, n: int) -> np.ndarray:
            out = np.frombuffer(data, kind, n, self.at)
            self.at += out.nbytes
            return out

        self.rules = read("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = read("<u4", rules).astype(np.int64)
        ids, null = read("<i8", docs), read("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.offsets = read("<u8", docs + 1).astype(np.int64)
        self.symbols = read(f"<u{wide}", symbols).astype(np.int64)

        self._flat = None

    def lengths_of(self, seq: np.ndarray) -> np.ndarray:
        return np.append(np.ones(self.base, np.int64), self.lengths)[seq]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids below each symbol, looked up in the rules' expansions, which are made once."""
        if self._flat is None:
            whole: list[list[int]] = []
            for left, right in self.rules.tolist():
                whole.append((whole[left - self.base] if left >= self.base else [left]) + (whole[right - self.base] if right >= self.base else [right]))
            self._flat = np.append(np.arange(self.base), [x for w in whole for x in w]).astype(np.uint32)
            self._starts = np.append(np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths)
        lens = self.lengths_of(seq)
        ends = np.cumsum(lens)
        return self._flat[np.repeat(self._starts[seq] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[k] : self.offsets[k + 1]])

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document k, expanding only the symbols that cover them."""
        seq = self.symbols[self.offsets[k] : self.offsets[k + 1]]
        ends = np.cumsum(self.lengths_of(seq))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(seq[a:b])[skip : skip + stop - start]

    def documents(self) -> list[np.ndarray]:
        ends = np.append([0], np.cumsum(self.lengths_of(self.symbols)))[self.offsets]
        return np.split(self.expand(self.symbols), ends[1:-1])


def put(path: str, data: bytes) -> None:
    """Write under another name, then move: a task that is run again, or twice at once, leaves whole files."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0])
    with store.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(part, at)


def get(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shard files; the manifest has part, shard, path, n_docs, n_tokens and start (in its part) of each."""
    import pyarrow as pa

    spark = docs.sparkSession
    rows = common.doc_columns(docs)
    size = common.stored_bytes(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if size is None else common.spread(spark, size, PARTITION_BYTES)
    order = rows.withColumn("h", F.xxhash64("text"))
    order = order.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches):
        from pyspark import TaskContext

        part, shard, start = TaskContext.get().partitionId(), 0, 0
        held_docs, held, ends, size = [], [], [], 0
        enc = tokens.encoder(vocabulary)

        def close():
            nonlocal held_docs, held, ends, size, shard, start
            path = f"{folder}/{part:06d}-{shard:06d}.lwrp"
            put(path, to_bytes(held_docs, np.concatenate(held), np.array(ends), start))
            row = [part, shard, path, len(held_docs), size, start]
            shard, start, held_docs, held, ends, size = shard + 1, start + size, [], [], [], 0
            names = ["part", "shard", "path", "n_docs", "n_tokens", "start"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in common.sliced(batches):
            ids, counts = enc.encode(common.texts_of(b))
            at = 0
            for doc, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                held_docs.append(doc)
                held.append(np.append(ids[at : at + n], np.uint32(end_id)).astype(np.uint32))
                at, size = at + n, size + n + 1
                ends.append(size)
                if size >= shard_ids:
                    yield close()
        if size:
            yield close()

    shards = order.mapInArrow(run, "part int, shard int, path string, n_docs long, n_tokens long, start long")
    return common.materialize(shards, "shards")


def starts(manifest: DataFrame) -> DataFrame:
    """part, before: the ids of all partitions before each, summed inside blocks of partitions and over the blocks."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    sums = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("inside", inside).join(blocks.select("block", sums.alias("over")), "block").select("part", (F.col("over") + F.col("inside")).alias("before"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32 bits) of every document, from the shard files."""
    import pyarrow as pa

    spark: SparkSession = manifest.sparkSession
    shards = manifest.join(starts(manifest), "part").select("before", "path").repartition(common.spread(spark, max(1, manifest.count()), 4), "path")

    def run(batches):
        for b in batches:
            for before, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(get(path))
                found = shard.documents()
                n = np.array([len(x) for x in found], np.int64)
                starts = before + shard.start + np.cumsum(n) - n
                yield common.rebatch(doc_id=pa.array(shard.doc_ids, pa.int64()), start=pa.array(starts), n_tokens=pa.array(n), ids=pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()))

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "tokens")
    manifest = write(docs, folder)
    common.tie(folder, manifest)  # the query keeps digests only
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
