"""Operator 1, best-fit packing: swap-based local search over the bins that best fit leaves underfull.

`pieces` cuts every document's ids (end id included) into pieces of at most `capacity` tokens; `place` gives each
piece a sequence and an offset; `sequences` puts the ids of each sequence together. Pieces of full length take a
sequence alone. The others are dealt by hash to groups of about GROUP_PIECES, each packed by itself: best fit as they
come gives bins to start with, and the local search empties bins by moves, one-for-one and two-for-one exchanges, each
of which raises the sum of squared fills. What the bins hold that are not full is packed once more over all groups,
there from falling lengths. `report` tells the bins before and after the search and its steps.

Defined results: null or empty text is the end id alone (one piece); repeated rows and repeated doc_ids are packed
each for itself; very long texts are as many pieces as it takes; of equal lengths any order is as good, and the same
uids give the same bins; an empty table gives no rows; other columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common, tokens

CAPACITY = 2048
END_ID = 0
#: Expected pieces of a group; only lengths travel, so a group is about a megabyte.
GROUP_PIECES = 20_000


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length and ids (little-endian unsigned 32 bits) of every piece."""
    import pyarrow as pa

    def cut(batch):
        ids, counts = tokens.encoder(vocabulary).encode(common.texts_of(batch))
        doc_ids = batch.column(0).to_pylist()
        out, at = ([], [], [], [], []), 0
        for doc, n in zip(doc_ids, counts.tolist(), strict=True):
            own = np.append(ids[at : at + n], end_id).astype("<u4")
            at += n
            for k, s in enumerate(range(0, n + 1, capacity)):
                part = own[s : s + capacity]
                for col, v in zip(out, (doc, k, s, len(part), part.tobytes()), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    def clear():
        tokens.encoder(vocabulary).clear()

    cut_docs = common.map_batches(common.doc_columns(docs), cut, "doc_id long, piece int, start long, length long, ids binary", clear)
    return common.materialize(cut_docs.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


class Bins:
    """Bins of items; items are places in `size`. A step moves items so that the sum of squared fills grows.

    Bins that are neither full nor the donor are open. By room, open bins are found through the sizes that they hold;
    sizes and rooms in use are the bits of integers, so a step looks at few bins, however many there are.
    """

    def __init__(self, size: np.ndarray, capacity: int):
        self.size, self.capacity = size.astype(np.int64).tolist(), capacity
        self.members: list[list[int]] = []
        self.fill: list[int] = []
        self.steps = {"move": 0, "one_for_one": 0, "two_for_one": 0}
        self.rooms = 0
        self.held = [0] * (capacity + 1)
        self.of_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.holders: dict[tuple[int, int], set[int]] = {}

    def best_fit(self, falling: bool = False) -> None:
        """Items as they come, or by falling size, each into the bin that it leaves least room; rooms in use are bits."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for item in sorted(range(len(self.size)), key=lambda i: -self.size[i] if falling else i):
            s = self.size[item]
            above = rooms >> s
            if above:
                room = s + (above & -above).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                b, room = len(self.members), self.capacity
                self.members.append([])
                self.fill.append(0)
            self.members[b].append(item)
            self.fill[b] += s
            if left := room - s:
                by_room[left].append(b)
                rooms |= 1 << left

    def fewest(self) -> int:
        return -(-sum(self.size) // self.capacity)

    def used(self) -> int:
        return sum(f > 0 for f in self.fill)

    def _open(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if not room:
            return
        self.rooms |= 1 << room
        self.of_room[room].add(b)
        for s in {self.size[i] for i in self.members[b]}:
            self.held[room] |= 1 << s
            self.holders.setdefault((room, s), set()).add(b)

    def _close(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if not room:
            return
        self.of_room[room].discard(b)
        if not self.of_room[room]:
            self.rooms &= ~(1 << room)
        for s in {self.size[i] for i in self.members[b]}:
            those = self.holders[room, s]
            those.discard(b)
            if not those:
                del self.holders[room, s]
                self.held[room] &= ~(1 << s)

    def local_search(self) -> None:
        """Passes over the open bins, the emptiest first, each as the donor once, until a pass empties none."""
        least = self.fewest()
        for b in range(len(self.fill)):
            self._open(b)
        left, before = self.used(), None
        while left != before and left > least:
            before = left
            donors = sorted((f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity)
            for _, donor in donors:
                if not 0 < self.fill[donor] < self.capacity:
                    continue
                self._close(donor)
                self._drain(donor)
                if self.fill[donor]:
                    self._open(donor)
                    continue
                left -= 1
                if left == least:
                    return

    def _drain(self, a: int) -> None:
        """Give items of bin `a` to bins that are as full or fuller, which raises the squared fill, until none takes any."""
        while self.members[a]:
            own = sorted(self.members[a], key=lambda i: -self.size[i])
            rooms = self.rooms & ((1 << self.capacity - self.fill[a] + 1) - 1)
            found = self._move(own, rooms) or self._exchange([[x] for x in own], rooms, "one_for_one") or self._exchange(list(pairs_of(own, self.size)), rooms, "two_for_one")
            if found is None:
                return
            kind, give, b, take = found
            self.steps[kind] += 1
            self._close(b)
            for x in give:
                self.members[a].remove(x)
                self.members[b].append(x)
            for y in take:
                self.members[b].remove(y)
                self.members[a].append(y)
            gain = sum(self.size[x] for x in give) - sum(self.size[y] for y in take)
            self.fill[a] -= gain
            self.fill[b] += gain
            self._open(b)

    def _move(self, own: list[int], rooms: int):
        """The largest item that fits an open bin, into the one that it leaves least room."""
        for x in own:
            above = rooms >> self.size[x]
            if above:
                return "move", [x], next(iter(self.of_room[self.size[x] + (above & -above).bit_length() - 1])), []
        return None

    def _exchange(self, groups: list[list[int]], rooms: int, kind: str):
        """Items of ours for a smaller one of theirs: the exchange that fills most, none that would empty theirs."""
        best, found = 0, None
        while rooms:
            room = rooms.bit_length() - 1
            if room <= best:
                break
            rooms ^= 1 << room
            for give in groups:
                total = sum(self.size[x] for x in give)
                low = max(0, total - room)
                those = self.held[room] >> low
                if those and total > best:
                    y = low + (those & -those).bit_length() - 1
                    if total - y > best:
                        best, found = total - y, (give, room, y)
        if found is None:
            return None
        give, room, y = found
        b = next(iter(self.holders[room, y]))
        return kind, give, b, [next(i for i in self.members[b] if self.size[i] == y)]

    def placed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset and the bin's fill, by item."""
        bin_of, offset, fill = (np.zeros(len(self.size), np.int64) for _ in range(3))
        for b, items in enumerate(self.members):
            at = 0
            for i in items:
                bin_of[i], offset[i], fill[i] = b, at, self.fill[b]
                at += self.size[i]
        return bin_of, offset, fill


def pairs_of(own: list[int], size: list[int]) -> Iterator[list[int]]:
    """Two items each, one for every pair of sizes."""
    first = list({size[i]: i for i in reversed(own)}.values())
    twice = {s for s, n in Counter(size[i] for i in own).items() if n > 1}
    for k, x in enumerate(first):
        if size[x] in twice:
            yield [x, next(i for i in own if size[i] == size[x] and i != x)]
        for y in first[k + 1 :]:
            yield [x, y]


def pack(sizes: np.ndarray, capacity: int = CAPACITY, falling: bool = False) -> tuple[Bins, int]:
    """The bins after the search, and how many there were before it."""
    bins = Bins(sizes, capacity)
    bins.best_fit(falling)
    before = bins.used()
    bins.local_search()
    return bins, before


def _grouped(small: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Pack each group of `small` (uid, length); sequence ids are apart for every level and group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        bins, before = pack(pdf["length"].to_numpy(), capacity, level > 0)
        bin_of, offset, fill = bins.placed()
        base = (level << 60) + (int(pdf["g"].iloc[0]) << 32)
        out = pd.DataFrame({"uid": pdf["uid"], "length": pdf["length"], "sequence_id": base + bin_of, "offset": offset, "fill": fill})
        return out.assign(level=level, group=pdf["g"], bins_before=before, **bins.steps)

    dealt = small.select("uid", "length", F.pmod(F.xxhash64(F.lit(level), "uid"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(one, "uid long, length long, sequence_id long, offset long, fill long, level int, group long, bins_before long, move long, one_for_one long, two_for_one long")


def levels(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> tuple[DataFrame, DataFrame]:
    """Pieces below `capacity` as packed by groups, and those of all bins that are not full, packed once more."""
    small = cut.where(F.col("length") < capacity).select("uid", "length")
    first = common.materialize(_grouped(small, common.spread(cut.sparkSession, small.count(), group_pieces), 0, capacity), "packed")
    again = first.where(F.col("fill") < capacity).select("uid", "length")
    return first, _grouped(again, common.spread(cut.sparkSession, again.count(), group_pieces), 1, capacity)


def place(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """uid, sequence_id and offset of every piece of `cut` (uid, length)."""
    full = cut.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first, second = levels(cut, capacity, group_pieces)
    return full.unionByName(first.where(F.col("fill") == capacity).select(*full.columns)).unionByName(second.select(*full.columns))


def report(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """level, group, pieces, bins before and after the search, and its steps by kind."""
    first, second = levels(cut, capacity, group_pieces)
    return first.unionByName(second).groupBy("level", "group", "bins_before", "move", "one_for_one", "two_for_one").agg(F.count("*").alias("pieces"), F.countDistinct("sequence_id").alias("bins_after"))


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of every packed sequence; a group is at most `capacity` tokens."""
    parts = cut.join(placed, "uid").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", n.alias("n_tokens"), ids.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    cut = pieces(docs, vocabulary)
    return cut, place(cut)


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    cut, placed = pack_documents(docs, vocabulary)
    own = cut.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return own.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(common.read_table(spark, sf_dir, "documents"))
