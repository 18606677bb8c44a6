"""Blocking and retrieval: a token index in long form, cosine views, candidate pools.

Records have entity_id, source (1: entities, 2 and 3: targets), country, region, name_core and addr_clean. What the
index holds is per block: a country's region, or its residual block, where targets without an entity of their region
meet all entities of the country.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from linkweave.functions.names import skeleton

RESIDUAL = "~residual"
BLOCK = ["country", "block"]


@dataclass(frozen=True)
class Config:
    max_df: int = 20_000
    min_df: int = 2
    addr_weight: float = 1.0
    min_score: float = 0.05
    k_comb: int = 20
    k_name: int = 15
    k_addr: int = 20
    keep_per_source: int = 8
    stage1_min: float = 0.005


def make_blocks(records: DataFrame) -> DataFrame:
    """country, block, entity_id, source: a target in one block, an entity in its region's and in the residual one.

    Blocks without entities or without targets have no rows.
    """
    ids = records.select("country", "region", "entity_id", "source")
    ent, tgt = ids.where("source = 1"), ids.where("source <> 1")
    regions = ent.where("region <> ''").select("country", "region").distinct().withColumn("_has", F.lit(True))
    tgt = tgt.join(regions, ["country", "region"], "left").withColumn("block", F.when(F.col("_has"), F.col("region")).otherwise(F.lit(RESIDUAL))).drop("_has")
    both = F.array_distinct(F.array(F.when(F.col("region") == "", F.lit(RESIDUAL)).otherwise(F.col("region")), F.lit(RESIDUAL)))
    ent = ent.withColumn("block", F.explode(both))
    out = [df.select("country", "block", "entity_id", "source") for df in (ent, tgt)]
    filled = out[1].select(*BLOCK).distinct()
    known = out[0].select(*BLOCK).distinct()
    return out[0].join(filled, BLOCK, "left_semi").unionByName(out[1].join(known, BLOCK, "left_semi"))


def record_tokens(name_core, addr_clean):
    """Distinct tokens of a record, marked by kind: n name word, c whole name, k its skeleton, p word's skeleton, a address."""
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    marked = lambda kind, toks: F.transform(toks, lambda t: F.concat(F.lit(kind + "|"), t))
    words, compact = split(name_core), F.replace(name_core, F.lit(" "), F.lit(""))
    long_words = F.filter(words, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$"))
    return F.array_distinct(F.concat(
        marked("n", words),
        marked("c", F.filter(F.array(compact), lambda t: t != "")),
        marked("k", F.filter(F.array(skeleton(compact)), lambda t: F.length(t) >= 4)),
        marked("p", F.filter(F.transform(long_words, skeleton), lambda t: F.length(t) >= 2)),
        marked("a", split(addr_clean)),
    ))


def postings(records: DataFrame, cfg: Config = Config()) -> DataFrame:
    """country, block, source, entity_id, token, df and idf.

    Tokens of fewer than min_df records of a block go, unless a block has no other: it then keeps all, and a record
    without any gets `_`.
    """
    toks = records.select("country", "entity_id", record_tokens(F.col("name_core"), F.col("addr_clean")).alias("tokens"))
    rows = make_blocks(records).join(toks, ["country", "entity_id"])
    n = rows.groupBy(*BLOCK).agg(F.count("*").alias("n"))
    every = rows.select(*BLOCK, "source", "entity_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("_")))).alias("token"))
    df = every.groupBy(*BLOCK, "token").agg(F.count("*").alias("df"))
    frequent = (F.col("df") >= cfg.min_df) & (F.col("token") != "_")
    tiny = df.groupBy(*BLOCK).agg(F.max(frequent.cast("int")).alias("any")).where("any = 0").select(*BLOCK, F.lit(True).alias("tiny"))
    known = df.join(F.broadcast(n), BLOCK).join(tiny, BLOCK, "left").where(frequent | F.col("tiny"))
    known = known.select(*BLOCK, "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))
    return every.join(known, [*BLOCK, "token"])


def kind_weight(kind: str):
    """Weight of a token for overlap features: name, skel, cskel and addr by idf, num one for each numeric word."""
    token, idf = F.col("token"), F.col("idf")
    numeric = token.rlike(r"^a\|\d+$")
    mark = {"name": "n|", "skel": "p|", "cskel": "k|", "addr": "a|", "num": "a|"}[kind]
    if kind == "num":
        return F.when(numeric, 1.0).otherwise(0.0)
    return F.when(F.startswith(token, F.lit(mark)) & ~numeric, idf).otherwise(0.0)


KINDS = ("name", "skel", "cskel", "addr", "num")


def masses(index: DataFrame) -> DataFrame:
    """Sum of weights of each kind by record."""
    return index.groupBy(*BLOCK, "source", "entity_id").agg(*[F.sum(kind_weight(k)).alias(f"{k}_mass") for k in KINDS])


def view_weights(index: DataFrame, cfg: Config = Config()) -> DataFrame:
    """country, block, source, entity_id, token, view (name or addr) and w, of length one for each record and view."""
    w = F.when(F.col("df") > cfg.max_df, 0.0).otherwise(F.col("idf"))
    view = F.when(F.startswith("token", F.lit("a|")), "addr").otherwise("name")
    rows = index.select(*BLOCK, "source", "entity_id", "token", view.alias("view"), w.alias("w")).where("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*BLOCK, "source", "entity_id", "view")))
    return rows.withColumn("w", F.col("w") / norm)


def cosines(views: DataFrame, cfg: Config = Config(), queries: DataFrame | None = None) -> DataFrame:
    """country, block, s1_id, cand_id, source and name_cos, addr_cos, comb_cos of every pair that shares a token.

    `queries` (s1_id) keeps only some entities on the query side; the index is of all.
    """
    has = lambda v: F.max((F.col("view") == v).cast("double")).over(Window.partitionBy(*BLOCK, "source", "entity_id"))
    views = views.withColumn("len", F.sqrt(has("name") + F.lit(cfg.addr_weight**2) * has("addr")))
    ent = views.where("source = 1").select(*BLOCK, F.col("entity_id").alias("s1_id"), "token", "view", F.col("w").alias("ws"), F.col("len").alias("ls"))
    if queries is not None:
        ent = ent.join(queries.select("s1_id"), "s1_id", "left_semi")
    tgt = views.where("source <> 1").select(*BLOCK, F.col("entity_id").alias("cand_id"), "source", "token", F.col("w").alias("wt"), F.col("len").alias("lt"))
    product = F.col("ws") * F.col("wt")
    key = [*BLOCK, "s1_id", "cand_id", "source"]
    one = lambda v: F.sum(F.when(F.col("view") == v, product).otherwise(0.0))
    lengths = F.max(F.col("ls") * F.col("lt"))  # equal for all tokens of a pair: no join of pairs with their records
    dots = ent.join(tgt, [*BLOCK, "token"]).groupBy(*key).agg(one("name").alias("name_cos"), one("addr").alias("addr_cos"), lengths.alias("_l"))
    comb = (F.col("name_cos") + F.lit(cfg.addr_weight**2) * F.col("addr_cos")) / F.col("_l")
    return dots.withColumn("comb_cos", comb).select(*key, "name_cos", "addr_cos", "comb_cos")


def pool(cos: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Pairs among the best of any view for their entity and source; ranks of all views in one pass."""
    group = Window.partitionBy(*BLOCK, "s1_id", "source")
    limits = {"comb_cos": cfg.k_comb, "name_cos": cfg.k_name, "addr_cos": cfg.k_addr}
    rounded = {c: F.round(c, 9) for c in limits}  # sums in another order are no other rank
    ranked = cos.withColumns({f"_{c}": F.row_number().over(group.orderBy(rounded[c].desc(), "cand_id")) for c in limits})
    keep = None
    for c, k in limits.items():
        own = (F.col(f"_{c}") <= k) & (rounded[c] >= cfg.min_score)
        keep = own if keep is None else keep | own
    return ranked.where(keep).drop(*[f"_{c}" for c in limits])


def target_best(cos: DataFrame) -> DataFrame:
    """country, block, cand_id, source, t_best, t_second: best scores of a target over all entities of the block."""
    best = Window.partitionBy(*BLOCK, "cand_id", "source").orderBy(F.desc("comb_cos"), "s1_id")
    rows = cos.withColumn("_r", F.row_number().over(best)).where("_r <= 2")
    pick = lambda r: F.coalesce(F.max(F.when(F.col("_r") == r, F.col("comb_cos"))), F.lit(0.0))
    return rows.groupBy(*BLOCK, "cand_id", "source").agg(pick(1).alias("t_best"), pick(2).alias("t_second"))


#: Classes of one task's left side, and cosines held at once.
CHUNK, CELLS = 512, 1 << 21


def vector_classes(views: DataFrame, members: int | None = None) -> DataFrame:
    """country, block, source, tokens, ws, n and ids: records of equal tokens once, with their first `members` ids."""
    one = views.groupBy(*BLOCK, "source", "entity_id").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("v"))
    ids = F.array_sort(F.collect_list("entity_id"))
    out = one.groupBy(*BLOCK, "source", F.col("v.token").alias("tokens")).agg(F.first("v.w").alias("ws"), F.count("*").alias("n"), ids.alias("ids"))
    return out if members is None else out.withColumn("ids", F.slice("ids", 1, members))


class _Side:
    """The classes of one side of a block: each view's distinct vectors, and where a class has them."""

    def __init__(self, rows: pd.DataFrame):
        self.vectors, self.at, self.filled = {}, {}, {}
        for view in ("name", "addr"):
            known, at = {}, np.empty(len(rows), dtype=np.int64)
            for i, (tokens, ws) in enumerate(zip(rows["tokens"], rows["ws"], strict=True)):
                own = {t: w for t, w in zip(tokens, ws, strict=True) if t.startswith("a|") == (view == "addr")}
                at[i] = known.setdefault(tuple(own), (len(known), own))[0]
            self.vectors[view], self.at[view] = [own for _, own in known.values()], at
            self.filled[view] = np.array([bool(own) for own in self.vectors[view]])[at]

    def lengths(self, cfg: Config) -> np.ndarray:
        return np.sqrt(self.filled["name"] + cfg.addr_weight**2 * self.filled["addr"])


def _dense(left: pd.DataFrame, right: pd.DataFrame, cfg: Config) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """From each batch's first left class on: name_cos, addr_cos and comb_cos, a row a left class, a column a right one."""
    a, b = _Side(left), _Side(right)
    la, lb, step = a.lengths(cfg), b.lengths(cfg), max(1, CELLS // len(right))
    index: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for view in b.vectors:
        found: dict[str, list[tuple[int, float]]] = {}
        for j, own in enumerate(b.vectors[view]):
            for t, w in own.items():
                found.setdefault(t, []).append((j, w))
        index |= {t: (np.array([j for j, _ in x]), np.array([w for _, w in x])) for t, x in found.items()}
    for start in range(0, len(left), step):
        cos = {}
        for view in b.vectors:
            wanted, back = np.unique(a.at[view][start : start + step], return_inverse=True)
            rows = np.zeros((len(wanted), len(b.vectors[view])))
            for row, k in zip(rows, wanted, strict=True):
                for t, w in a.vectors[view][k].items():
                    if t in index:
                        row[index[t][0]] += w * index[t][1]
            cos[f"{view}_cos"] = rows[back][:, b.at[view]]
        cos["comb_cos"] = (cos["name_cos"] + cfg.addr_weight**2 * cos["addr_cos"]) / (la[start : start + step, None] * lb)
        yield start, cos


def _best(scores: np.ndarray, k: int, least: float, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, id) of the first k ids of each row by falling score, then id; `ids` has at least k of a column if it can."""
    scores = np.round(scores, 9)
    low = least if scores.shape[1] <= k else np.maximum(np.partition(scores, -k, axis=1)[:, -k], least)[:, None]
    r, c = np.nonzero(scores >= low)
    if not len(r):
        return r, c, r
    n = np.array([len(ids[j]) for j in c])
    r, c, i = np.repeat(r, n), np.repeat(c, n), np.concatenate([ids[j] for j in c])
    order = np.lexsort((i, -scores[r, c], r))
    r, c, i = r[order], c[order], i[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], i[first]


def _chunked(left: DataFrame, right: DataFrame):
    """Both sides grouped by block and chunk of the left side's classes; the right side goes to every chunk."""
    sizes = left.groupBy(*BLOCK).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_k"))
    left = left.join(sizes, BLOCK).withColumn("_chunk", F.pmod(F.xxhash64("tokens"), F.col("_k")).cast("int")).drop("_k")
    right = right.join(sizes, BLOCK).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from one table
    return left.groupBy(*BLOCK, "_chunk").cogroup(right.groupBy(*BLOCK, "_chunk"))


def class_pool(views: DataFrame, cfg: Config = Config(), queries: DataFrame | None = None) -> DataFrame:
    """pool(cosines(views, cfg, queries), cfg) for blocks of few distinct names and addresses, with no row for other pairs.

    Cosines are of classes of records with equal tokens, in arrays of a task; only the pool's pairs become rows.
    """
    ent = views.where("source = 1")
    if queries is not None:
        ent = ent.join(queries.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    limits = {"comb_cos": cfg.k_comb, "name_cos": cfg.k_name, "addr_cos": cfg.k_addr}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, left, right = [], left.to_pandas(), right.to_pandas()
        for source, tgt in right.groupby("source") if len(left) else ():
            ids = list(tgt["ids"])
            for start, cos in _dense(left, tgt, cfg):
                best = [np.stack(_best(cos[c], k, cfg.min_score, ids)) for c, k in limits.items()]
                r, c, cand = np.unique(np.concatenate(best, axis=1), axis=1)
                found.append(_spread(left, start + r, "s1_id", cand_id=cand, source=np.full(len(r), source), **{n: x[r, c] for n, x in cos.items()}))
        return _table(found, schema)

    schema = {n: pa.string() for n in BLOCK} | dict.fromkeys(("s1_id", "cand_id", "source"), pa.int64())
    schema |= dict.fromkeys(("name_cos", "addr_cos", "comb_cos"), pa.float64())
    tgt = vector_classes(views.where("source <> 1"), max(limits.values()))
    return _chunked(vector_classes(ent), tgt).applyInArrow(run, from_arrow_schema(pa.schema(schema)))


def _spread(classes: pd.DataFrame, at: np.ndarray, key: str, **values: np.ndarray) -> dict[str, np.ndarray]:
    """Values of the classes at places `at`, a row for every id (named `key`) of a class."""
    members = [classes["ids"].iloc[i] for i in at]
    n = [len(x) for x in members]
    own = {c: classes[c].to_numpy()[np.repeat(at, n)] for c in BLOCK}
    return own | {key: np.concatenate([np.empty(0, dtype=np.int64), *members])} | {c: np.repeat(v, n) for c, v in values.items()}


def _table(found: list[dict[str, np.ndarray]], schema: dict[str, pa.DataType]) -> pa.Table:
    """The parts below one another; a group without any has no rows."""
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(x[n], kind) for n, kind in schema.items()], list(schema)) for x in found], pa.schema(schema))


def class_target_best(views: DataFrame, cfg: Config = Config()) -> DataFrame:
    """target_best(cosines(views, cfg)), made as class_pool is."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, left, right = [], left.to_pandas(), right.to_pandas()
        for start, cos in _dense(left, right, cfg) if len(left) and len(right) else ():
            comb = cos["comb_cos"]
            rows, top = np.arange(len(comb)), comb.argmax(axis=1)
            best = comb[rows, top]
            comb[rows, top] = np.where(right["n"].to_numpy()[top] > 1, best, 0.0)
            own = np.flatnonzero(best > 0)
            found.append(_spread(left, start + own, "cand_id", source=left["source"].to_numpy()[start + own], t_best=best[own], t_second=comb.max(axis=1)[own]))
        return _table(found, schema)

    schema = {n: pa.string() for n in BLOCK} | {"cand_id": pa.int64(), "source": pa.int64(), "t_best": pa.float64(), "t_second": pa.float64()}
    return _chunked(vector_classes(views.where("source <> 1")), vector_classes(views.where("source = 1"), 1)).applyInArrow(run, from_arrow_schema(pa.schema(schema)))


#: Entities and targets of a block, about, whose tokens are in one task at once.
TILE_ENT, TILE_TGT = 4096, 8192


class _Tokens:
    """Tokens of a tile's records, as places in a vocabulary with the weight of each kind."""

    def __init__(self, rows: pa.Table):
        lists = rows["_tokens"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        self.codes, self.ends = coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        n = np.max(rows["_n"].to_numpy())
        self.weights = np.zeros((len(KINDS), len(coded.dictionary)))
        for i, text in enumerate(coded.dictionary.to_pylist()):
            token, _, df = text.rpartition(" ")
            kind = "num" if re.fullmatch(r"a\|[0-9]+", token) else {"n": "name", "p": "skel", "k": "cskel", "a": "addr"}.get(token[:1] if token[1:2] == "|" else "")
            if kind:
                self.weights[KINDS.index(kind), i] = 1.0 if kind == "num" else np.log(n / int(df))
        own = rows["_ent"].to_numpy(zero_copy_only=False)
        self.at, ids = {True: np.flatnonzero(own), False: np.flatnonzero(~own)}, rows["_id"].to_pandas()
        self.known = {side: pd.Index(ids.iloc[at]) for side, at in self.at.items()}

    def places(self, ent: bool, ids: pd.Series) -> np.ndarray:
        """Of records of a side; -1 where the index has none."""
        found = self.known[ent].get_indexer(ids)
        return np.where(found < 0, -1, self.at[ent][found]) if len(self.at[ent]) else found

    def of(self, place: int) -> np.ndarray:
        return self.codes[self.ends[place] : self.ends[place + 1]]

    def masses(self) -> np.ndarray:
        """A row for each kind, a column for each record, and a last column of zeros."""
        lengths = np.diff(self.ends)
        record = np.repeat(np.arange(len(lengths)), lengths)
        return np.array([np.bincount(record, w[self.codes], len(lengths) + 1) for w in self.weights])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of places: shared weight of each kind, then the largest of names and of addresses."""
        out, mark = np.zeros((len(KINDS) + 2, len(a))), np.zeros(self.weights.shape[1], dtype=bool)
        order = np.argsort(a, kind="stable")
        order = order[(a[order] >= 0) & (b[order] >= 0)]
        for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else ():
            mine = self.of(a[rows[0]])
            mark[mine] = True
            theirs = [self.of(t) for t in b[rows]]
            row, code = np.repeat(np.arange(len(rows)), [len(x) for x in theirs]), np.concatenate(theirs)
            hit = mark[code]
            row, code = row[hit], code[hit]
            mark[mine] = False
            if len(code):
                for k, w in enumerate(self.weights):
                    out[k, rows] = np.bincount(row, w[code], len(rows))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for k, kind in enumerate(("name", "addr"), len(KINDS)):
                    out[k, rows[row[first]]] = np.maximum.reduceat(self.weights[KINDS.index(kind)][code], first)
        return out


def shared_mass(pairs: DataFrame, index: DataFrame, masses: bool = False) -> DataFrame:
    """`pairs` with the shared weight of each kind, and the largest shared idf of names and addresses.

    `masses` adds those of with_masses. Tokens go once to each tile of a block's entities and targets, in an array for a
    record, and pairs go to their tile: neither a pair nor a token has a row or a copy of tokens of its own. idf is made
    again of df and the records of the block.
    """
    own = F.col("source") == 1
    n = F.max(F.round(F.col("df") * F.exp("idf"))).alias("_n")
    records = index.groupBy(*BLOCK, own.alias("_ent"), F.col("entity_id").alias("_id")).agg(F.collect_list(F.concat_ws(" ", "token", "df")).alias("_tokens"), n)
    parts = lambda side, most: F.greatest(F.ceil(F.approx_count_distinct(F.when(side, F.col("entity_id"))) / most), F.lit(1)).cast("int")
    sizes = F.broadcast(index.groupBy(*BLOCK).agg(parts(own, TILE_ENT).alias("_ke"), parts(~own, TILE_TGT).alias("_kt")))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.coalesce(k, F.lit(1))).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    right = records.join(sizes, BLOCK).withColumns({
        "_e": F.explode(F.when(F.col("_ent"), F.array(part("_id", F.col("_ke")))).otherwise(every("_ke"))),
    }).withColumn("_t", F.explode(F.when(F.col("_ent"), every("_kt")).otherwise(F.array(part("_id", F.col("_kt")))))).drop("_ke", "_kt")
    left = pairs.join(sizes, BLOCK, "left").withColumns({"_e": part("s1_id", F.col("_ke")), "_t": part("cand_id", F.col("_kt"))}).drop("_ke", "_kt")
    names = [*[f"{k}_shared" for k in KINDS], "name_max", "addr_max"]
    sides = [f"{p}_{k}" for p in "ab" for k in KINDS] if masses else []

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["_e", "_t"])
        values = np.zeros((len(names) + len(sides), len(left)))
        if len(left) and len(right):
            tokens = _Tokens(right)
            a, b = tokens.places(True, left["s1_id"].to_pandas()), tokens.places(False, left["cand_id"].to_pandas())
            values[: len(names)] = tokens.shared(a, b)
            if sides:
                mass = tokens.masses()
                values[len(names) :] = np.concatenate([mass[:, a], mass[:, b]])
        for name, v in zip([*names, *sides], values, strict=True):
            left = left.append_column(name, pa.array(v))
        return left

    schema = T.StructType([*pairs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in [*names, *sides]]])
    at = [*BLOCK, "_e", "_t"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: pairs may come from the index too
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(run, schema)


def with_masses(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """`pairs` with the masses of both sides: a_ of the entity, b_ of the target."""
    m = masses(index)
    side = lambda p, name: [F.col(f"{k}_mass").alias(f"{p}_{k}") for k in KINDS]
    a = m.where("source = 1").select(*BLOCK, F.col("entity_id").alias("s1_id"), *side("a", "s1_id"))
    b = m.where("source <> 1").select(*BLOCK, F.col("entity_id").alias("cand_id"), *side("b", "cand_id"))
    fill = [f"{p}_{k}" for p in "ab" for k in KINDS]
    return pairs.join(a, [*BLOCK, "s1_id"], "left").join(b, [*BLOCK, "cand_id"], "left").na.fill(0.0, fill)


def average_rank(group: Window, column):
    """Places by falling value; equals share the mean of theirs."""
    ties = Window.partitionBy(*BLOCK, "s1_id", *group, column)
    return F.rank().over(Window.partitionBy(*BLOCK, "s1_id", *group).orderBy(column.desc())) + (F.count("*").over(ties) - 1) / 2


def stage1_features(pairs: DataFrame) -> DataFrame:
    """Ranks and gaps of the views within an entity's pool. `pairs` has the pool's cosines, and maybe name_tset and num_jac."""
    src = ["source"]
    whole = Window.partitionBy(*BLOCK, "s1_id", "source")
    rounded = pairs.withColumn("prod", F.col("name_cos") * F.col("addr_cos")).withColumns({f"_{c}": F.round(c, 9) for c in ("comb_cos", "name_cos", "addr_cos")})
    rounded = rounded.withColumn("_prod", F.round("prod", 9))
    out = rounded.withColumns({"is_s3": (F.col("source") == 3).cast("int"), "n_pool": F.count("*").over(whole), "rk_comb_all": average_rank([], F.col("_comb_cos"))})
    for c in ("comb_cos", "name_cos", "addr_cos", "prod"):
        out = out.withColumns({f"rk_{c}": average_rank(src, F.col(f"_{c}")), f"gap_{c}": F.max(c).over(whole) - F.col(c)})
    for c in ("name_tset", "num_jac"):
        if c in pairs.columns:
            out = out.withColumn("_v", F.round(F.coalesce(F.col(c), F.lit(-1.0)), 9)).withColumn(f"rk_{c}", average_rank(src, F.col("_v"))).drop("_v")
    return out.drop("_comb_cos", "_name_cos", "_addr_cos", "_prod")


def keep_top(pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The best of each entity and source by stage1, within a block."""
    best = Window.partitionBy(*BLOCK, "s1_id", "source").orderBy(F.desc("stage1"), "cand_id")
    return pairs.where(F.col("stage1") >= cfg.stage1_min).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= cfg.keep_per_source).drop("_r")
