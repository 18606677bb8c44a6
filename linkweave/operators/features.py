"""Features of candidate pairs.

Pairs have country, block, s1_id, cand_id, source, the cosines, stage1, t_best and t_second, and of both records the
columns of RECORD with the prefixes a_ (entity) and b_ (target). A missing value is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim
from linkweave.functions.names import skeleton
from linkweave.operators import blocking

RECORD = ["name_core", "name_clean", "name_alt", "name_legal", "name_nonlatin", "addr_clean", "addr_numbers", "addr_landmark", "addr_nonlatin", "postal"]
CONTEXT = ["rank_comb", "gap_comb", "rank_tset", "gap_tset", "rank_addr", "gap_addr", "n_cands_src", "rank_comb_all", "t_gap_best", "t_is_best", "t_margin"]


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with both records' columns, and what depends on one record only computed before pairing."""
    own = records.withColumns({
        "compact": F.replace("name_core", F.lit(" "), F.lit("")),
        "alpha": F.array_join(F.filter(F.split("addr_clean", " "), lambda t: (t != "") & ~t.rlike(r"^\d+$")), " "),
        "first_word": F.substring_index("name_core", " ", 1),
        "first_num": F.substring_index("addr_numbers", " ", 1),
    }).withColumn("skeleton", skeleton(F.col("compact")))
    cols = [*RECORD, "compact", "alpha", "first_word", "first_num", "skeleton"]
    a = own.where("source = 1").select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = own.where("source <> 1").select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.join(a, "s1_id").join(b, "cand_id")


def _flag(condition):
    return condition.cast("double")


def _both(a, b):
    return (a != "") & (b != "")


def string_features() -> dict:
    """Similarities that need a kernel."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    alt_a, alt_b = (F.when(F.col(f"{s}_name_alt") != "", F.col(f"{s}_name_alt")).otherwise(F.col(f"{s}_name_core")) for s in "ab")
    filled = _both(a("addr_clean"), b("addr_clean"))
    return {
        "core_ratio": sim.core_ratio(a("name_core"), b("name_core")),
        "core_partial": sim.core_partial(a("name_core"), b("name_core")),
        "core_tsort": sim.core_tsort(a("name_core"), b("name_core")),
        "core_tset": sim.core_tset(a("name_core"), b("name_core")),
        "core_jw": sim.core_jw(a("name_core"), b("name_core")),
        "compact_ratio": sim.core_ratio(a("compact"), b("compact")),
        "compact_partial": sim.core_partial(a("compact"), b("compact")),
        "clean_tset": sim.core_tset(a("name_clean"), b("name_clean")),
        "skel_ratio": sim.core_ratio(a("skeleton"), b("skeleton")),
        "skel_jw": sim.core_jw(a("skeleton"), b("skeleton")),
        "name_alt_tset": F.greatest(sim.core_tset(alt_a, b("name_core")), sim.core_tset(a("name_core"), alt_b), sim.core_tset(alt_a, alt_b)),
        "addr_ratio": F.when(filled, sim.core_ratio(a("addr_clean"), b("addr_clean"))),
        "addr_partial": F.when(filled, sim.core_partial(a("addr_clean"), b("addr_clean"))),
        "addr_tset": F.when(filled, sim.core_tset(a("addr_clean"), b("addr_clean"))),
        "addr_tsort": F.when(filled, sim.core_tsort(a("addr_clean"), b("addr_clean"))),
        "addr_alpha_tset": F.when(filled, sim.core_tset(a("alpha"), b("alpha"))),
        "landmark_tset": F.when(_both(a("addr_landmark"), b("addr_landmark")), sim.core_tset(a("addr_landmark"), b("addr_landmark"))),
    }


def plain_features() -> dict:
    """Built-in expressions on the two records."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    shorter = lambda x, y: F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    legal = (a("name_legal") > 0) & (b("name_legal") > 0)
    filled, nums = _both(a("addr_clean"), b("addr_clean")), _both(a("first_num"), b("first_num"))
    prefix = F.startswith(a("first_num"), b("first_num")) | F.startswith(b("first_num"), a("first_num"))
    return {
        "is_s3": _flag(F.col("source") == 3),
        "compact_equal": _flag(a("compact") == b("compact")),
        "name_ntok_s1": words(a("name_core")).cast("double"),
        "name_ntok_t": words(b("name_core")).cast("double"),
        "name_len_ratio": shorter(a("compact"), b("compact")),
        "first_tok_equal": _flag(a("first_word") == b("first_word")),
        "name_nonlatin_t": _flag(b("name_nonlatin")),
        "name_alt_any": _flag((a("name_alt") != "") | (b("name_alt") != "")),
        "legal_s1": _flag(a("name_legal") > 0),
        "legal_t": _flag(b("name_legal") > 0),
        "legal_equal": F.when(legal, _flag(a("name_legal") == b("name_legal"))),
        "legal_conflict": F.when(legal, _flag(a("name_legal").bitwiseAND(b("name_legal")) == 0)),
        "addr_missing_t": _flag(b("addr_clean") == ""),
        "addr_nonlatin_t": _flag(b("addr_nonlatin")),
        "addr_len_ratio": F.when(filled, shorter(a("addr_clean"), b("addr_clean"))),
        "first_num_equal": F.when(nums, _flag(a("first_num") == b("first_num"))),
        "first_num_prefix": F.when(nums, _flag(prefix)),
        "postal_equal": F.when(_both(a("postal"), b("postal")), _flag(a("postal") == b("postal"))),
    }


def overlap_features() -> dict:
    """Shared weight against the masses a_kind and b_kind, for pairs with both (see blocking)."""
    out = {}
    for k in ("name", "addr", "skel", "cskel"):
        sh, ma, mb = F.col(f"{k}_shared"), F.col(f"a_{k}"), F.col(f"b_{k}")
        union = ma + mb - sh
        out[f"{k}_idf_jac"] = F.when(union > 0, sh / union)
        out[f"{k}_idf_cov_t"] = F.when(mb > 0, sh / mb)
        if k in ("name", "addr"):
            out |= {f"{k}_idf_shared": sh, f"{k}_idf_unshared": F.greatest(union - sh, F.lit(0.0)), f"{k}_idf_cov_s1": F.when(ma > 0, sh / ma), f"{k}_idf_max_shared": F.col(f"{k}_max")}
    sh, na, nb = F.col("num_shared"), F.col("a_num"), F.col("b_num")
    both = (na > 0) & (nb > 0)
    return out | {
        "num_shared": sh,
        "num_jac": F.when(both, sh / F.greatest(na + nb - sh, F.lit(1.0))),
        "num_conflict": F.when(both, _flag(sh == 0)),
        "num_cov_s1": F.when(na > 0, sh / na),
    }


def name_frequencies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many entities, and how many targets, of a country have a name."""
    n = records.groupBy("country", "name_core", (F.col("source") == 1).alias("ent")).agg(F.count("*").alias("n"))
    return n.where("ent").drop("ent"), n.where("not ent").drop("ent")


def with_name_frequencies(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """name_freq_s1: of the target's name among entities; name_freq_t: of the entity's name among targets."""
    ent, tgt = name_frequencies(records)
    out = pairs.join(ent.select("country", F.col("name_core").alias("b_name_core"), F.col("n").alias("_e")), ["country", "b_name_core"], "left")
    out = out.join(tgt.select("country", F.col("name_core").alias("a_name_core"), F.col("n").alias("_t")), ["country", "a_name_core"], "left")
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return out.withColumns({"name_freq_s1": log("_e"), "name_freq_t": log("_t")}).drop("_e", "_t")


def context_features(pairs: DataFrame) -> DataFrame:
    """Competition among an entity's candidates and for a target; ranks give equals the smallest place.

    `pairs` has comb_cos, t_best, t_second, addr_idf_jac and, where there is one, core_tset.
    """
    group = Window.partitionBy(*blocking.BLOCK, "s1_id", "source")
    values = {"comb": F.col("comb_cos"), "addr": F.coalesce("addr_idf_jac", F.lit(0.0))}
    if "core_tset" in pairs.columns:
        values["tset"] = F.col("core_tset")
    out = pairs.withColumns({f"_{k}": F.round(c, 9) for k, c in values.items()})
    for k, c in values.items():
        out = out.withColumns({f"rank_{k}": F.rank().over(group.orderBy(F.desc(f"_{k}"))), f"gap_{k}": F.max(c).over(group) - c})
    out = out.withColumns({
        "n_cands_src": F.count("*").over(group),
        "rank_comb_all": F.rank().over(Window.partitionBy(*blocking.BLOCK, "s1_id").orderBy(F.desc("_comb"))),
        "t_gap_best": F.col("t_best") - F.col("comb_cos"),
        "t_is_best": _flag(F.col("comb_cos") >= F.col("t_best") - 1e-5),
        "t_margin": F.col("t_best") - F.col("t_second"),
    })
    return out.drop(*[f"_{k}" for k in values])


PASSED = ["comb_cos", "name_cos", "addr_cos", "stage1"]


def build(pairs: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """All 72 features of pairs that have the pool's cosines, stage1, t_best and t_second."""
    out = blocking.shared_mass(pairs, index, masses=True)
    out = out.withColumns(overlap_features())
    out = with_records(out, records.where(F.col("entity_id").isNotNull()))
    out = with_name_frequencies(out, records).withColumns(plain_features()).withColumns(string_features())
    out = context_features(out)
    return out.select("country", "block", "s1_id", "cand_id", "source", *feature_names())


def feature_names() -> list[str]:
    kinds = [f"{k}_idf_{x}" for k in ("name", "addr") for x in ("jac", "shared", "unshared", "cov_s1", "cov_t", "max_shared")]
    kinds += [f"{k}_idf_{x}" for k in ("skel", "cskel") for x in ("jac", "cov_t")]
    core = ["core_ratio", "core_partial", "core_tsort", "core_tset", "core_jw", "compact_ratio", "compact_partial", "compact_equal", "clean_tset", "name_ntok_s1", "name_ntok_t", "name_len_ratio", "first_tok_equal", "name_nonlatin_t", "skel_ratio", "skel_jw", "name_alt_tset", "name_alt_any", "legal_s1", "legal_t", "legal_equal", "legal_conflict", "name_freq_s1", "name_freq_t"]
    addr = ["addr_ratio", "addr_partial", "addr_tset", "addr_tsort", "addr_alpha_tset", "addr_missing_t", "addr_nonlatin_t", "addr_len_ratio", "first_num_equal", "first_num_prefix", "postal_equal", "landmark_tset"]
    return [*PASSED, "is_s3", *core, *addr, *kinds, "num_shared", "num_jac", "num_conflict", "num_cov_s1", *CONTEXT]
