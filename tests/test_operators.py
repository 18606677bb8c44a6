import math
import random

import pytest
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim
from linkweave.operators import blocking, decode, features, metrics, sampling
from linkweave.plans import models
from linkweave.sources import tsv


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string, prob double")


def test_expected_f(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.3), ("b", "u", 0.4), ("b", "v", 0.1)]
    kept = decode.select_expected_f(pairs(spark, rows), 0.55).collect()
    assert sorted((r.s1_id, r.cand_id) for r in kept) == [("a", "x"), ("a", "y")]


def test_f_score_and_reports(spark):
    ent = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "4"), ("d", "9")], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "5")], "s1_id string, cand_id string")
    got = {r.s1_id: round(r.f05, 4) for r in decode.per_entity(ent, truth, pred).collect()}
    assert got == {"a": 0.4545, "b": 1.0, "c": 0.0, "d": 0.0}
    check = {r.rule: r.n for r in metrics.output_check(ent, pred.select("cand_id"), truth, pred).collect()}
    assert check["match_not_candidate"] == 3 and check["duplicate_s1"] == 0


def test_plateau_is_the_upper_middle(spark):
    scores = [(k + 1, 0.1 * k, 0.9 if 3 <= k <= 6 else 0.5) for k in range(10)]
    r = decode.plateau_middle(spark.createDataFrame(scores, "point int, cut double, f05 double")).first()
    assert r.point == 6


def test_grid_equals_scores_at_each_cut(spark):
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(20)}", f"c{k}", round(rng.random(), 3)) for k in range(120)]
    truth = spark.createDataFrame([(a, b) for a, b, _ in rows if rng.random() < 0.4] + [("e99", "c500")], "s1_id string, cand_id string")
    ent = spark.createDataFrame([(f"e{k}",) for k in [*range(25), 99]], "s1_id string")
    df, grid = pairs(spark, rows), [0.1, 0.4, 0.75, 0.99]
    got = {r.cut: r.f05 for r in decode.grid_scores(ent, truth, df, grid).collect()}
    for cut in grid:
        assert math.isclose(got[cut], metrics.macro_f05(ent, truth, df.where(F.col("prob") >= cut)).first()[0], rel_tol=1e-9)


def test_decoder_choice_and_bootstrap(spark):
    df = pairs(spark, [("a", "x", 0.9), ("b", "y", 0.2)])
    ent, truth = spark.createDataFrame([("a",), ("b",)], "s1_id string"), spark.createDataFrame([("a", "x")], "s1_id string, cand_id string")
    decoder, cut, score = decode.tune_decoder(ent, truth, df)
    assert decoder == "threshold" and 0.2 < cut <= 0.9 and score == 1.0
    one = spark.createDataFrame([(f"e{k}", 1.0) for k in range(50)], "s1_id string, f05 double")
    half = spark.createDataFrame([(f"e{k}", 0.5) for k in range(50)], "s1_id string, f05 double")
    assert metrics.paired_bootstrap(one, half) == (0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        decode.select_with(df, "other", 0.5)


def test_sampling(spark):
    assert round(sampling.hide_fraction(1000, 4677, 1000, 5754), 3) == 0.187 and sampling.hide_fraction(10, 5, 0, 0) == 0
    assert sampling.sample_sizes(400, 60, 200, 150) == {"A": 60, "B": 200, "C": 150}
    ids = spark.createDataFrame([(k,) for k in range(500)], "s1_id long")
    found = sampling.disjoint_samples(ids, {"A": 40, "B": 100}).where("sample is not null").groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in found} == {"A": 40, "B": 100}


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_kernels():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in "ab")
        assert sim.common(a, b) == brute_lcs(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            windows = [long[max(s, 0) : s + len(short)] for s in range(1 - len(short), len(long))]
            assert math.isclose(sim.partial_ratio(a, b), max(sim.ratio(short, w) for w in windows))
    assert sim.token_set_ratio("blue sky cafe", "cafe blue") == 100 and sim.token_set_ratio("", "a") == 0
    assert sim.token_sort_ratio("b a", "a b") == 100
    assert math.isclose(sim.jaro_winkler("martha", "marhta"), 0.9611, abs_tol=1e-4) and math.isclose(sim.jaro_winkler("dixon", "dicksonx"), 0.8133, abs_tol=1e-4)


def test_average_ranks_and_feature_names(spark):
    rows = [("x", "b", "s", k, 2, c, c, c) for k, c in enumerate((0.5, 0.5, 0.2, 0.1))]
    df = spark.createDataFrame(rows, "country string, block string, s1_id string, cand_id int, source int, comb_cos double, name_cos double, addr_cos double")
    got = blocking.stage1_features(df).orderBy("cand_id").collect()
    assert [r.rk_comb_cos for r in got] == [1.5, 1.5, 3.0, 4.0]
    assert len(features.feature_names()) == len(set(features.feature_names())) == 72


def test_tiny_block_keeps_all_tokens(spark):
    rows = [(1, 1, "x", "", "alpha", "1 road"), (2, 2, "x", "", "beta", ""), (3, 2, "y", "", "gamma", "")]
    df = spark.createDataFrame(rows, "entity_id int, source int, country string, region string, name_core string, addr_clean string")
    found = blocking.postings(df).collect()
    assert {r.country for r in found} == {"x"} and {"n|alpha", "a|1", "n|beta"} <= {r.token for r in found}


def test_tsv(spark, tmp_path):
    path = tmp_path / "train" / "train_source1.tsv"
    path.parent.mkdir()
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nA\t"two\nlines ""q"""\tNA\t US \nB\t\t5 Rd\tIndia\n', encoding="utf-8")
    got = {r.entity_id: r for r in tsv.read_source(spark, str(path)).collect()}
    assert got["A"].business_name == 'two\nlines "q"' and got["A"].business_address == "NA" and got["A"].country == "US" and got["B"].business_name == ""
    (path.parent / "bad.tsv").write_text("entity_id\tcountry\nA\tUS\n")
    with pytest.raises(ValueError):
        tsv.read_source(spark, str(path.parent / "bad.tsv"))
    truth = path.parent / "train_ground_truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nA\tS2_1, S3_2\nB\t\n")
    for k in (2, 3):
        (path.parent / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n")
    split = tsv.load_split(spark, str(tmp_path), "train")
    assert sorted(map(tuple, split["gt"].collect())) == [("A", "S2_1"), ("A", "S3_2")] and split["s2"].count() == 0
    ent = spark.createDataFrame([("A",), ("B",)], "s1_id string")
    out = tmp_path / "out"
    tsv.write_pairs(ent, split["gt"], str(out), ("source1_entity_id", "matched_entity_ids"))
    lines = [x for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("source1")] == ["A\tS2_1,S3_2", "B\t"]
    with pytest.raises(ValueError):
        tsv.record_texts(split["s1"], spark.createDataFrame([("Z",)], "id string"))


def test_learners_and_text_scorer(spark):
    rng = random.Random(2)
    rows = [(f"e{k % 60}", f"c{k}", 2, rng.random(), None if k % 5 == 0 else rng.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, source int, a double, b double").withColumn("y", (F.col("a") > 0.5).cast("int"))
    for kind in ("gbt", "forest", "logistic"):
        learner = models.Learner(kind, 3, 3, features=["a", "b"])
        scored, rounds = models.cross_validate(learner, df, 2, "p")
        right = scored.where((F.col("p") >= 0.5) == (F.col("y") == 1)).count()
        assert scored.count() == 400 and right > 360 and rounds >= 1
    assert learner.importances(learner.fit(df))[0][0] == "a"
    texts = df.select("s1_id", "cand_id", F.col("s1_id").alias("text_a"), F.col("cand_id").alias("text_b"))
    out = models.text_scorer(lambda: lambda a, b: [float(len(x) + len(y)) for x, y in zip(a, b, strict=True)], batch=7)(texts).collect()
    assert all(r.ce == len(r.s1_id) + len(r.cand_id) for r in out) and len(out) == 400


def test_streams(spark, tmp_path):
    from linkweave.streaming import incremental

    schema = "entity_id int, source int, country string, region string, name_core string, addr_clean string"
    ent = spark.createDataFrame([(1, 1, "x", "", "blue sky cafe", "1 road"), (2, 1, "x", "", "red oak", "2 lane")], schema)
    spark.createDataFrame([(11, 2, "x", "", "blue sky", "1 road"), (12, 3, "x", "", "red oak inn", "9 lane")], schema).write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(ent.schema).parquet(str(tmp_path / "in"))
    incremental.link_stream(ent, arrivals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = {(r.s1_id, r.cand_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, 11), (2, 12)} <= found
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_class_pool(spark):
    """Equal to the pool of all cosines, copies and ties included, without a row for any other pair."""
    words = ["red", "blue", "green", "ring", "bolt", "rod", "anvil"]
    rows = []
    for i in range(150):
        name = " ".join(words[j] for j in range(7) if (i * 37 % 101) >> j & 1)
        addr = "" if i % 11 == 0 else f"{i % 5} oak st {words[i % 4]}"
        rows.append((i, 1 + i % 3, "x" if i % 4 else "y", "" if i % 13 == 0 else f"r{i % 2}", name, addr))
    cfg = blocking.Config(k_comb=4, k_name=3, k_addr=2)
    records = spark.createDataFrame(rows, "entity_id long, source long, country string, region string, name_core string, addr_clean string")
    views = blocking.view_weights(blocking.postings(records, cfg), cfg).cache()
    wanted = spark.createDataFrame([(i,) for i in range(0, 150, 6)], "s1_id long")
    cos = blocking.cosines(views, cfg).cache()
    place = ["country", "block", "s1_id", "cand_id", "source"]
    read = lambda df, keys, values: {tuple(r[k] for k in keys): [round(r[v], 7) for v in values] for r in df.collect()}
    every = read(blocking.pool(cos, cfg), place, ["name_cos", "addr_cos", "comb_cos"])
    assert every and read(blocking.class_pool(views, cfg), place, ["name_cos", "addr_cos", "comb_cos"]) == every
    some = {k: v for k, v in every.items() if k[2] % 6 == 0}
    got = blocking.class_pool(views, cfg, wanted)
    assert read(got, place, ["name_cos", "addr_cos", "comb_cos"]) == some and got.count() == len(some)
    best = read(blocking.target_best(cos), place[:2] + place[3:], ["t_best", "t_second"])
    assert read(blocking.class_target_best(views, cfg), place[:2] + place[3:], ["t_best", "t_second"]) == best


def test_jaro_winkler_of_long_strings():
    """A pass over each string: comparing every pair of places within reach took minutes here."""
    import time

    def plain(a, b):
        reach, taken, mine = max(0, max(len(a), len(b)) // 2 - 1), set(), []
        for i, c in enumerate(a):
            j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == c), None)
            if j is not None:
                taken.add(j)
                mine.append(c)
        if not mine:
            return 0.0
        m, swaps = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(taken), strict=True)) // 2
        jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
        prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
        return jaro if jaro <= 0.7 else jaro + 0.1 * prefix * (1 - jaro)

    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, 14))) for _ in "ab")
        assert a == b or math.isclose(sim.jaro_winkler(a, b), plain(a, b), abs_tol=1e-12)
    began = time.time()
    assert math.isclose(sim.jaro_winkler("ab" * 30_000, "ba" * 15_000 + "c" * 30_000), 0.5)
    assert time.time() - began < 5


def test_shared_mass_has_no_row_for_each_token(spark):
    rows = [(1, 1, "red ring 7", "7 oak"), (2, 2, "red ring", "7 oak"), (3, 3, "blue ring", ""), (4, 1, "blue", "7 elm")]
    records = spark.createDataFrame([(i, s, "x", "", n, a) for i, s, n, a in rows], "entity_id long, source long, country string, region string, name_core string, addr_clean string")
    index = blocking.postings(records)
    pairs = spark.createDataFrame([("x", "~residual", 1, 2), ("x", "~residual", 1, 3), ("x", "~residual", 4, 9)], "country string, block string, s1_id long, cand_id long")
    out = blocking.shared_mass(pairs, index)
    got = {(r.s1_id, r.cand_id): [round(r[c], 6) for c in ("name_shared", "addr_shared", "num_shared", "name_max")] for r in out.collect()}
    two, three = round(math.log(2), 6), round(math.log(4 / 3), 6)
    assert got == {(1, 2): [round(math.log(2) + math.log(4 / 3), 6), two, 1.0, two], (1, 3): [three, 0.0, 0.0, three], (4, 9): [0.0] * 4}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("token" in line for line in plan.splitlines() if "Join" in line and "cand_id" in line)


def test_class_pool_of_a_block_without_views_of_targets(spark):
    rows = [(1, 1, "x", "", "alpha", ""), (4, 1, "x", "", "alpha", ""), (2, 2, "x", "", "beta", "")]
    records = spark.createDataFrame(rows, "entity_id long, source long, country string, region string, name_core string, addr_clean string")
    views = blocking.view_weights(blocking.postings(records))
    assert views.count() > 0 and blocking.class_pool(views).collect() == [] and blocking.class_target_best(views).collect() == []


def test_plans_do_not_hold_how_kept_tables_are_made(spark):
    """Each use of the index named how its records are made, up to 27 million letters in one plan."""
    from linkweave.plans import fixtures

    kept = fixtures.kept(spark, "of a test", "counts", lambda: spark.range(9).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n")))
    assert sorted(map(tuple, kept.join(kept.select("k"), "k").collect())) == [(0, 3), (1, 3), (2, 3)]
    plan = kept._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "InMemory" not in plan


def test_pair_context_retrieves_by_frequent_tokens(spark, tmp_path):
    """Entities and targets that share one word only, which more than 40 records of the block have."""
    from linkweave.plans import linking

    rows = [(24 * i, "common") for i in range(30)] + [(24 * i + 16, "common") for i in range(30)] + [(24 * i + 16, f"other{i}") for i in range(30, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = linking.pair_context(spark, str(tmp_path)).collect()
    assert {r.s1_id for r in found} == {24 * i for i in range(30)} and len(found) == 30 * linking.CFG.k_comb
    assert "df <=" not in linking.ORACLE_SQL["pair_context"] and "df <=" in linking.ORACLE_SQL["pair_overlap"]
