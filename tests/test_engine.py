import random

import pytest

from linkweave import cli
from linkweave.operators import decode
from linkweave.plans.engine import Engine, Settings
from linkweave.sources import tsv

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
WORDS = "oak blue river stone maple silver north garden harbor summit cedar lake bright cotton amber falcon".split()
CITIES = [("Austin", "TX"), ("Boston", "MA"), ("Denver", "CO")]


def split(folder, name, seed, n=90):
    rng = random.Random(seed)
    rows, links = {1: [], 2: [], 3: []}, []
    for k in range(n):
        title = f"{rng.choice(WORDS)} {rng.choice(WORDS)}{k % 7} {rng.choice(['Traders', 'Cafe', 'Motors'])}"
        city, state = rng.choice(CITIES)
        num, street = rng.randrange(1, 900), rng.choice(WORDS)
        rows[1].append(f"S1_{k}\t{title} Inc\t{num} {street} St, {city}, {state}\tUS")
        own = []
        for s in (2, 3):
            if rng.random() < 0.7:
                rows[s].append(f"S{s}_{k}\t{title.upper()}{rng.choice(['', ' LLC', ' Incorporated'])}\t{num} {street} Street, {city}, {state}\tUS")
                own.append(f"S{s}_{k}")
            rows[s].append(f"S{s}_x{k}\t{rng.choice(WORDS)} {rng.choice(WORDS)} Shop\t{rng.randrange(900)} {street} Ave, {city}, {state}\tUS")
        links.append(f"S1_{k}\t{','.join(own)}")
    at = folder / name
    at.mkdir(parents=True)
    for s, lines in rows.items():
        (at / f"{name}_source{s}.tsv").write_text(HEAD + "\n".join(lines) + "\n", encoding="utf-8")
    (at / f"{name}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(links) + "\n")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    split(base / "data", "train", 1)
    split(base / "data", "test", 2)
    return Engine(spark, Settings(str(base / "data"), str(base / "artifacts"), str(base / "output"), sample=60, stage1_sample=30, ce_sample=0, rounds=4, folds=2))


def test_train_and_predict(spark, engine):
    meta = engine.train()
    assert meta["f05"] > 0.8 and meta["blocking"]["pair_recall"] > 0.9
    counts = engine.predict()
    assert counts["entities"] == 90
    found = spark.read.csv(engine.s.output_dir + "/matching_results", sep="\t", header=True)
    pred = tsv.links(found.na.fill(""))
    ids = engine._ids(engine.records("test"))
    assert decode.per_entity(ids, engine.truth("test"), pred).agg({"f05": "avg"}).first()[0] > 0.75
    assert len(engine.eda()) == 4
    with pytest.raises(ValueError):
        engine.validate()  # there is one country only


def test_stack(spark, engine):
    rows = engine.stack()
    assert [r["name"] for r in rows] == ["prob", "l1_gbt", "l1_mean", "l2"] and rows[0]["kept"]
    assert all(0 < r["f05"] <= 1 for r in rows)


def test_commands_parse():
    a = cli.parser().parse_args(["train", "--sample", "5", "--hide-s1", "auto"])
    assert a.command == "train" and a.sample == 5 and a.hide_s1 == "auto"
