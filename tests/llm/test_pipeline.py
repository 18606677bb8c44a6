import pytest

from linkweave.llm import decontaminate, packing, pii, quality_classifier, simhash

from . import helpers

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{helpers.SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels, benchmark = (spark.read.parquet(f"{helpers.SF}/{t}.parquet") for t in ("labels", "benchmark"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in out.collect()}
        out = stage(spark, out, helpers.SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept = out.collect()
        after = {r.doc_id: r.text for r in kept}
        assert len(kept) == len(after) and set(after) <= set(before)
        if name == "quality_classifier":
            assert set(after) == {r.doc_id for r in quality_classifier.judge(docs, labels).where(f"{quality_classifier.M}.kept").collect()}
        if name == "benchmark_decontamination":
            own = spark.createDataFrame(list(before.items()), "doc_id long, text string")
            assert set(before) - set(after) == {r.doc_id for r in decontaminate.contaminated(own, benchmark).collect()}
        if name == "pii":
            assert set(after) == set(before) and all(after[d] == pii.redacted(rows[d]) for d in after)
            assert any(after[d] != rows[d] for d in after) and all(r.n_chars == len(r.text) for r in kept)
        out = spark.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, helpers.SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // packing.CAPACITY) + 1


def test_near_copies_go_and_clean_documents_stay(spark):
    base = " ".join(f"word{i % 211} other{i % 97}" for i in range(300))
    near = base.replace("word5 ", "changed ", 1)
    texts = [(1, base), (2, near), (3, base), (4, " ".join(f"x{i * i % 503}" for i in range(200))), (5, "short"), (6, "other short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert simhash.shingle_hashes(base, 5).size > 100
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 5, 6]


def test_run_equals_the_stages(spark):
    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, helpers.SF).collect()}
    out = spark.read.parquet(f"{helpers.SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, helpers.SF)
    assert got == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()}


def test_odd_tables(spark):
    docs = helpers.odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, helpers.SF)
        assert out.count() >= 0
        empty = stage(spark, helpers.empty(spark), helpers.SF)
        assert empty.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns == empty.columns
