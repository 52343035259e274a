import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_neardup import brute as classes
from tests.llm.test_quality import brute as counts
from wayspan.llm.mixing import uniform


def test_every_stage_keeps_the_rows_that_brute_force_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        after_df = cp.written(stage(spark, docs, sf), "stage")
        after = {r.doc_id: r for r in after_df.collect()}
        assert after.keys() <= before.keys()
        if name != "shards":
            assert after_df.columns == docs.columns
        if name == "quality rules":
            failed = {d for d, r in before.items() if counts(r.text)[5]}
            assert not failed & after.keys() and len(after) > 0.7 * len(before)
        if name == "near duplicates":
            assert sorted(after) == [d for d, _, _, kept in classes([(d, r.text) for d, r in before.items()], 5) if kept]
        if name == "decontamination":
            assert sorted(after) == sorted(r[0] for r in contaminated([(d, r.text) for d, r in before.items()], items) if not r[5])
        if name == "mixture":
            want = mixed([(d, r.text, r.lang, r.source) for d, r in before.items()], cp.MIX_ALPHA, cp.MIX_BUDGET)
            drawn = {r.doc_id: r.u for r in docs.select("doc_id", uniform(docs, 0).alias("u")).collect()}
            assert sorted(after) == sorted(d for d, (_, _, prob) in want.items() if drawn[d] < prob)
        if name == "shards":
            assert after.keys() == before.keys()
        docs, before = after_df, after
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(before)


def test_columns_with_clashing_names_and_empty_tables(spark, sf):
    """Stages return the user's own values, whatever columns are called, and empty tables stay empty."""
    names = ("_id", "_text", "_row", "row", "t", "w", "cell", "topic", "weight", "prob", "n_tokens", "sampled", "kept", "component_id", "key", "node", "fp")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = cp.written(docs.selectExpr("*", *[f"concat('mine ', doc_id) as {n}" for n in names]), "clash")
    for name, stage in cp.STAGES:
        after = cp.written(stage(spark, docs, sf), "stage")
        rows = after.collect()
        assert rows and all(r[n] == f"mine {r.doc_id}" for r in rows for n in names)
        if name != "shards":
            assert after.columns == docs.columns
        assert cp.written(stage(spark, docs.limit(0), sf), "none").count() == 0
        docs = after
