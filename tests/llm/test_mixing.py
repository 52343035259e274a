import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.llm import mixing as m


def cells_of(rows):
    out = {}
    for r in rows:
        key = (r.source or "", r.lang or "", r.topic)
        out[key] = out.get(key, 0) + r.n_tokens
    return out


def brute(docs, alpha, budget=None):
    """Weight and probability of each (doc_id, text, lang, source): cells by hand, raked by dividing, in plain Python."""
    cell_of, tokens = {}, {}
    for d, text, lang, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        signs = sum(c in "#*$%&|<>" for c in text or "")
        topic = "symbols" if text is not None and signs * 4 >= n + 1 else "brief" if n < 100 else "article" if n < 1000 else "long"
        cell_of[d] = (source or "", lang or "", topic)
        tokens[cell_of[d]] = tokens.get(cell_of[d], 0) + n
    total = sum(tokens.values())
    goals = []
    for k in range(3):
        had = {}
        for c, n in tokens.items():
            had[c[k]] = had.get(c[k], 0) + n
        goal = {v: n**alpha for v, n in had.items() if n}
        goals.append({v: x / sum(goal.values()) for v, x in goal.items()})
    mass = {c: n / total for c, n in tokens.items()}
    for _ in range(200):
        for k in range(3):
            now = {}
            for c, x in mass.items():
                now[c[k]] = now.get(c[k], 0) + x
            mass = {c: x * goals[k].get(c[k], 0) / now[c[k]] if now[c[k]] else 0 for c, x in mass.items()}
    weight = {c: mass[c] * total / n if n else 1.0 for c, n in tokens.items()}
    scale = 1 / max(w for c, w in weight.items() if tokens[c])
    if budget is not None:
        spent = sum(weight[c] * scale * n for c, n in tokens.items())
        scale *= min(1.0, budget * total / spent)
    return {d: (c, weight[c], min(1.0, weight[c] * scale)) for d, c in cell_of.items()}


def test_query_equals_raking_by_hand(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    want = brute(docs, 0.7)
    drawn = {r.doc_id: r.u for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", m.uniform(None, 0).alias("u")).collect()}
    rows = m.op4_raked_mixture(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        cell, weight, prob = want[r.doc_id]
        assert (r.source or "", r.lang or "", r.topic) == cell
        assert r.weight == pytest.approx(weight, rel=1e-6) and r.prob == pytest.approx(prob, rel=1e-6)
        assert r.sampled == (drawn[r.doc_id] < prob)


def test_weights_meet_the_marginals(spark, sf):
    rows = m.op4_raked_mixture(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    total = sum(r.n_tokens for r in rows)
    for r in rows:
        assert r.n_tokens == len(docs[r.doc_id].split())
    for dim in m.DIMENSIONS:
        had, got = {}, {}
        for r in rows:
            had[r[dim]] = had.get(r[dim], 0) + r.n_tokens
            got[r[dim]] = got.get(r[dim], 0) + r.n_tokens * r.weight / total
        tempered = {k: v**0.7 for k, v in had.items()}
        scale = sum(tempered.values())
        for k, v in got.items():
            assert v == pytest.approx(tempered[k] / scale, abs=2e-3)
    top = max(r.weight for r in rows)
    for r in rows:
        assert r.prob == pytest.approx(r.weight / top)


def test_joins_and_numpy_rake_alike(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 1000))) for a in range(4) for b in range(3) for c in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = m.tempered_targets(cells, 0.5)
    near = {tuple(r)[:3]: r.mass for r in m.rake(cells, targets).collect()}
    far = {tuple(r)[:3]: r.mass for r in m.rake(cells, targets, limit=3).collect()}
    assert near.keys() == far.keys()
    for k, v in near.items():
        assert far[k] == pytest.approx(v, abs=1e-7)
    plan = m.sampling_plan(cells, targets, budget=0.9).agg(F.sum(F.col("prob") * F.col("tokens")) / F.sum("tokens"), F.max("prob")).first()
    assert plan[0] == pytest.approx(0.9, abs=1e-6) and plan[1] <= 1


def test_odd_rows(spark):
    odd = [(1, "a b", "en", "s", 9), (1, "a b", "en", "s", 9), (2, None, None, None, 9), (None, "", "en", "s", 9), (None, "x " * 50000, "en", "s", 9)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, weight int")
    rows = m.mixed_documents(frame, budget=1.0).collect()
    assert len(rows) == 5
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2, 50000]
    assert len({r.sampled for r in rows if r.doc_id == 1}) == 1
    assert all(r.sampled for r in rows if r.n_tokens)
    assert m.mixed_documents(frame.limit(0)).count() == 0


def test_draws_follow_the_probability(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'w' as text")
    share = docs.where(m.uniform(docs, 3) < 0.3).count() / 20000
    assert abs(share - 0.3) < 0.02


def test_the_pipelines_mixture_meets_its_targets(spark, monkeypatch):
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(corpus_pipeline, "mixed_documents", lambda docs, **given: asked.update(given) or docs.selectExpr("*", "true as sampled"))
    corpus_pipeline.mixture(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    cells = spark.createDataFrame([("hot", "en", "brief", 10000)] + [(f"s{i}", "en", "brief", 1000) for i in range(20)], "source string, lang string, topic string, tokens long")
    targets = m.tempered_targets(cells, asked.pop("alpha"))
    rows = m.sampling_plan(cells, targets, **asked).collect()
    goal = {r.value: r.share for r in targets.where("dim = 'source'").collect()}
    spent = sum(r.prob * r.tokens for r in rows)
    for r in rows:
        assert r.prob <= 1
        assert r.prob * r.tokens / spent == pytest.approx(goal[r.source], abs=1e-6)
    assert spent / 30000 <= asked["budget"] + 1e-9


def test_targets_that_cannot_be_met_are_told(spark):
    cells = spark.createDataFrame([("a", "en", "t", 10), ("b", "de", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("source", "a", 0.9), ("source", "b", 0.1), ("lang", "en", 0.1), ("lang", "de", 0.9), ("topic", "t", 1.0)], "dim string, value string, share double")
    with pytest.warns(UserWarning, match="missed"):
        assert m.rake(cells, targets).count() == 2
