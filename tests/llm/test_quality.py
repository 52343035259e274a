import math
import re

import numpy as np
import pytest

from wayspan.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams, covered = {}, set()
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(spark, sf):
    rows = q.op8_mcd_quality(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in rows) and any(not r.kept and not r.base_failed for r in rows)


def test_estimates_equal_concentration_in_numpy(spark):
    rng = np.random.default_rng(5)
    floors = np.array(q.FLOORS, float)
    clean = rng.normal([1700, 100, 200, 0, 0], [200, 50, 40, 10, 10], (300, 5))
    far = rng.normal([1700, 1500, 900, 300, 0], 30, (60, 5))
    x = np.floor(np.r_[clean, far]).astype(int)
    frame = spark.createDataFrame([("c", *map(int, r)) for r in x], "cell string, x0 long, x1 long, x2 long, x3 long, x4 long")
    got = q.estimates(frame).first().asDict()

    def lowest(values, share):
        values = np.sort(values)
        return values[math.ceil(share * len(values)) - 1]

    med = np.array([lowest(x[:, i], 0.5) for i in range(5)])
    mad = np.array([lowest(abs(x[:, i] - med[i]), 0.5) for i in range(5)])
    d2 = (((x - med) / np.maximum(1.4826 * mad, floors)) ** 2).sum(1)
    dets = []
    for step in range(q.STEPS + 1):
        bins = np.floor(np.log(d2 + 1e-9) * 100)
        own = x[bins <= lowest(bins, q.COVERAGE)] if step < q.STEPS else x[d2 <= q.CUTOFF]
        cov = np.cov(own.T, bias=True) + np.diag(floors**2)
        dets.append(np.linalg.det(cov))
        d2 = np.einsum("ij,jk,ik->i", x - own.mean(0), np.linalg.inv(cov), x - own.mean(0))
    assert all(b <= a * 1.01 for a, b in zip(dets[:-2], dets[1:-1], strict=True))
    assert [got[f"m{i}"] for i in range(5)] == pytest.approx(own.mean(0))
    factor = np.linalg.cholesky(cov)
    assert [got[f"l{i}{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([factor[i, j] for i in range(5) for j in range(i + 1)], abs=1e-6)
    assert (d2[:300] < q.CUTOFF).all() and (d2[300:] > q.CUTOFF).all()


def test_odd_rows(spark):
    prose = "The cat sat on a mat and then it went out to see what was new"
    odd = [(1, prose, "en", None, 1), (1, prose, "en", None, 1), (None, prose + " again", None, "s", 2), (3, None, "en", "s", 3), (4, "", "en", "s", 4), (5, "word " * 30000, "en", "s", 5), (6, "ü ñ é 漢 字 " * 3 + "\n\n a", "en", "s", 6)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, kept int")
    rows = q.quality_verdicts(frame, ["doc_id"]).collect()
    assert sorted(tuple(r)[:7] for r in rows if r.doc_id is not None) == sorted((d, *brute(t)) for d, t, *_ in odd if d is not None)
    kept = q.drop_low_quality(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    assert q.quality_verdicts(frame.limit(0), ["doc_id"]).count() == 0
