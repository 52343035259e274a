import random
import re

import numpy as np
import pytest

from wayspan.llm import neardup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(docs, size):
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in nd.op10_hyperminhash(spark, sf).collect())
    assert got == brute(docs, 2)
    assert not all(r[3] for r in got)


def family(seed):
    """Copies, near copies on either side of the limit, chains, and a bucket with several components."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for length in (3, 9, 12, 40, 200):
        seeds = [rnd.choice(vocabulary) for _ in range(length)]
        for _ in range(25):
            own = list(seeds)
            for _ in range(rnd.choice((0, 1, 2, max(1, length // 18), max(1, length // 12)))):
                own[rnd.randrange(length)] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                seeds = own
            docs.append(" ".join(own))
    docs += ["", " \n", "one", "One", "one two", "one  TWO", "x " * 40000]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "size", "block"), [(1, 2, 3), (2, 5, 1000)])
def test_families_equal_brute_force(spark, monkeypatch, seed, size, block):
    monkeypatch.setattr(nd, "OUTSIDERS", block)
    monkeypatch.setattr(nd, "MEMBERS", 2 * block)
    monkeypatch.setattr(nd, "NEAREST", 1)
    for _ in range(1):
        docs = family(seed)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = sorted(tuple(r) for r in nd.near_duplicates(frame, shingle=size).collect())
        assert got == brute(docs, size)


def test_odd_rows(spark):
    text = "a b c d e f g h i j k l m n o p"
    odd = spark.createDataFrame([(4, text, 1), (4, text, 1), (2, text + " q", 2), (None, text, 3), (None, "only here and nowhere else", 4), (None, "only here and nowhere else", 4), (7, None, 5), (8, "", 6)], "doc_id long, text string, kept int")
    got = sorted((tuple(r) for r in nd.near_duplicates(odd, shingle=2).collect()), key=repr)
    assert got == sorted([(4, 15, 2, False), (4, 15, 2, False), (2, 16, 2, True), (None, 15, 2, False), (None, 4, None, True), (None, 4, None, True), (7, 0, 7, True), (8, 0, 8, True)], key=repr)
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 7, 8, None, None, None], key=repr)
    assert nd.near_duplicates(odd.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for shared in (0.0, 0.5, 0.9):
        k = int(2000 * 2 * shared / (1 + shared))
        a, b = base[:2000], np.r_[base[:k], base[2000 : 4000 - k]]
        agree = np.array([(nd.registers(np.unique(a)) == nd.registers(np.unique(b))).mean()])
        assert abs(nd.estimated(agree, np.array([2000]), np.array([2000]))[0] - shared) < 0.12


def test_ids_of_any_size_keep_their_documents(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey"]
    docs = list(zip((1, (1 << 62) + 5, -7), texts, strict=True))
    frame = spark.createDataFrame([*docs, ((1 << 63) - 1, texts[1])], "doc_id long, text string")
    got = sorted(tuple(r) for r in nd.near_duplicates(frame, shingle=2).collect())
    assert got == [(-7, 5, -7, True), (1, 5, 1, True), ((1 << 62) + 5, 5, (1 << 62) + 5, True), ((1 << 63) - 1, 5, (1 << 62) + 5, False)]
    assert sorted(r.doc_id for r in nd.drop_near_duplicates(frame).collect()) == [-7, 1, (1 << 62) + 5]


def test_rows_under_one_id_are_judged_by_their_own_texts(spark):
    a, b = "one two three four five six", "red green blue white black grey"
    frame = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in nd.near_duplicates(frame, shingle=2).collect()) == [(3, 5, 3, True), (5, 5, 3, False), (5, 5, 5, True), (9, 5, 5, False)]
    assert sorted(r.doc_id for r in nd.drop_near_duplicates(frame).collect()) == [3, 5, 5]


def test_a_family_around_the_limit_verifies_few_pairs(spark, monkeypatch):
    """Near copies whose similarities lie around the limit: verified pairs grow with documents, not with pairs."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    seed = [rnd.choice(words) for _ in range(60)]
    docs = []
    for i in range(300):
        own = list(seed)
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(60)] = rnd.choice(words)
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sizes, plain = [], nd.verified

    def counting(pairs, *rest):  # pairs whose full sets are compared
        sizes.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(nd, "verified", counting)
    got = sorted(tuple(r) for r in nd.near_duplicates(frame, shingle=2).collect())
    assert got == brute(docs, 2)
    assert sum(sizes) < 8 * len(docs)


def test_parity_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    sets = [np.unique(np.r_[base[:n], base[2000 : 2000 + k]]) for n in (5, 63, 700, 1900) for k in (0, 1, 7, 60, 400)]
    sketch, size = [nd.parity_sketch(s) for s in sets], np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    out = nd.parity_gaps(sketch, a, b)[0] * 180 > (size[a] + size[b]) * 20
    linked = np.array([100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert not (out & linked).any()
    alike = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * 80  # others go by their sizes
    assert out[alike].sum() > 0.9 * (~linked & alike).sum() > 0
