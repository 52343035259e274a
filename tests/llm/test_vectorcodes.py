import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayspan.llm import vectorcodes as m


def brute(rows, entries=256, rounds=4):
    """Sorted (vec_id, code, error, label_error, sha) of rows (vec_id, vector, label); plain loops."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    cut = lambda v: [v[k * width : k * width + width] for k in range(4)]
    books = [list(b) for b in zip(*[cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]])]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, book: min((gap(p, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(cut(v)[k], books[k])[1], []).append(cut(v)[k])
            for i, parts in own.items():
                books[k][i] = [sum(c) // len(parts) for c in zip(*parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, lab, [nearest(p, b) for p, b in zip(cut(v), books)]) for i, v, lab in kept]
    labels = {}
    for _, lab, f in found:
        labels[lab] = labels.get(lab, 0) + sum(d for d, _ in f)
    return sorted((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), labels[lab], sha) for i, lab, f in found)


def codes(spark, tmp_path, rows, entries=None, extra=""):
    path = str(tmp_path / f"{random.random()}")
    spark.createDataFrame([(*r, *([1] if extra else [])) for r in rows], f"vec_id long, embedding array<float>, label int{extra}").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, m.op13_vector_codes(spark, path).collect()))


def rows(n, width, seed, grid):
    rng = random.Random(seed)
    return [(i, [rng.randint(-grid, grid) / 1024 for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]


def test_equals_brute_force_with_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "ENTRIES", 24)
    data = rows(300, 8, 1, 3)  # few values, so ties and unused entries abound
    data += [(5, data[5][1], 1), (5, data[9][1], None), (900, None, 1), (901, [float("nan")] + [0.0] * 7, 1), (902, [None] + [0.0] * 7, 2), (903, [float("inf")] + [0.0] * 7, None)]
    assert codes(spark, tmp_path, data) == brute(data, 24)


def test_few_vectors_other_lengths_and_extra_columns(spark, tmp_path):
    data = rows(40, 12, 2, 900)
    odd = [(100, [0.0] * 3, 1), (101, [], 1), (102, [0.5] * 8, 2)]
    assert codes(spark, tmp_path, data + odd, extra=", v int") == brute(data)
    assert codes(spark, tmp_path, []) == []
    assert codes(spark, tmp_path, [(1, None, 3)]) == []


def test_large_components_are_cut(spark, tmp_path):
    data = [(1, [3.0e38, -3.0e38, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    assert [r[:3] for r in codes(spark, tmp_path, data)] == [(1, "00000000", 0), (2, "01010001", 0)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 5), st.integers(1, 6))
def test_orchard_finds_the_nearest(seed, entries, width, grid):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-grid, grid + 1, (entries, width)), rng.integers(-grid - 2, grid + 3, (50, width))
    gaps = m.squared(x[:, None, :], book[None, :, :])
    best, far = m.orchard(x, book, *m.neighbour_lists(book), rng.integers(0, entries, 50))
    assert best.tolist() == gaps.argmin(1).tolist() and far.tolist() == gaps.min(1).tolist()


def test_orchard_measures_fewer_than_all(monkeypatch):
    rng = np.random.default_rng(4)
    book = rng.integers(-500, 500, (256, 4))
    x = book[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4))
    seen, plain = [], m.squared
    lists = m.neighbour_lists(book)
    monkeypatch.setattr(m, "squared", lambda a, b: seen.append(len(a)) or plain(a, b))
    m.orchard(x, book, *lists, np.zeros(2000, np.int64))
    assert sum(seen) < 2000 * 256 / 2
