import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wayspan.llm import divergence as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs):
    """Rows of the audit from (text, lang, source)."""
    docs = [((t or ""), (a or ""), (s or "")) for t, a, s in docs]
    held, count = Counter(), {(a, s): Counter() for _, a, s in docs}
    for text, lang, source in docs:
        found = TERM.findall(text.translate(LOWER))
        held.update((lang, t) for t in set(found))
        count[lang, source].update(found)
    kept = {lang: sorted((t for a, t in held if a == lang and held[a, t] >= 10), key=str.encode) for lang in {a for _, a, _ in docs}}
    out = []
    chance = lambda n, total, size: 1 + 10**9 * (n + 2) // (total + 2 * size)
    for lang, terms in kept.items():
        sources = [s for a, s in count if a == lang]
        total = {s: sum(count[lang, s][t] for t in terms) for s in sources}
        p = {s: {t: chance(count[lang, s][t], total[s], len(terms)) for t in terms} for s in sources}
        q = {t: chance(sum(count[lang, s][t] for s in sources), sum(total.values()), len(terms)) for t in terms}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in terms if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", best, 10)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def audit(spark, docs):
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    return sorted(map(tuple, m.divergence_audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))


def cases(n=260, seed=3):
    rng = random.Random(seed)
    pool = ["Ähre", "ähre", "word", "WORD", "words", "wording", "été", "été2x", "naïve", "z", "zz", "zzz", "漢字", "漢"] + [f"t{chr(97 + k)}" for k in range(20)]
    docs = [(" ".join(rng.choices(pool, k=rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "b", "ß", None, "C"])) for _ in range(n)]
    docs += [(None, "en", "a"), ("", "xx", "one"), ("rare words only", "yy", "p"), ("-- 12 --", "yy", "q"), (" ".join(pool * 4000), "en", "b")]
    return docs + [docs[0]] * 5


def test_equals_brute_force(spark):
    assert audit(spark, cases()) == brute(cases())


def test_small_blocks_waves_and_tiles(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 3), ("BLOCK_BYTES", 12), ("WAVE_BYTES", 300), ("TILE", 16), ("TEXT_BYTES", 200)):
        monkeypatch.setattr(m, name, value)
    assert audit(spark, cases(120, 7)) == brute(cases(120, 7))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, number int, total long")
    assert m.divergence_audit(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en", "x", 7, 9), (1, "a b", "en", "y", None, None)], "doc_id long, text string, lang string, source string, number int, total long")
    assert sorted(map(tuple, m.divergence_audit(docs).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", max_size=6), min_size=1, max_size=60), st.lists(st.text("abcd", max_size=7), max_size=30))
def test_transducer_gives_ranks_and_is_minimal(terms, asked):
    terms = sorted(t.encode() for t in terms)
    machine = m.minimal_transducer(terms)
    strings = [*terms, *(a.encode() for a in asked)]
    spans = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
    want = [terms.index(s) if s in terms else -1 for s in strings]
    assert m.ranks(machine, np.frombuffer(b"".join(strings), np.uint8), spans).tolist() == want
    tails = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for term in terms for p in (term[:k] for k in range(len(term) + 1))}
    assert len(machine[3]) == len(tails)  # a state for each set of tails, no more


def test_probability_is_exact_for_large_counts():
    for count, total, terms in ((10**14, 10**14, 10**9), (123456789012345, 234567890123456, 987654321), (0, 10**14, 1)):
        got = m.probability(np.array([count]), np.array([total]), terms)[0]
        assert got == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_terms_stay_within_texts():
    terms, code, row = m.terms_of(np.frombuffer("abCd1é".encode(), np.uint8), np.array([0, 2, 2, 4, 7]))
    assert terms.take(pa.array(code)).to_pylist() == [b"ab", b"cd", "é".encode()]
    assert row.tolist() == [0, 2, 3]
