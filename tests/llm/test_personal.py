import hashlib
import itertools
import random
import re

import numpy as np

from wayspan.llm import personal as p


def brute(text):
    """The patterns as they are written, searched from left to right."""
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_query_equals_the_patterns(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = p.op9_skip_chain(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert tuple(r)[1:5] == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = [(int(a), p.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans)
        added = [x for x in spans if x not in base]
        assert sorted(base + added) == spans
        assert not any(a < e and s < b for a, _, b in added for s, _, e in base)
    assert any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)


def test_base_spans_on_hard_texts():
    rnd = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "999.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "12345678901234", "é", "漢", "%", "0", "00255.1.1.1", "a@b.c@d.ee", "\n", "(", ")"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14)))
        assert p.base_spans(text) == brute(text), text
    assert p.base_spans("a" * 300000 + " " + "1" * 300000) == []


def make(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x = []
        for _ in range(rnd.randrange(5, 40)):
            kind = rnd.random()
            x.append("word" if kind < 0.6 else f"{rnd.randrange(2000)}" if kind < 0.75 else f"u{rnd.randrange(99)}@mail.example.com" if kind < 0.85 else f"10.{rnd.randrange(256)}.3.{rnd.randrange(256)}" if kind < 0.92 else f"v{rnd.randrange(9)}.{rnd.randrange(9)}")
        out.append(" ".join(x))
    return out


def rows_of(texts):
    out = [[], [], [], []]
    for t in texts:
        f = p.Field(t)
        state = p.states(f.spans, p.labelled_spans(t))
        for into, v in zip(out, (f.features, p.agreement(f.chain, state), p.agreement(f.skip, state), state), strict=True):
            into.append(v)
    return [np.concatenate(v) for v in out]


def test_held_out_accuracy_and_consistency():
    w = p.fit(*rows_of(make(1, 200)))
    right = total = 0
    for text in make(2, 100):
        field = p.Field(text)
        state = p.states(field.spans, p.labelled_spans(text))
        right += (p.marginals(field, w).argmax(axis=1) == state).sum()
        total += len(state)
    assert right / total > 0.97
    # two sightings of a token that the shape alone leaves open follow each other, in their kind
    field = p.Field("7a word word word word word word 7a")
    assert field.skip.tolist() == [[0, 1]] and not len(field.chain)
    strong = np.zeros(p.WEIGHTS)
    strong[-1] = 5.0
    field.features[:] = 0
    field.features[0, 0], strong[3 * p.FEATURES] = 6.0, 1.0  # the first looks like a phone number
    low = p.marginals(field, np.r_[strong[:-1], 0.0])
    high = p.marginals(field, strong)
    assert np.allclose(low[1], 1 / p.STATES) and high[1].argmax() == 4 and high[1, 4] > 0.8 and high[0, 4] >= low[0, 4] - 1e-9


def test_numbers_written_in_two_ways_are_joined():
    field = p.Field("call +1 (555) 010-9999 or, later on, please, 1.555.010.9999 if you can")
    assert len(field.spans) == 4 and [2, 3] in field.skip.tolist()
    assert p.Field("15550109999 and so on and on 1-555-010-9999").skip.tolist() == [[0, 1]]


def test_secrets_are_learned_and_consistent():
    rnd = random.Random(5)
    secret = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    texts = [f'word {rnd.randrange(3000)} word token = "{secret()}" word {rnd.randrange(30)}' for _ in range(80)] + make(4, 80)
    w = p.fit(*rows_of(texts))
    again = secret()
    field = p.Field(f'token = "{again}" ' + "word " * 30 + f"then {again} and 1234")
    told = p.marginals(field, w)
    alone = p.marginals(field, np.r_[w[:-1], 0.0])
    assert told.argmax(axis=1).tolist() == [5, 5, 0] and told[1, 5] > alone[1, 5]


def test_message_passing_is_exact_on_a_chain():
    field = p.Field("1a 2b 3c 4d")
    rng = np.random.default_rng(0)
    w = rng.normal(size=p.WEIGHTS)
    w[-2:] = 0.7, 0.0
    own = np.zeros((4, p.STATES))
    own[:, 1:] = field.features @ w[:-2].reshape(len(p.KINDS), p.FEATURES).T
    total, on = 0.0, np.zeros((4, p.STATES))
    for y in itertools.product(range(p.STATES), repeat=4):
        score = np.exp(own[range(4), y].sum() + 0.7 * sum(a == b for a, b in itertools.pairwise(y)))
        total += score
        on[range(4), y] += score
    assert np.allclose(p.marginals(field, w), on / total, atol=1e-4)


def test_the_sample_is_bounded_and_counts_equal_texts_once(spark):
    texts = [f"number {i} and mail a{i}@b.cd " + "1 " * 40 for i in range(60)] + ["same 1 text 2"] * 300
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = p.training_rows(frame, 10).collect()
    assert 0 < len(rows) <= 25 * p.NODES_PER_TEXT
    assert p.training_rows(frame, 1000).count() == 60 * p.NODES_PER_TEXT + 2


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "mail a@b.cd", 0), (3, "mail a@b.cd", 0), (None, "x " * 60000 + "1.2.3.4", 0)], "doc_id long, text string, spans int")
    rows = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in p.find_personal_data(odd).collect()), key=repr)
    assert rows == sorted([(1, []), (2, []), (3, [("email", 5, 11)]), (3, [("email", 5, 11)]), (None, [("ip", 120000, 120007)])], key=repr)
    assert p.find_personal_data(odd.limit(0)).count() == 0
