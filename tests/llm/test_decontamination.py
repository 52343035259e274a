import hashlib
import re

from wayspan.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def common(a, b):
    """Length of the longest run of words that both have."""
    best, row = 0, {}
    where = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    for x in a:
        row = {j: row.get(j - 1, 0) + 1 for j in where.get(x, ())}
        best = max(best, *row.values()) if row else best
    return best


def brute(docs, items, window=10):
    wanted = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for at in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[at : at + n]), set()).add(str(i))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for at in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        longest = max((common(w, words(t)) for i, t in items if str(i) in found), default=0)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in d.op6_suffix_decontamination(spark, sf).collect()), key=repr)
    assert got == brute(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def fixture(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, f"pre {passage} post"), (2, passage.upper().replace(" ", "--")), (3, "one two three four five six seven eight nine"), (4, None), (5, ""),
        (6, "ein kleiner Satz, Ünïcode wörter"), (7, f"{passage} {passage} " * 50), (7, f"{passage} {passage} " * 50), (None, "Ünïcode wörter"), (8, "word " * 30000),
    ]
    items = [(10, passage), (9, "two three four five six seven eight nine ten eleven"), (11, "Ünïcode wörter"), (12, None), (13, ""), (14, "!!")]
    return (
        docs, items,
        spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_hit int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_odd_rows_blocks_and_small_chunks(spark, monkeypatch):
    docs, items, left, right = fixture(spark)
    assert sorted((tuple(r) for r in d.contamination(left, right).collect()), key=repr) == brute(docs, items)
    kept = d.decontaminate(left, right)
    assert kept.columns == left.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert d.contamination(left.limit(0), right).count() == 0
    assert {r.contaminated for r in d.contamination(left, right.limit(0)).collect()} == {False}
    monkeypatch.setattr(d, "BLOCK_BYTES", 40)
    assert sorted({tuple(r) for r in d.contamination(left, right).collect()}, key=repr) == sorted(set(brute(docs, items)), key=repr)
    assert sorted(r.doc_id for r in d.decontaminate(left, right).collect()) == [3, 4, 5, 8]


def test_longest_matches(spark):
    _, _, left, right = fixture(spark)
    rows = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in d.longest_matches(left.where("doc_id < 7 or doc_id is null"), right).collect()}
    assert rows == {(1, "10", 1, 0, 12), (1, "9", 2, 0, 10), (2, "10", 0, 0, 12), (2, "9", 1, 0, 10), (6, "11", 3, 0, 2), (None, "11", 0, 0, 2)}


def test_items_without_id_and_row_counts(spark, monkeypatch):
    passage, other = "One two three four five six seven eight nine ten", "eins zwei drei vier fünf sechs sieben acht neun zehn"
    docs = [(1, f"pre {passage} post"), (1, f"pre {passage} post"), (None, other), (None, other), (2, f"{other} {passage}"), (3, "clean"), (3, "clean"), (4, None), (4, None)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame([(None, passage), (None, "  " + passage), (7, other), (None, None)], "item_id long, text string")
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    want = [(1, 12, 10, 1, none, True, 10)] * 2 + [(None, 10, 10, 1, seven, True, 10)] * 2 + [(2, 20, 20, 2, seven, True, 10)] + [(3, 1, 0, 0, none, False, 0)] * 2 + [(4, 0, 0, 0, none, False, 0)] * 2
    for size in (d.BLOCK_BYTES, 40):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        assert sorted((tuple(r) for r in d.contamination(left, right).collect()), key=repr) == sorted(want, key=repr)
        assert sorted(r.doc_id for r in d.decontaminate(left, right).collect()) == [3, 3, 4, 4]
