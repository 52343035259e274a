import hashlib
import random
import re

import pyarrow as pa

from wayspan.llm import lines as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)


def brute(docs):
    """Sorted (doc_id, n_lines, n_dropped, sha) of rows (doc_id, text)."""
    rank = lambda d: (d is not None, d or 0)
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(k := key(line)) >= 20:
                held.setdefault(k, set()).add(doc)
    lost = {k: max(v, key=rank) for k, v in held.items() if len(v) >= 3}
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [line for line in own if key(line) not in lost or lost[key(line)] == doc]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def report(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in m.line_report(df).collect()), key=str)


A, B, C = "The first of the common lines", "  Another line of twenty or more\t", "été été été été été!"


def cases():
    docs = [(5, f"{A}\nown\n{B}"), (1, f"{A.upper()} \n{A}\nx"), (9, f"{B}\n{A}"), (2, f"{B.strip()}\n{B}\nshort"), (7, None), (8, ""), (3, "\n\n"), (None, f"{A}\n{B}\nnull id")]
    docs += [(k, f"{C}\nline {k}\n{C[:-1]}") for k in range(20, 24)]  # 20 code points, and one fewer
    docs += [(30, f"{A}\nanother text of the same id"), (30, f"{A}\n{B}"), (30, f"{A}\n{B}")]  # repeated ids and rows
    docs += [(-4, f"{A}\r\nwindows ends\r\n{B}\r")]
    return docs


def test_equals_brute_force(spark):
    assert report(spark, cases()) == brute(cases())


def test_many_documents_with_hot_lines(spark):
    rng = random.Random(5)
    pool = [f"common line number {k:04d} of the pool" for k in range(40)]
    docs = [(i, "\n".join([pool[0]] * rng.randint(1, 3) + rng.sample(pool, rng.randint(0, 4)) + [f"line of document {i} alone, long enough"])) for i in range(3000)]
    docs.append((4000, "\n".join(f"{k % 7000} line of a very long text" for k in range(60000))))
    assert report(spark, docs) == brute(docs)


def stream(rows, sizes):
    """Drops of sorted rows (hash, doc) read as one partition a list, in batches of some size, and settled together."""
    lost, edge = set(), []
    for part, size in zip(rows, sizes):
        table = pa.table({"hi": pa.array([h for h, _ in part], pa.int64()), "lo": pa.array([0] * len(part), pa.int64()), "doc_id": pa.array([d for _, d in part], pa.int64()), "row_key": pa.array([0] * len(part), pa.int64()), "places": pa.array([[0]] * len(part), pa.list_(pa.int32()))})
        for out in m.lost_rows(iter(table.to_batches(max_chunksize=size))):
            for r in out.to_pylist():
                edge.append(r) if r["open"] else lost.add((r["hi"], r["doc_id"]))
    sums, last = {}, {}
    for r in edge:
        sums[r["hi"]] = sums.get(r["hi"], 0) + r["docs"]
        last[r["hi"]] = max(last.get(r["hi"], r["doc_id"]), r["doc_id"])
    return lost | {(r["hi"], r["doc_id"]) for r in edge if r["places"] is not None and sums[r["hi"]] >= 3 and r["doc_id"] < last[r["hi"]]}


def test_runs_across_batches_and_partitions():
    rng = random.Random(9)
    for _ in range(150):
        rows = sorted({(rng.randint(0, 5), rng.randint(0, 9)) for _ in range(rng.randint(1, 40))}, key=lambda r: (r[0], -r[1]))
        rows = [r for r in rows for _ in range(rng.choice((1, 1, 2)))]
        cuts = sorted({rng.randint(0, len(rows)) for _ in range(rng.randint(0, 4))})
        cuts = [c for c in cuts if not 0 < c < len(rows) or rows[c] != rows[c - 1]]  # equal range keys share a partition
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        held = {}
        for h, d in rows:
            held.setdefault(h, set()).add(d)
        want = {(h, d) for h, ds in held.items() if len(ds) >= 3 for d in ds if d != max(ds)}
        assert stream(parts, [rng.randint(1, 7) for _ in parts]) == want


def test_bitmaps_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"{A}\n{i}\n{B}", f"k{i}", i) for i in range(4)], "doc_id long, text string, line_keep string, row_key int")
    out = m.drop_common_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(i, f"{i}" if i < 3 else f"{A}\n3\n{B}", f"k{i}", i) for i in range(4)]
    maps = m.keep_bitmaps(docs).collect()
    assert sorted(r["doc_id"] for r in maps) == [0, 1, 2]
    assert m.kept_lines(b"a\nb\nc\nd", maps[0]["keep"]) == (4, [b"b", b"d"])
    assert m.line_report(docs.limit(0)).collect() == []
