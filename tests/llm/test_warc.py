import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from wayspan.llm import warc as w


def expected(rows):
    out, best = [], {}
    for page, html in rows:
        best[html] = max(best.get(html, page), page)
    for page, html in rows:
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        last = best[html]
        out.append((page, len(raw), digest, "response" if page == last else "revisit", None if page == last else last))
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in w.op3_warc(spark, sf).collect()) == expected(rows)


def test_rolling_revisits_and_determinism(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "SHARD_BYTES", 4000)
    rows = [(i * 7, f"http://x/{i}", None if i % 9 == 0 else f"<p>{'ü' * (i % 40)}{i % 23}</p>") for i in range(200)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bin int")
    seen = []
    for k, parts in ((0, 1), (1, 7)):
        folder = str(tmp_path / str(k))
        manifest = w.write_archives(frame.repartition(parts), folder, roll_bytes=900).collect()
        got = w.read_archives(spark, folder).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected([(r[0], r[2] or "") for r in rows])
        names = sorted(x for x in os.listdir(folder) if x.endswith(".gz"))
        assert names == sorted(m.file for m in manifest) and len(names) > 3 and not [x for x in os.listdir(folder) if "temporary" in x]
        seen.append({n: open(f"{folder}/{n}", "rb").read() for n in names})
        ids = []
        for n in names:
            text = gzip.decompress(seen[-1][n]).decode()
            ids += [int(x.split("\r\n")[0]) for x in text.split("X-Page-ID: ")[1:]]
        assert ids == sorted(ids)
    assert seen[0] == seen[1]


def test_damage_is_found(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = str(tmp_path / "d")
    name = w.write_archives(frame, folder).first().file
    raw = open(f"{folder}/{name}", "rb").read()
    with open(f"{folder}/{name}", "wb") as f:
        f.write(raw[:-3] + b"abc")
    try:
        w.read_archives(spark, folder).collect()
    except Exception as e:
        assert "manifest" in str(e)
    else:
        raise AssertionError("damage went unseen")


def test_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, "a"), (None, "u", None), (3, "u\nv", "a"), (3, "u\nv", "a"), (4, "", "x" * 300000)], "page_id long, url string, html string")
    folder = str(tmp_path / "o")
    w.write_archives(odd, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in w.read_archives(spark, folder).collect()), key=repr)
    assert got == sorted([(None, 1, "revisit", 3), (None, 0, "response", None), (3, 1, "response", None), (3, 1, "revisit", 3), (4, 300000, "response", None)], key=repr)
    empty = str(tmp_path / "e")
    assert w.write_archives(odd.limit(0), empty).count() == 0
    assert w.read_archives(spark, empty).count() == 0


def test_outlying_ids_do_not_fill_a_shard(spark, monkeypatch):
    monkeypatch.setattr(w, "SHARD_BYTES", 1000)
    ids = [*range(500), (1 << 63) - 1, -(1 << 63)]
    frame = spark.createDataFrame([(i, 50) for i in ids] + [(7, 50)] * 60, "id long, size long")
    cuts, starts = w._shards(frame)
    shard = {r.bin: r.shard for r in cuts.collect()}
    held = {}
    for i in ids:
        held.setdefault(shard[int(max(0, starts.searchsorted(i, "right") - 1))], []).append(i)
    assert len(held) >= 20 and max(map(len, held.values())) <= 42
    order = [i for k in sorted(held) for i in held[k]]
    assert sorted(ids) == sorted(order) and [min(v) for _, v in sorted(held.items())] == sorted(min(v) for v in held.values())


def test_members_are_inflated_once(monkeypatch):
    payloads = [b"", *(os.urandom(500) for _ in range(2000)), os.urandom(20000), b"x" * 100000]
    data = b"".join(gzip.compress(p) for p in payloads)
    fed = []

    class Counting:
        def __init__(self, bits):
            self.inner = inflate(bits)

        def decompress(self, piece):
            fed.append(len(piece))
            return self.inner.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    inflate = w.zlib.decompressobj
    monkeypatch.setattr(w.zlib, "decompressobj", Counting)
    assert list(w.members(data)) == payloads
    assert sum(fed) <= len(data) + len(payloads) * 4096


def test_cut_members_are_found():
    for cut in (1, 9):
        try:
            list(w.members(gzip.compress(b"one") + gzip.compress(b"two" * 50)[:-cut]))
        except ValueError as e:
            assert "cut short" in str(e)
        else:
            raise AssertionError("a cut went unseen")


def test_a_task_writes_one_shard_and_reads_no_table_of_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "SHARD_BYTES", 4000)
    rows = [(i, "u", "x" * (3000 if i < 12 else 10) + str(i)) for i in range(1200)]  # few long, then many short rows
    folder = str(tmp_path / "s")
    manifest = w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    held = {}
    for r in manifest.withColumn("part", F.input_file_name()).collect():
        held.setdefault(r.part, set()).add(r.shard)
    assert len(held) >= 10 and max(map(len, held.values())) == 1
    read = w.read_archives(spark, folder)
    assert read.count() == len(rows) and "Join" not in (plan := read._jdf.queryExecution().toString()) and "binaryFile" not in plan
    os.remove(f"{folder}/{manifest.first().file}")
    try:
        w.read_archives(spark, folder).count()
    except Exception as e:
        assert "is missing or isn't what the manifest says" in str(e)
    else:
        raise AssertionError("a missing file went unseen")
