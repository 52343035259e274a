import zlib

import numpy as np

from wayspan.llm.sharding import assign_shards, jump, op5_jump_hash


def jump_one(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    for shards in (1, 2, 16, 17):
        assert jump(keys, shards).tolist() == [jump_one(int(k) % (1 << 64), shards) for k in keys]
    old, new = jump(keys, 16), jump(keys, 17)
    assert set(new[new != old]) == {16}
    assert 0.03 < (new != old).mean() < 0.09


def test_query(spark, sf):
    rows = op5_jump_hash(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, 1), (None, "", 2), (3, "a", 3), (3, "a", 3), (4, "x" * 100000, 4)], "doc_id long, text string, shard int")
    rows = assign_shards(odd, 3).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert set(assign_shards(odd, 3).columns) == {"doc_id", "text", "shard_", "shard", "grown_shard", "slot"}
    assert sorted(r.shard_ for r in rows) == [1, 2, 3, 3, 4]
    assert assign_shards(odd.limit(0), 3).count() == 0
