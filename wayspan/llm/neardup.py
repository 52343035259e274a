"""Near-duplicate classes by HyperMinHash.

A document's set holds its distinct word shingles. Each of REGISTERS buckets has a hash function of its own,
so no bucket is empty and short texts are found as surely as long ones; of a bucket's smallest hash the count
of leading zeros and ten mantissa bits are stored, 16 bits in all. Registers in bands retrieve candidates;
the register agreement, corrected for the collisions that compressed registers make by chance, estimates the
Jaccard similarity and drops pairs far below the limit; the rest are verified on the full sets.

A band's bucket may hold a third of all documents, so its members are never all paired with each other, and
what is verified grows with the links that components need:

1. Every node is verified against one other only, the hub (smallest node) with which it shares most buckets.
2. Buckets that still hold several components are dealt in blocks of bounded size. Inside a task the members
   outside the bucket's largest component meet the others by registers, then by parity sketches: the bits in
   which two sketches differ bound the symmetric difference from below, so a pair that they rule out has no
   link. Of pairs that are nearly sure a block sends two spanning forests of its components (a few look nearer than they
   are), of the others each outsider its few best; a pair comes from the first band that the two share.
3. Found links merge components, failed pairs are remembered, and the buckets that sent something are looked
   at again, until no bucket has a pair of different components left that is neither tested nor ruled out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import SPACED, chunked, mixed, pair_hash, utf8_view, word_hashes, written

#: A pair at exactly 0.8 shares 16 of the bands on average; none with a probability of 5e-9, two at most with 1e-6.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Pairs whose estimate lies so many standard errors below the limit are not verified.
SIGMAS = 4.5
#: Doubtful partners that an outsider of a bucket sends to verification in the first round, and how many times more in
#: each later one, so few rounds do.
NEAREST, MORE = 8, 4
#: Similarity by parity sketches from which a pair is taken for a link when a block chooses what to send.
SURE = 0.82
#: Outsiders and members of a bucket whose registers meet in one task.
OUTSIDERS, MEMBERS = 1024, 8192
#: Bits of a parity sketch for each member of the set, rounded up to a power of two.
PARITY = 16

_rng = np.random.default_rng(7)
_SCALE = _rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each row. Fewer words than a shingle has are one shingle."""
    words, _, _, bounds = word_hashes(data, offsets, SPACED)
    rolled = words
    for k in range(1, size):
        rolled = pair_hash(rolled[: len(rolled) - 1], words[k:]) if len(words) > k else rolled[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = pair_hash(whole, words[k : k + 1])
            yield mixed(whole + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers of a set that isn't empty: leading zeros, then mantissa bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        hashes = _SCALE[:, None] * x[None, at : at + 1024] + _SHIFT[:, None]
        np.minimum(least, hashes.min(axis=1), out=least)
    zeros = 31 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.uint32)
    mantissa = ((least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA_BITS)
    return ((zeros << np.uint32(MANTISSA_BITS)) | mantissa.astype(np.uint32)).astype("<u2")


def chance_collisions() -> np.ndarray:
    """Probability that the registers of unrelated sets of 2 ** k members agree, k = 0 to 32."""
    level = 2.0 ** -np.arange(1, 33)[:, None]
    low = level * (1 + np.arange(1 << MANTISSA_BITS)[None, :] / (1 << MANTISSA_BITS))
    high = low + level / (1 << MANTISSA_BITS)
    return np.array([((np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-15)))) ** 2).sum() for n in 2.0 ** np.arange(33)])


_CHANCE = chance_collisions()


def estimated(agree: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, chance agreement taken out."""
    level = np.clip(np.rint((np.log2(np.maximum(size_a, 1)) + np.log2(np.maximum(size_b, 1))) / 2), 0, 32).astype(int)
    return (agree - _CHANCE[level]) / (1 - _CHANCE[level])


def sketches(docs: DataFrame, shingle: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, fp (128-bit digest of the set) and sig (registers); both null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for a, b in chunked(offsets):
                n, fp, sig = [], [], []
                for s in shingle_sets(data, offsets[a : b + 1], shingle):
                    n.append(len(s))
                    fp.append(digest(s))
                    sig.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, fp binary, sig binary")


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that say of each slot whether an odd number of the set's members fall into it. Sketches of two sets
    differ in no more slots than the sets differ in members; halves of a sketch, xored, are the smaller sketch."""
    slots = 64
    while slots < PARITY * len(shingles):
        slots *= 2
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little")


def parity_gaps(sketch: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the pairs (a, b) of sketches the slots in which they differ, and about how many members do."""
    length = np.array([len(x) for x in sketch])
    least, level = np.zeros(len(a), np.int64), np.minimum(length[a], length[b]) if len(a) else np.zeros(0, np.int64)
    for n in np.unique(level):
        mine = np.flatnonzero(level == n)
        nodes, back = np.unique(np.r_[a[mine], b[mine]], return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(sketch[i].reshape(-1, n), axis=0) for i in nodes]).view(np.uint64)
        left, right = back[: len(mine)], back[len(mine) :]
        step = max(1, (1 << 24) // int(n))
        for at in range(0, len(mine), step):
            least[mine[at : at + step]] = np.bitwise_count(folded[left[at : at + step]] ^ folded[right[at : at + step]]).sum(axis=1)
    slots = np.maximum(8.0 * level, 1)
    return least, -slots / 2 * np.log(np.maximum(1e-9, 1 - 2 * least / slots))


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, n, sig (as given), members (all shingles) and parity (sketch) of rows (node, sig, fp, text) whose text has
    the digest fp."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column(3))
            for a, b in chunked(offsets):
                wanted = batch.column(2).slice(a, b - a).to_pylist()
                own = [s if fp == digest(s) else None for s, fp in zip(shingle_sets(data, offsets[a : b + 1], shingle), wanted, strict=True)]
                keep = pa.array([s is not None for s in own])
                own = [s for s in own if s is not None]
                ends = np.cumsum([0, *map(len, own)])
                flat = pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                sketch = pa.array([parity_sketch(s).tobytes() for s in own], pa.binary())
                given = [batch.column(k).slice(a, b - a).filter(keep) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([given[0], pa.array(np.diff(ends)), given[1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), sketch], ["node", "n", "sig", "members", "parity"])

    return docs.select("node", "sig", "fp", "text").mapInArrow(members, "node long, n long, sig binary, members array<long>, parity binary")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the ends of links (a, b): smallest labels spread over the
    links and along their own pointers until nothing changes; only that test comes to the driver."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        told = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        onward = labels.select(F.col("node").alias("mid"), F.col("component").alias("next"))
        step = written(told.join(onward.hint("merge"), "mid").select("node", "old", F.least("mid", "next").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def rooted(labels: DataFrame) -> DataFrame:
    """(node, component): where each node's pointer (component, never larger than the node) leads in the end."""
    while True:
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = written(labels.join(onward.hint("merge"), "component").select("node", F.col("component").alias("old"), F.col("next").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def floor_of(percent: int) -> float:
    """Estimate below which a pair is not verified."""
    j = percent / 100
    return j - SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5


class Forests:
    """Two spanning forests over components that grow by links taken for granted."""

    def __init__(self, n: int):
        self.up = np.tile(np.arange(n), (2, 1))

    def root(self, k: int, c: int) -> int:
        up = self.up[k]
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    def roots(self, k: int) -> np.ndarray:
        up = self.up[k]
        while (up[up] != up).any():
            up = up[up]
        self.up[k] = up
        return up

    def added(self, a: int, b: int) -> bool:
        """Whether a link between two components is new to a forest; it then belongs to the first such one."""
        for k in (0, 1):
            x, y = self.root(k, a), self.root(k, b)
            if x != y:
                self.up[k, max(x, y)] = min(x, y)
                return True
        return False


def _block_pairs(table: pa.Table, failed: pa.Table, percent: int, nearest: int) -> pa.Table:
    """Untested pairs of different components of a block that neither registers nor parity sketches rule out, with both
    components: two spanning forests of those that are nearly sure, and for each outsider the `nearest` best of others
    between components that the sure ones leave apart. A pair that several bands share comes from the first of them."""
    out: dict[str, list] = {k: [] for k in ("a", "b", "band", "c_a", "c_b")}
    if table.num_rows:
        names = ("node", "component", "n", "outer", "outsider")
        node, component, size, outer, outsider = (table.column(c).to_numpy() for c in names)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, REGISTERS)
        sketch = [np.frombuffer(x, np.uint8) for x in table.column("parity").to_pylist()]
        barred = set(zip(failed.column("a").to_pylist(), failed.column("b").to_pylist(), strict=True))
        left, right = np.flatnonzero(outsider), np.flatnonzero(~outsider)
        key, floor = table.column("band")[0].as_py(), floor_of(percent)
        band = key & 63
        every, code = np.unique(component, return_inverse=True)
        forests, sent = Forests(len(every)), Counter()
        for at in range(0, len(left), 8):
            block = left[at : at + 8]
            low, high = np.minimum(size[block][:, None], size[right][None, :]), np.maximum(size[block][:, None], size[right][None, :])
            second = forests.roots(1)[code]  # what both forests join needs no further pair
            close = (second[block][:, None] != second[right][None, :]) & (~outer[right][None, :] | (node[block][:, None] < node[right][None, :])) & (low * 100 >= high * percent)
            if not close.any():
                continue
            same = sig[block][:, None, :] == sig[right][None, :, :]
            guess = estimated(np.count_nonzero(same, axis=2) / REGISTERS, low, high)
            x, y = np.nonzero(close & (guess >= floor))
            first = same[x, y].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            x, y = x[first], y[first]
            least, about = parity_gaps(sketch, block[x], right[y])
            both = size[block[x]] + size[right[y]]
            alike, possible = (both - about) / (both + about), least * (100 + percent) <= both * (100 - percent)
            x, y, alike = block[x[possible]], right[y[possible]], alike[possible]
            order = np.lexsort((node[y], x, -alike))
            for i, j, near in zip(x[order].tolist(), y[order].tolist(), alike[order].tolist(), strict=True):
                p, q = (i, j) if node[i] < node[j] else (j, i)
                if (int(node[p]), int(node[q])) in barred:
                    continue
                if near >= SURE:
                    if not forests.added(code[i], code[j]):
                        continue
                elif sent[i] == nearest or forests.root(0, code[i]) == forests.root(0, code[j]):
                    continue
                else:
                    sent[i] += 1
                for k, v in zip(out, (node[p], node[q], key, component[p], component[q]), strict=True):
                    out[k].append(int(v))
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _across(told: DataFrame, sizes: DataFrame, failed: DataFrame, sets: DataFrame, percent: int, nearest: int) -> DataFrame:
    """Candidates (a, b, band, c_a, c_b) of different components in the buckets told (band, node, component). Large
    buckets are dealt in blocks of outsiders and members, so a task holds registers of a bounded number."""
    blocks = sizes.select("band", "top", F.ceil((F.col("n") - F.col("top_n")) / OUTSIDERS).cast("int").alias("_o"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("_m"))
    rows = told.join(blocks.hint("merge"), "band").join(sets.select("node", "n", "sig", "parity").hint("merge"), "node")
    rows = rows.withColumn("outer", F.col("component") != F.col("top"))
    columns = ["band", "node", "component", "n", "sig", "parity", "outer"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda node, n: F.pmod(F.xxhash64(node), F.col(n)).cast("int")
    members = rows.select(*columns, F.lit(False).alias("outsider"), own("node", "_m").alias("m"), every("_o").alias("o"))
    outsiders = rows.where("outer").select(*columns, F.lit(True).alias("outsider"), every("_m").alias("m"), own("node", "_o").alias("o"))
    tested = failed.join(blocks.hint("merge"), "band")
    tested = tested.select("a", "b", "band", own("a", "_o").alias("o"), own("b", "_m").alias("m")).unionByName(tested.select("a", "b", "band", own("b", "_o").alias("o"), own("a", "_m").alias("m")))
    dealt = members.unionByName(outsiders).groupBy("band", "o", "m").cogroup(tested.groupBy("band", "o", "m"))
    return dealt.applyInArrow(lambda t, f: _block_pairs(t, f, percent, nearest), "a long, b long, band long, c_a long, c_b long")


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimated similarity leave a link possible."""
    floor = floor_of(percent)

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), "<u2").reshape(-1, REGISTERS) for s in (x, y))
        return pd.Series(estimated((left == right).mean(axis=1), n.to_numpy(), m.to_numpy()) >= floor)

    told = pairs
    for name in ("b", "a"):
        told = told.join(sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")).hint("merge"), name)
    told = told.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return told.where(likely("sig_a", "sig_b", "n_a", "n_b")).select(pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked: whether 100 x intersection >= percent x union of their full sets."""
    told = pairs
    for name in ("b", "a"):
        told = told.join(sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("members").alias(f"set_{name}")).hint("merge"), name)
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    told = told.select(*pairs.columns, both.alias("_i"), (F.col("n_a") + F.col("n_b")).alias("_n"))
    return told.select(*pairs.columns, (F.col("_i") * 100 >= (F.col("_n") - F.col("_i")) * percent).alias("linked"))


def _classes(docs: DataFrame, shingle: int, percent: int, doc: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = written(sketches(rows, shingle), "sketches")
    reps = sketched.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("named"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers of the table as written

    # a bucket's key: a hash of the band's registers, the band's number in its last six bits
    key = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(i))
    bands = reps.select("node", F.explode(F.array(*map(key, range(BANDS)))).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").drop("_last")
    members = written(bands.join(shared.hint("merge"), "band"), "members")
    # one shuffle by node counts the buckets with every hub and picks the hub with most; a node may be its own alone
    counts = members.repartition("node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("hub", F.when(F.col("node") != F.col("hub"), F.struct("n", "hub")))
    met = written(counts.groupBy("node").agg(best.alias("hub")), "met")

    wanted = reps.select("node", "fp", "sig", "named").join(met.select("node").hint("merge"), "node")
    texts = rows.where("doc_id is not null").join(wanted.where("named is not null").select(F.col("named").alias("doc_id"), "node", "fp", "sig").hint("merge"), "doc_id")
    sets = full_sets(texts.dropDuplicates(["doc_id", "fp", "text"]), shingle)
    if not wanted.where("named is null").isEmpty():
        lone = rows.where("doc_id is null").select("text").distinct()
        own = lone.withColumn("doc_id", F.xxhash64("text"))  # joins digests to texts, full_sets drops what differs
        own = own.join(sketches(own, shingle).select("doc_id", "fp").hint("merge"), "doc_id").join(wanted.where("named is null").select("node", "fp", "sig").hint("merge"), "fp")
        sets = sets.unionByName(full_sets(own.dropDuplicates(["node"]), shingle))
    sets = written(sets, "sets")

    # every node has one link at most, to a smaller node: pointers
    pairs = written(likely_pairs(met.where("hub is not null").select(F.col("hub").alias("a"), F.col("node").alias("b")), sets, percent), "likely")
    first = verified(pairs, sets, percent).where("linked").select(F.col("b").alias("node"), F.col("a").alias("component")).distinct()
    labels = rooted(written(met.select("node").join(first.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels"))
    live, failed, nearest = members.select("band", "node"), None, NEAREST
    while True:
        labelled = written(live.join(labels.hint("merge"), "node").select("band", "node", "component"), "labelled")
        groups = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
        sizes = groups.groupBy("band").agg(F.max(F.struct("size", "component")).alias("_top"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        sizes = written(sizes.select("band", F.col("_top.component").alias("top"), F.col("_top.size").alias("top_n"), "n"), "open")
        known = failed if failed is not None else sizes.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "band").limit(0)
        more = written(_across(labelled, sizes, known, sets, percent, nearest), "pairs")
        if more.isEmpty():
            break
        tested = written(verified(more, sets, percent), "tested")
        merged = components(tested.where("linked").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        labels = written(labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_c")).hint("merge"), "component", "left").select("node", F.coalesce("_c", "component").alias("component")), "labels")
        lost = tested.where("not linked").select("a", "b", "band")
        failed, nearest = lost if failed is None else failed.unionByName(lost), nearest * MORE
        live = labelled.join(more.select("band").distinct().hint("merge"), "band", "left_semi").select("band", "node")

    grouped = reps.select("fp", "node", "named").join(labels.hint("merge"), "node", "left").select("fp", "named", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("named").alias("component_id"))
    named = grouped.select("fp", "component").join(names.hint("merge"), "component").select("fp", "component_id")
    out = sketched.select("doc_id", "n_shingles", "fp").join(named.hint("merge"), "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable
    over links, itself included) and kept (doc_id is component_id).

    Ids may be any 64-bit number. Null, empty and blank texts have an empty set, link with nothing and are kept.
    Equal sets are one node. Rows that share an id and a text get the same result; with several texts under one
    id every row is judged by its own text. Rows without an id are nodes too, but give their class no name: their
    component_id is the smallest id of the class or null, and they are kept only in the latter case. Other
    columns are ignored; an empty table gives an empty one.
    """
    return _classes(docs, shingle, percent, doc, text)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, one document of each class. Rows that share an id stay if one of them is
    kept; rows without an id stay."""
    classes = near_duplicates(docs.select("doc_id", "text"), shingle, percent).where("doc_id is not null")
    gone = written(classes.groupBy("doc_id").agg(F.max("kept").alias("_k")).where("not _k").select("doc_id"), "gone")
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 2-word shingle sets are similar to 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
