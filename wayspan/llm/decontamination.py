"""Benchmark decontamination with suffix arrays over the words of the training documents.

Every chunk of documents is a shard with a suffix array of its words. Each test suffix (a window of test
words) is binary-searched in every shard; the interval that it finds holds all verbatim matches with their
locations. Matches on one diagonal join to the longest verbatim matches. The array leaves out suffixes that
cannot begin any test window: their first words are looked up in small tables of the test windows' first
words, so nothing that could match is missing. Words compare by 64-bit hashes.

The test set is the stated query set. It is taken in blocks of at most BLOCK_BYTES of text, and only a block
is sent to the executors, so what is sent has a bound however large the test set is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import ALNUM, chunked, utf8_view, word_hashes, written

#: Words of a window.
WINDOW = 10
#: Bytes of test text that are searched for together.
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22


def _mix(code: np.ndarray, word: np.ndarray) -> np.ndarray:
    code = code * np.uint64(0x9E3779B97F4A7C15) + word
    return code ^ (code >> np.uint64(31))


class TestIndex:
    """Windows of the test items, one matrix of word hashes for each window length."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.ids = np.array(item_ids, dtype=object)
        self.window = window
        data, offsets = utf8_view(pa.array(texts, pa.string()))
        words, _, _, bounds = word_hashes(data, offsets, ALNUM)
        by_length: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item in range(len(texts)):
            own = words[bounds[item] : bounds[item + 1]]
            length = min(len(own), window)
            for at in range(len(own) - length + 1 if length else 0):
                by_length.setdefault(length, []).append((own[at : at + length], item, at))
        self.lengths = {}
        for length, rows in by_length.items():
            matrix = np.array([r[0] for r in rows], np.uint64).reshape(len(rows), length)
            heads, code = [], np.zeros(len(rows), np.uint64)
            for k in range(min(length, 4)):
                code = _mix(code, matrix[:, k])
                table = np.zeros(1 << _TABLE_BITS, bool)
                table[(code >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
                heads.append(np.packbits(table))
            self.lengths[length] = (matrix, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), heads)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All matches in a shard: word position, length, item and position in the item."""
        found: list[tuple[np.ndarray, ...]] = []
        ends = np.repeat(bounds[1:], np.diff(bounds))  # of each word's document
        for length, (matrix, items, ats, heads) in self.lengths.items():
            where = np.flatnonzero(np.arange(len(words)) + length <= ends)
            code = np.zeros(len(where), np.uint64)
            for k, packed in enumerate(heads):
                table = np.unpackbits(packed).view(bool)
                code = _mix(code, words[where + k])
                keep = table[(code >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
                where, code = where[keep], code[keep]
            if not len(where):
                continue
            kind = f"S{8 * length}"
            rows = np.ascontiguousarray(words[where[:, None] + np.arange(length)].astype(">u8")).view(kind).ravel()
            order = np.argsort(rows, kind="stable")  # the suffix array, as far as windows look
            suffixes = rows[order]
            tests = np.ascontiguousarray(matrix.astype(">u8")).view(kind).ravel()
            left, right = np.searchsorted(suffixes, tests, "left"), np.searchsorted(suffixes, tests, "right")
            hits = np.flatnonzero(right > left)
            count = (right - left)[hits]
            spread = np.repeat(hits, count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = where[order[left[spread] + inner]]
            found.append((at, np.full(len(at), length), items[spread], ats[spread]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[TestIndex]:
    """Test indexes of at most about BLOCK_BYTES of text each; one at least. Items without an id are searched too."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()
        part.sort(key=lambda r: (r.i is None, r.i or "", r.t or ""))
        yield TestIndex([r.i for r in part], [r.t for r in part], window)


def _shards(batches: Iterator[pa.RecordBatch], text: str):
    for batch in batches:
        data, offsets = utf8_view(batch.column(batch.schema.get_field_index(text)))
        for a, b in chunked(offsets):
            words, _, _, bounds = word_hashes(data, offsets[a : b + 1], ALNUM)
            yield batch, a, b, words, bounds


def _longest(bounds: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The longest verbatim matches of a shard: windows that follow each other on one diagonal are one match. Row, first
    word in the shard, words, item and first word in the item."""
    at, length, items, item_at = found
    of = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((at, at - item_at, items, of))
    at, length, items, item_at, of = (x[order] for x in (at, length, items, item_at, of))
    same = (of[1:] == of[:-1]) & (items[1:] == items[:-1]) & (np.diff(at - item_at) == 0) & (np.diff(at) == 1)
    first = np.flatnonzero(np.r_[np.ones(min(1, len(at)), bool), ~same])
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return of[first], at[first], at[last] - at[first] + length[last], items[first], item_at[first]


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches of a window or more: doc_id, item_id (string), doc_word, item_word, n_words
    (first words and length). A short item is one window. Null texts and items without words match nothing; an
    item without an id has a null item_id."""
    spark, schema = docs.sparkSession, "doc_id long, item_id string, doc_word long, item_word long, n_words long"
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _blocks(benchmark, item, text, window):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, a, b, words, bounds in _shards(batches, "text"):
                of, at, n, items, item_at = _longest(bounds, sent.value.search(words, bounds))
                if len(of):
                    ids = batch.column(0).slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(sent.value.ids[items], pa.string()), pa.array(at - bounds[of]), pa.array(item_at), pa.array(n)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit (words inside a match), n_items (items with matching
    windows), items_sha256 (their ids, sorted as strings, comma-joined), contaminated and longest (words of the longest
    verbatim match).

    Null and empty texts have no words and no hits. Repeated rows give repeated rows. Items without an id count
    as hits and, together, as one item, which the list of ids leaves out. Other columns of the input are ignored.
    An empty test set leaves every document clean. With a test set of several blocks the rows are first written
    with a key of their own, by which the blocks' results are merged.
    """
    spark, schema = docs.sparkSession, "doc_id long, n_words long, key long, spans binary, items array<string>"
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("key"))

    def finder(sent):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, a, b, words, bounds in _shards(batches, "text"):
                of, at, n, items, _ = _longest(bounds, sent.value.search(words, bounds))
                spans: list[bytes | None] = [None] * (b - a)
                named: list[list[str] | None] = [None] * (b - a)
                for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                    d = of[part[0]]
                    pairs = np.unique(np.stack([at[part] - bounds[d], at[part] - bounds[d] + n[part]], 1), axis=0)
                    spans[d] = pairs.astype("<i8").tobytes()
                    named[d] = list(set(sent.value.ids[np.unique(items[part])]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), batch.column(2).slice(a, b - a), pa.array(spans, pa.binary()), pa.array(named, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "key", "spans", "items"],
                )

        return find

    sent = [spark.sparkContext.broadcast(x) for x in _blocks(benchmark, item, text, window)]
    if len(sent) > 1:
        rows = written(rows, "keyed")
    parts = [rows.mapInArrow(finder(x), schema) for x in sent]
    if len(parts) == 1:
        merged = parts[0].select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        merged = merged.groupBy("doc_id", "n_words", "key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).drop("key")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, longest, count, named = [], [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pairs = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans if s] or [np.zeros((0, 2), np.int64)])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(np.r_[0, pairs[:-1, 1]]) if len(pairs) else np.zeros(0, np.int64)
                hit.append(int(np.maximum(0, pairs[:, 1] - np.maximum(pairs[:, 0], reach)).sum()))
                longest.append(int((pairs[:, 1] - pairs[:, 0]).max()) if len(pairs) else 0)
                own = {x for part in items if part for x in part}
                count.append(len(own))
                named.append(hashlib.sha256(",".join(sorted(own - {None})).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(named, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(longest, pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
            )

    return merged.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without those in which any test window occurs.

    Rows pass through the search itself, so nothing is joined back: repeated rows, null ids and extra
    columns stay as they are; null texts are kept.
    """
    spark = docs.sparkSession
    out = docs
    for index in _blocks(benchmark, "item_id", "text", window):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, a, b, words, bounds in _shards(batches, text):
                at = sent.value.search(words, bounds)[0]
                keep = np.ones(b - a, bool)
                keep[np.searchsorted(bounds, at, "right") - 1] = False
                yield batch.slice(a, b - a).filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents), b as materialized (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as materialized (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as g from (select item, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from iw) where len(w) >= n)),
h as materialized (select doc_id, n, i, item from dw join iw using (n, g)),
ip as (select k, n, j, array_to_string(w[j : j + n - 1], ' ') as g from (select k, w, least(len(w), {WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as j from (select row_number() over () as k, w from b where len(w) > 0))),
g as (select doc_id, k, n, i, i - j as d, i - row_number() over (partition by doc_id, k, i - j order by i) as island from dw join ip using (n, g)),
m as (select doc_id, max(c) as longest from (select doc_id, count(*) + any_value(n) - 1 as c from g group by doc_id, k, d, island) group by doc_id),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(longest, 0) as longest, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join m on d.doc_id = m.doc_id left join s on d.doc_id = s.doc_id
"""
