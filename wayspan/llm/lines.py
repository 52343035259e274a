"""Lines that many documents share: every document but the last that holds such a line loses it.

Each eligible line sends a hash with its document and positions. The rows are range-partitioned by hash and document and
sorted by hash, document (largest first) and row, so that a task streams the runs of equal hashes: the first document of
a run keeps its lines, the others lose theirs once the run has enough documents. No text moves for that, and what comes
back is one compressed bitmap a document. A frequent line spans many partitions, as the document is part of the
range key; runs that touch the edge of a partition are settled by the sums of their pieces, at most two a partition.

Definitions: null text is one empty line; a document is a doc_id, so rows that repeat one are one document and lose the
same lines; a null doc_id is one document below all others; lines compare by 128-bit hashes of their keys; other columns
pass through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import chunked, unused_name, utf8_view, written

#: A line counts from so many code points of its key, and is dropped from so many documents on.
LINE_CHARS, LEAST_DOCS = 20, 3
#: What is stripped from both ends of a line.
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z as a-z (other letters stay)."""
    return line.strip(WHITE).lower()


def _long_enough(key: bytes) -> bool:
    return len(key) >= LINE_CHARS and (key.isascii() or len(key.decode("utf-8", "replace")) >= LINE_CHARS)


def line_hashes(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, row_key, text) and each distinct eligible line: hash (hi, lo) and positions."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for a, b in chunked(utf8_view(texts)[1]):
                row, digests, places = [], [], []
                for r, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    own: dict[bytes, list[int]] = {}
                    for at, line in enumerate((text or b"").split(b"\n")):
                        if _long_enough(key := line_key(line)):
                            own.setdefault(key, []).append(at)
                    row.extend([r] * len(own))
                    digests.extend(hashlib.blake2b(key, digest_size=16).digest() for key in own)
                    places.extend(own.values())
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(places, pa.list_(pa.int32()))],
                    ["hi", "lo", "doc_id", "row_key", "places"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(hashes, f"hi long, lo long, doc_id {kind}, row_key long, places array<int>")


class _Run:
    """The run of equal hashes at the end of what was read: its hash, documents so far, first and last document, and
    the rows of its second document, which are lost only if there is a third."""

    def __init__(self, hash_: tuple[int, int], whole: bool, docs: int, first, last, held: list[pa.RecordBatch]):
        self.hash, self.whole, self.docs, self.first, self.last, self.held = hash_, whole, docs, first, last, held


def _changed(column: pa.Array, before) -> np.ndarray:
    """Whether a row differs from the one before it, the first from the value before."""
    blank = column.is_null().to_numpy(zero_copy_only=False)
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.ones(len(values), bool)
    out[1:] = (values[1:] != values[:-1]) | (blank[1:] != blank[:-1])
    out[0] = column[0].as_py() != before
    return out


def lost_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by hash and document (largest first). Gives the rows that lose their lines (open false),
    and for runs that may have begun or may go on in another partition (open true) rows and counts of new documents."""

    def out(rows: pa.RecordBatch, open_: bool, docs=None) -> pa.RecordBatch:
        docs = np.zeros(len(rows), np.int32) if docs is None else docs.astype(np.int32)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), open_)), pa.array(docs)], [*rows.schema.names, "open", "docs"])

    run, blank = None, None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        blank = batch.slice(0, 0)
        hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
        starts = np.ones(n, bool)
        starts[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        starts[0] = run is None or (int(hi[0]), int(lo[0])) != run.hash
        new = _changed(batch.column("doc_id"), None if run is None else run.last) | starts
        at = np.flatnonzero(starts)
        number = np.cumsum(starts)  # 0: the run that goes on from the batch before
        before = np.concatenate(([run.docs if run else 0], -(np.cumsum(new)[at] - 1)))
        rank = np.cumsum(new) + before[number]  # a run's first document has rank 1
        last = np.append(at, n)[number] - 1
        total = rank[last]  # the last run may still grow
        opened = (number == 0) & bool(run and run.whole)
        if run is None:
            opened |= number == 1
        if run and run.held and number[0] == 0 and total[0] >= LEAST_DOCS:
            for rows in run.held:
                yield out(rows, False)
            run.held = []
        lost = ~opened & (rank >= 2) & (total >= LEAST_DOCS)
        for mask, is_open in ((lost, False), (opened, True)):
            if mask.any():
                yield out(batch.filter(pa.array(mask)), is_open, new[mask] if is_open else None)
        tail = number == number[-1]
        wait = tail & ~opened & (rank == 2) & (total < LEAST_DOCS)
        ids = batch.column("doc_id")
        if number[-1] == 0:
            whole, first, held = run.whole, run.first, run.held
        else:
            first_at = int(at[-1])
            whole, first, held = run is None and number[-1] == 1, ids[first_at].as_py(), []
        if wait.any():
            held = [*held, batch.filter(pa.array(wait))]
        run = _Run((int(hi[-1]), int(lo[-1])), whole, int(rank[-1]), first, ids[n - 1].as_py(), held)
    if run is not None and not run.whole:
        one = {"hi": run.hash[0], "lo": run.hash[1], "doc_id": run.first, "row_key": None, "places": None}
        yield out(pa.RecordBatch.from_pylist([one], blank.schema), True, np.array([run.docs]))
        for rows in run.held:
            yield out(rows, True)


def _with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", F.xxhash64("text"))


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """One zlib-compressed bitmap a row key: bit i says whether line i stays; lines beyond its end stay."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lists in batch.column("places").to_pylist():
                lost = np.concatenate([np.asarray(x, np.int64) for x in lists])
                keep = np.ones((int(lost.max()) // 8 + 1) * 8, bool)
                keep[lost] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(maps, pa.binary())], ["doc_id", "row_key", "keep"])

    kind = dropped.schema["doc_id"].dataType.simpleString()
    sets = dropped.groupBy("doc_id", "row_key").agg(F.collect_set("places").alias("places"))  # as many as the document has lines
    return sets.mapInArrow(encode, f"doc_id {kind}, row_key long, keep binary")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text) and keep (zlib-compressed bits, first line first) for each document
    that loses lines; documents without a row, and lines beyond a bitmap's end, keep everything."""
    lines = written(line_hashes(_with_row_key(docs.select("doc_id", "text"))), "lines")
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc_nulls_last()]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row_key")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    runs = written(ordered.mapInArrow(lost_rows, f"{columns}, open boolean, docs int"), "line-runs")
    pieces = runs.where("open").groupBy("hi", "lo").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= LEAST_DOCS).drop("n")
    # at most two open runs a partition, so their sums fit a broadcast at any size
    edge = runs.where("open and places is not null").join(F.broadcast(pieces), ["hi", "lo"]).where("doc_id is null or doc_id < keeper")
    dropped = runs.where("not open").select("doc_id", "row_key", "places").unionByName(edge.select("doc_id", "row_key", "places"))
    return written(_bitmaps(dropped), "line-bitmaps")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, list[bytes]]:
    """Number of lines of a text and those that its bitmap keeps."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return len(lines), [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def _with_bitmaps(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with each row's bitmap (null: all stays). A merge join: texts are sorted with spilling, hot ids split."""
    maps = keep_bitmaps(docs).select(F.col("doc_id").alias(names["id"]), F.col("row_key").alias(names["key"]), F.col("keep").alias(names["keep"]))
    same = docs["doc_id"].eqNullSafe(maps[names["id"]]) & (F.xxhash64(docs["text"]) == maps[names["key"]])
    return docs.join(maps.hint("merge"), same, "left").drop(names["id"], names["key"])


def _names(docs: DataFrame) -> dict[str, str]:
    return {k: unused_name(docs, f"line_{k}") for k in ("id", "key", "keep")}


def drop_common_lines(docs: DataFrame) -> DataFrame:
    """docs with the same columns and rows; text without its lost lines (null stays null)."""
    names, columns = _names(docs), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kind = batch.schema.field(at).type
            kept = [None if t is None else t if k is None else b"\n".join(kept_lines(t, k)[1]) for t, k in zip(batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(names["keep"]).to_pylist())]
            arrays = [pa.array(kept, pa.large_binary()).cast(kind) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names).select(columns)

    return _with_bitmaps(docs, names).mapInArrow(cut, docs.schema)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay."""
    docs = docs.select("doc_id", "text")
    names = _names(docs)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, lost, digests = [], [], []
            for t, k in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column(names["keep"]).to_pylist()):
                n, kept = kept_lines(t or b"", k)
                lines.append(n)
                lost.append(n - len(kept))
                digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs, names).mapInArrow(report, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as materialized (select doc_id, pos, line, {_KEY} as k from (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from s)),
c as (select k, max(doc_id) as keeper from l where length(k) >= {LINE_CHARS} group by k having count(distinct doc_id) >= {LEAST_DOCS})
select doc_id, count(*) as n_lines, count(*) filter (where doc_id < keeper) as n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or doc_id >= keeper), '')) as kept_sha256
from l left join c using (k) group by doc_id
"""
