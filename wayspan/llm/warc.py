"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id into shards whose bounds come from exact payload sums of id bins, not from samples, so
every run cuts at the same places. Bins are of equal width at first; those that hold too much are split again within
the ids that they hold, so neither outlying nor dense ids fill a shard. A shard's task writes gzip members, one a record,
and rolls to the next file when the compressed size reaches a limit. Headers, record ids and digests are
made from the payload alone; of equal payloads the one with the largest id is a response and the others
revisit it. Files are written under names of the task attempt and renamed when complete; a manifest that is
itself renamed into place last names the files that count. A retried or speculative task writes the same
bytes, so whichever attempt renames last changes nothing.

Files go to any folder that pyarrow's filesystems reach (local or mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayspan.llm.common import shared_folder, written

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16 << 20
#: Payload bytes that a shard is to have, about; rows of one id stay together.
SHARD_BYTES = 32 << 20
#: Bins at first, parts that a heavy one is split into, and how many heavy ones there are at most (a bin is heavy with
#: more than a shard's bytes and this part of all), which bounds what the driver holds.
BINS, SPLIT, HEAVY = 1 << 14, 1 << 6, 1 << 16
#: Compressed bytes that a member is inflated from at a time; what lies behind a member's end is copied once a member.
STEP = 1 << 12
DATE = "2024-01-01T00:00:00Z"
FILES = "shard int, seq int, file string, records long, payload_bytes long, file_bytes long, sha256 string, first_id long, last_id long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its HTTP block, or a revisit that names the response of the same payload."""
    name = "null" if page_id is None else str(page_id)
    urn = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{n}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(name)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"X-Page-ID: {name}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record, digests checked: headers, block and payload (of a revisit: none)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != length or fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}"):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return {"fields": fields, "payload": payload, "payload_bytes": length}


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + STEP]
            if not piece:
                raise ValueError("a gzip member is cut short")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def _files_at(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def bin_of(ids: Column, starts: np.ndarray) -> Column:
    """Number of the last bin that starts at or before an id; null ids are in the first."""

    @F.pandas_udf("int")
    def number(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, x.to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

    return number(F.coalesce(ids, F.lit(int(starts[0]))))


def _shards(ids: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """bin and shard of every id bin, and the ids at which bins start (BINS + a bounded number a pass)."""
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    low, high, total = low or 0, high or 0, total or 0
    width = max(1, -(-(high - low + 1) // BINS))
    starts = np.array(range(low, high + 1, width), np.int64)
    while True:
        sums = ids.groupBy(bin_of(F.col("id"), starts).alias("bin")).agg(F.sum("size").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
        heavy = sums.where((F.col("size") > max(SHARD_BYTES, total // HEAVY)) & (F.col("low") < F.col("high"))).collect()
        if not heavy:
            break
        more = [range(r.low, r.high + 1, -(-(r.high - r.low + 1) // SPLIT)) for r in heavy]
        starts = np.unique(np.concatenate([starts, *[np.array(x, np.int64) for x in more]]))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over the bins
    cuts = sums.select("bin", F.floor(F.coalesce(F.sum("size").over(upto), F.lit(0)) / F.lit(SHARD_BYTES)).cast("int").alias("shard"))
    return cuts, starts


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 6, least_payload: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest, read from the folder.

    Null html is an empty payload, null urls are empty; rows without an id come first and may only revisit;
    rows that repeat an id write a record each, all but one revisits if the payloads agree; an empty table
    writes no files and an empty manifest. Extra columns are ignored.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = own.withColumns({"size": F.octet_length("html").cast("long"), "sha": F.sha1(F.col("html").cast("binary"))})
    keys = written(keyed.select("id", "size", "sha"), "payloads")
    # written and read back: its real size decides how it is joined, and a payload that many pages share is a skewed join's split
    shared = keys.where(F.col("size") >= least_payload).groupBy("sha", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").drop("n")
    shared = written(shared, "shared")
    cuts, starts = _shards(keys)
    cuts = written(cuts, "cuts")
    n_shards = (cuts.agg(F.max("shard")).first()[0] or 0) + 1
    placed = keyed.withColumn("bin", bin_of(F.col("id"), starts)).join(F.broadcast(cuts), "bin")  # a row a bin
    told = placed.join(shared, ["sha", "size"], "left")
    first = Window.partitionBy("id", "sha", "size").orderBy("url")
    repeats = keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null")
    if repeats.isEmpty():
        told = told.withColumn("nth", F.lit(1))
    else:
        told = told.withColumn("nth", F.row_number().over(first))
    refers = F.when(F.col("response").isNotNull() & ((F.col("id").isNull()) | (F.col("id") != F.col("response")) | (F.col("nth") > 1)), F.col("response"))
    rows = told.select("shard", "id", "url", "html", refers.alias("refers_to"))
    # the shard is the partition: ranges would be cut by a sample of rows, which reads all text and lays shards together
    ordered = rows.repartitionById(n_shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "refers_to", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _files_at(folder)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        files.create_dir(at, recursive=True)
        done: list[tuple] = []
        sink, state = None, {}

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                name = f"part-{state['shard']:06d}-{state['seq']:05d}.warc.gz"
                files.move(state["temporary"], f"{at}/{name}")
                done.append((state["shard"], state["seq"], name, state["records"], state["payload"], state["bytes"], state["sha"].hexdigest(), state["first"], state["last"]))
                sink = None

        for batch in batches:
            for shard, page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is not None and (shard != state["shard"] or state["bytes"] >= roll_bytes):
                    close()
                if sink is None:
                    seq = state["seq"] + 1 if state and state["shard"] == shard else 0
                    state = {"shard": shard, "seq": seq, "temporary": f"{at}/_temporary-{attempt}-{shard:06d}-{seq:05d}", "records": 0, "payload": 0, "bytes": 0, "sha": hashlib.sha256(), "first": page, "last": page}
                    sink = files.open_output_stream(state["temporary"], compression=None)
                payload = html.encode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record_bytes(page, url, payload, refers)) + packer.flush()
                sink.write(raw)
                state["sha"].update(raw)
                state["records"] += 1
                state["payload"] += len(payload)
                state["bytes"] += len(raw)
                state["last"] = page
        close()
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], [x.split()[0] for x in FILES.split(", ")])

    ordered.mapInArrow(write, FILES).write.json(f"{folder}/_manifest.temporary")
    path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not hadoop.rename(path(f"{folder}/_manifest.temporary"), path(f"{folder}/_manifest")):
        raise OSError(f"the manifest in {folder} could not be put in place")
    return spark.read.schema(FILES).json(f"{folder}/_manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names: page_id, url, record_type, payload_digest,
    payload_bytes, refers_to and payload (null for revisits). A file that differs from its manifest row, or a
    record that differs from its digests, is an error."""
    manifest = spark.read.schema(FILES).json(f"{folder}/_manifest").select("file", "file_bytes", "sha256")
    named = manifest.repartitionByRange(max(manifest.count(), 1), "file")  # only names are dealt, a task a file

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _files_at(folder)
        for batch in batches:
            for name, size, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with files.open_input_stream(f"{at}/{name}", compression=None) as f:
                        content = f.read()
                except FileNotFoundError:
                    content = None
                if content is None or len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is missing or isn't what the manifest says")
                rows: list[tuple] = []
                for raw in members(content):
                    r = parse_record(raw)
                    f = r["fields"]
                    number = lambda x: None if x in (None, "null") else int(x)
                    rows.append((number(f["X-Page-ID"]), f["WARC-Target-URI"], f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload_bytes"], number(f.get("X-Refers-To-Page")), r["payload"] if f["WARC-Type"] == "response" else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return named.mapInArrow(parse, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
