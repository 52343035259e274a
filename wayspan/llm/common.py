"""Helpers that the text operators share: shared folders, Arrow text views and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel looks at together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which driver and executors share. Where the setting is
    empty a temporary folder is set as the checkpoint folder of a session on one machine (tests); on a cluster
    executors would not see it, so there the setting is needed."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, survives lost executors, has real sizes."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores behind it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def whitespace_words(text, pattern: str = r"[^\x20\x09-\x0D]+"):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


# --- Arrow text -> numpy ------------------------------------------------------------------------


def utf8_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunked(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most limit bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def byte_table(word_byte, seed: int = 20240517) -> np.ndarray:
    """For each byte an odd random number, or 0 where word_byte(byte) is None; equal images get equal numbers."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table = np.zeros(256, np.uint64)
    for b in range(256):
        image = word_byte(b)
        if image is not None:
            table[b] = values[image]
    return table


def lower_ascii(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


#: Words between white space, A-Z as a-z.
SPACED = byte_table(lambda b: None if b == 32 or 9 <= b <= 13 else lower_ascii(b))
#: Words of a-z, 0-9 and everything beyond ASCII, A-Z as a-z.
ALNUM = byte_table(lambda b: lower_ascii(b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else None)

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive rows: 64-bit hash, first byte, end byte (both within data[offsets[0]:]), and the
    n + 1 word offsets of the rows. Words never cross rows."""
    base = int(offsets[0])
    bounds = (offsets - base).astype(np.int64)
    n = int(bounds[-1])
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    values = table[data[base : base + n]]
    inside = values != 0
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F))
