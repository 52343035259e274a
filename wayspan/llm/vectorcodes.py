"""Product codes of vectors: each part of a vector becomes the number of the nearest entry of its codebook.

Codebooks are refined in rounds; a round sends them to all tasks (PARTS * ENTRIES entries and as many neighbour lists,
whatever the input), each task sums its vectors per entry, and the sums of all tasks give the next codebooks.

The nearest entry is found by Orchard's search: every entry has a list of all entries by distance from it. A search
starts at some entry and walks its list; an entry nearer to the vector becomes the current one, whose list is walked from
the front; entries met before are marked and skipped; the walk ends where the list goes beyond twice the current
distance, as by the triangle inequality nothing further out can be as near. Vectors of a batch search together. All
arithmetic is on integers, so the result is the exact nearest entry, ties to the lower index.

Definitions: rows whose vector is null, or has null or non-finite components, are dropped, as are vectors whose length
isn't the most frequent one that PARTS divides (ties: the longer); components beyond +-2^26 (after scaling) count as
+-2^26, so sums of squares stay in 64 bits up to 256 components a part. With fewer vectors than ENTRIES codebooks are as
short. Equal vec_ids are all kept; the first entries go by vec_id (null last), then vector. An empty table gives an empty
result. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import written
from wayspan.operators.sizes import small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Largest size of a scaled component, vectors that search together, and list entries that one looks at a step.
LIMIT, TOGETHER, BLOCK = 1 << 26, 4096, 16


def whole_vectors(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """ident, label and the integer components of the vectors that are kept."""
    value = F.col(vector)
    finite = ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(value, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    kept = df.where(value.isNotNull() & finite & (F.size(value) > 0) & (F.size(value) % PARTS == 0))
    kept = written(kept.select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), scaled.alias("v")), "vectors")
    length = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return kept if length is None else kept.where(F.size("v") == length["n"])


# --- Orchard's search ---------------------------------------------------------------------------


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("...k,...k->...", gap, gap)


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by squared distance from it (ties to the lower index), and these distances; a block
    beyond all distances ends each list."""
    gaps = squared(book[:, None, :], book[None, :, :])
    order = np.argsort(gaps, axis=1, kind="stable")
    end = np.full((len(book), BLOCK), np.iinfo(np.int64).max // 2)
    return np.hstack([order, np.zeros_like(end)]), np.hstack([np.take_along_axis(gaps, order, 1), end])


def orchard(x: np.ndarray, book: np.ndarray, near: np.ndarray, gaps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x and its squared distance, from a start entry for each row. Lists are walked
    BLOCK entries a step; a search jumps to the nearest of them."""
    n, m = len(x), len(book)
    exact = np.float64 if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) ** 2 * x.shape[1] < 1 << 49 else np.int64
    x, book = x.astype(exact), book.astype(exact)  # integers either way: doubles hold them up to 2^53
    best, far = start.copy(), squared(x, book[start]).astype(np.int64)
    seen = np.zeros((n, m), bool)
    seen[np.arange(n), best] = True
    at, live, step = np.zeros(n, np.int64), np.arange(n), np.arange(BLOCK)
    while len(live):
        place = best[live][:, None] * near.shape[1] + at[live][:, None] + step
        entry = near.ravel()[place]
        within = gaps.ravel()[place] <= 4 * far[live][:, None]  # not beyond twice the distance
        r, c = np.nonzero(within & ~seen[live[:, None], entry])
        row, met = live[r], entry[r, c]
        seen[row, met] = True
        d = np.full(entry.shape, np.iinfo(np.int64).max)
        d[r, c] = squared(x[row], book[met]).astype(np.int64)
        least = d.min(1)
        first = np.where(d == least[:, None], entry, m).min(1)
        nearer = (least < far[live]) | ((least == far[live]) & (first < best[live]))
        at[live] += BLOCK
        jump = live[nearer]
        best[jump], far[jump], at[jump] = first[nearer], least[nearer], 0
        live = live[nearer | within[:, -1]]
    return best, far


class Codebooks:
    """Codebooks by part (PARTS x entries x width) with what a search needs; pickled to the tasks."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.lists = [neighbour_lists(b) for b in books]
        # searches start at the entry whose sum of components is nearest
        self.order = [np.argsort(b.sum(1), kind="stable") for b in books]
        self.sums = [b.sum(1)[o] for b, o in zip(books, self.order)]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances, rows by parts."""
        n, parts = len(vectors), len(self.books)
        codes, errors = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        cut = vectors.reshape(n, parts, -1)
        for a in range(0, n, TOGETHER):
            for k in range(parts):
                x = np.ascontiguousarray(cut[a : a + TOGETHER, k])
                start = self.order[k][np.minimum(np.searchsorted(self.sums[k], x.sum(1)), len(self.sums[k]) - 1)]
                codes[a : a + TOGETHER, k], errors[a : a + TOGETHER, k] = orchard(x, self.books[k], *self.lists[k], start)
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def first_codebooks(vectors: DataFrame) -> np.ndarray | None:
    """The parts of the ENTRIES vectors of the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    return np.array([r[0] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2) if rows else None


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the mean (rounded down) of the parts that are nearest to it; unused ones stay."""
    sent = vectors.sparkSession.sparkContext.broadcast(Codebooks(books))
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            slot = sent.value.nearest(x)[0] + np.arange(parts) * entries
            np.add.at(total, slot.ravel(), x.reshape(-1, width))
            count += np.bincount(slot.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    partial = vectors.select("v").mapInArrow(sums, "slot long, n long, total array<long>")
    whole = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)]).alias("total"))
    out = books.reshape(parts * entries, width).copy()
    for r in whole.collect():  # a row an entry
        out[r["slot"]] = [t // r["n"] for t in r["total"]]
    sent.destroy()
    return out.reshape(books.shape)


def vector_codes(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of the kept vectors, and the codebooks (part, entry, position); None without vectors."""
    vectors = whole_vectors(df, ident, vector, label)
    books = first_codebooks(vectors)
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long"
    if books is None:
        return df.sparkSession.createDataFrame([], schema), None
    for _ in range(ROUNDS):
        books = refined(vectors, books)
    final, width = Codebooks(books), books.shape[0] * books.shape[2]
    sent = df.sparkSession.sparkContext.broadcast(final)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = sent.value.nearest(_matrix(batch.column("v"), width))
            names = [row.hex() for row in map(bytes, codes.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    return written(vectors.mapInArrow(encode, schema), "vector-codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"), "label-errors")
    digest = F.lit(None).cast("string") if books is None else F.lit(Codebooks(books).digest())
    joined = codes.join(small(sums), codes["label"].eqNullSafe(sums["own"]))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds unrolled: squared distances as sums of products, exact in doubles."""
    near = "select vec_id, part, d // {n} as d, d % {n} as entry from (select vec_id, part, min(({gap}) * {n} + entry)::bigint as d from x join {book} b using (part) group by vec_id, part)"
    gap = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"
    steps = [
        f"w as materialized (select vec_id, label, [floor({SCALE} * c::double) for c in embedding] as v from embeddings where embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0)",
        f"x as materialized (select vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as v from w, range({PARTS}) r(part))",
        f"b0 as materialized (select part, entry, v from x join (select vec_id, row_number() over (order by vec_id) - 1 as entry from w order by vec_id limit {ENTRIES}) using (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} as materialized ({near.format(n=ENTRIES, gap=gap, book=f'b{k}')})")
        if k < ROUNDS:
            parts = f"select part, entry, pos, floor(sum(c) / count(*)) as c from (select a.part, a.entry, unnest(x.v) as c, unnest(range(len(x.v))) as pos from a{k} a join x using (vec_id, part)) group by part, entry, pos"
            steps.append(f"b{k + 1} as materialized (select b.part, b.entry, coalesce(any_value(m.v), any_value(b.v)) as v from b{k} b left join (select part, entry, list(c order by pos) as v from ({parts}) group by part, entry) m using (part, entry) group by b.part, b.entry)")
    steps.append("r as materialized (select vec_id, string_agg(printf('%02x', entry::bigint), '' order by part) as code, sum(d)::bigint as error from a4 group by vec_id)".replace("a4", f"a{ROUNDS}"))
    steps.append("l as (select label, sum(error)::bigint as label_error from r join w using (vec_id) group by label)")
    steps.append(f"h as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from (select part, entry, unnest(v) as c, unnest(range(len(v))) as pos from b{ROUNDS}))")
    return f"with {', '.join(steps)} select vec_id, code, error, label_error, codebooks_sha256 from r join w using (vec_id) join l on w.label is not distinct from l.label cross join h"


ORACLE = _oracle()
