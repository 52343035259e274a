"""How far the sources of a language differ in the terms they use.

A first pass counts in how many documents of its language each term stands; terms in enough of them are kept. The kept
terms are range-sorted, and each stretch of a sorted range becomes a minimal acyclic transducer: equal tails share
states, and the numbers on the arcs of a term's path sum to its rank in the stretch, so that with the sizes of the
stretches before, a term's ordinal in its language follows. A second pass streams the text through the transducers and
counts ordinals for each source. Counts meet in tiles of ordinals, where all sources of a language are compared term by
term in exact integers; ties between terms go by ordinal.

Transducers reach the tasks in waves of WAVE_BYTES at most (and one transducer more), so neither driver nor task holds
the whole vocabulary; the text is read once a wave. Terms of one language spread over all ranges and tiles, whatever its
share of the rows.

Definitions: null text, lang and source are ''; each row is a document, repeated ids and rows too; other columns are
left alone. An empty table gives an empty result; a language without kept terms gives its pairs the value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayspan.llm.common import chunked, lower_ascii, utf8_view, written

#: A kept term stands in so many documents of its language; term rows end at this rank; probabilities are of this unit.
LEAST_DOCS, RANKS, UNIT = 10, 10, 1_000_000_000
#: Terms and bytes of terms in one transducer at most (a longer term is one alone); bytes of transducers sent at once.
BLOCK_TERMS, BLOCK_BYTES, WAVE_BYTES = 1 << 15, 1 << 20, 1 << 25
#: Bytes of text looked at together, and counts in a tile (terms times sources of the language).
TEXT_BYTES, TILE = 1 << 23, 1 << 17

#: Lower-case image of each byte of a term; 0 for bytes between terms.
_LETTER = np.array([lower_ascii(b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)


# --- terms of texts -----------------------------------------------------------------------------


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms (binary) of consecutive texts, and for each term in text order its number among them and its text."""
    base = int(offsets[0])
    bounds = (offsets - base).astype(np.int64)
    n = int(bounds[-1])
    low = _LETTER[data[base : base + n]]
    inside = low != 0
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = np.concatenate(([0], np.cumsum(ends - starts)))
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(spans.astype(np.int64)), pa.py_buffer(low[inside])])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(bounds, starts, "right") - 1


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counted(major: np.ndarray, minor: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each comes."""
    both, n = np.unique(major * width + minor, return_counts=True)
    return both // width, both % width, n


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term) of the terms that stand in LEAST_DOCS documents of their language."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            lang, langs = _codes(batch.column("lang"))
            for a, b in chunked(offsets, TEXT_BYTES):
                terms, code, row = terms_of(data, offsets[a : b + 1])
                width = max(len(terms), 1)
                row, code, _ = _counted(row, code, width)  # a document counts once
                own, code, n = _counted(lang[a + row], code, width)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own)), terms.take(pa.array(code)).cast(pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "term", "n"])

    counts = docs.select("lang", "text").mapInArrow(spread, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).drop("n")


# --- transducers --------------------------------------------------------------------------------


def minimal_transducer(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest acyclic transducer from sorted distinct terms to their ranks: arcs (256 * state + byte, sorted),
    their targets and the ranks they add, and which states end a term. The last state is the start."""
    known: dict[tuple, int] = {}  # a state by its ending and arcs
    words: list[int] = []  # terms that can be completed from a state
    path: list[tuple[bool, list]] = [(False, [])]
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            ends, arcs = path.pop()
            state = (ends, tuple(arcs))
            if (at := known.get(state)) is None:
                at = known[state] = len(words)
                words.append(int(ends) + sum(words[t] for _, t in arcs))
            if path:
                path[-1][1].append((before[len(path) - 1], at))

    for term in terms:
        same = next((i for i, (x, y) in enumerate(zip(before, term)) if x != y), min(len(before), len(term)))
        settle(same + 1)
        path.extend((False, []) for _ in term[same:])
        path[-1] = (True, path[-1][1])
        before = term
    settle(0)

    arcs, targets, adds, ends = [], [], [], np.zeros(len(words), bool)
    for (end, own), at in known.items():
        ends[at], rank = end, int(end)
        for byte, target in own:
            arcs.append(at * 256 + byte)
            targets.append(target)
            adds.append(rank)
            rank += words[target]
    order = np.argsort(np.array(arcs, np.int64))
    return np.array(arcs, np.int64)[order], np.array(targets, np.int32)[order], np.array(adds, np.int32)[order], ends


def ranks(machine: tuple[np.ndarray, ...], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rank of each string (n + 1 offsets into data) that the transducer accepts, else -1; all strings step together."""
    arcs, targets, adds, ends = machine
    n = len(offsets) - 1
    out, sums, state = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, len(ends) - 1, np.int64)
    live, step = np.arange(n), 0
    while len(live):
        done = offsets[live + 1] - offsets[live] == step
        stop = live[done]
        out[stop] = np.where(ends[state[stop]], sums[stop], -1)
        live = live[~done]
        if not len(live) or not len(arcs):
            break
        want = state[live] * 256 + data[offsets[live] + step]
        at = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
        found = arcs[at] == want
        live, at = live[found], at[found]
        sums[live] += adds[at]
        state[live] = targets[at]
        step += 1
    return out


def transducers(terms: DataFrame) -> DataFrame:
    """Transducers of stretches of each language's sorted terms: lang, terms, the four arrays as bytes, the ordinal
    of the first term (base, from 0 in each language) and the wave it is sent in."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, own, size = None, [], 0

        def block() -> pa.RecordBatch:
            machine = minimal_transducer([t.encode() for t in own])
            bytes_ = [x.tobytes() for x in machine]
            return pa.RecordBatch.from_pylist([{"lang": lang, "terms": own, **dict(zip(_PARTS, bytes_)), "size": sum(map(len, bytes_))}], schema)

        for batch in batches:
            for name, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if own and (name != lang or len(own) == BLOCK_TERMS or size + len(term.encode()) > BLOCK_BYTES):
                    yield block()
                    own, size = [], 0
                lang = name
                own.append(term)
                size += len(term.encode())
        if own:
            yield block()

    schema = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), *[(p, pa.binary()) for p in _PARTS], ("size", pa.int64())])
    ordered = terms.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    blocks = written(ordered.mapInArrow(build, f"lang string, terms array<string>, {', '.join(f'{p} binary' for p in _PARTS)}, size long"), "transducers")
    first = F.get("terms", F.lit(0))
    heads = blocks.select("lang", first.alias("head"), F.size("terms").alias("n"), "size")  # a row a block: few
    rows = Window.orderBy("lang", "head").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("lang").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    placed = heads.select("lang", "head", F.coalesce(F.sum("n").over(own), none).alias("base"), F.floor(F.coalesce(F.sum("size").over(rows), none) / WAVE_BYTES).alias("wave"))
    return written(blocks.withColumn("head", first).join(placed.hint("merge"), ["lang", "head"]).drop("head"), "vocabulary")


_PARTS, _TYPES = ("arcs", "targets", "adds", "ends"), (np.int64, np.int32, np.int32, np.bool_)


def recounted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of each kept term in each source, zeros left out."""
    spark, out = docs.sparkSession, None
    waves = vocabulary.agg(F.max("wave")).first()[0]
    for wave in range(-1 if waves is None else waves + 1):
        machines: dict[str, list] = {}
        for r in vocabulary.where(F.col("wave") == wave).select("lang", "base", *_PARTS).toLocalIterator():
            machines.setdefault(r["lang"], []).append((r["base"], tuple(np.frombuffer(r[p], t) for p, t in zip(_PARTS, _TYPES))))
        sent = spark.sparkContext.broadcast(machines)
        counts = written(_streamed(docs, sent), "term-counts")
        sent.destroy()
        out = counts if out is None else out.unionByName(counts)
    return spark.createDataFrame([], _COUNTS) if out is None else out


_COUNTS = "lang string, source string, ordinal long, n long"


def _streamed(docs: DataFrame, sent) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = sent.value
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            (lang, langs), (source, sources) = _codes(batch.column("lang")), _codes(batch.column("source"))
            names = langs.to_pylist()
            for a, b in chunked(offsets, TEXT_BYTES):
                terms, code, row = terms_of(data, offsets[a : b + 1])
                group = lang[a + row] * len(sources) + source[a + row]
                group, code, n = _counted(group, code, max(len(terms), 1))
                flat, ends = utf8_view(terms)
                own = group // max(len(sources), 1)
                ordinal = np.full(len(code), -1, np.int64)
                for number in np.unique(own):
                    place = np.flatnonzero(own == number)
                    used, back = np.unique(code[place], return_inverse=True)
                    lengths = ends[used + 1] - ends[used]
                    spans = np.concatenate(([0], np.cumsum(lengths)))
                    text = flat[np.repeat(ends[used] - spans[:-1], lengths) + np.arange(spans[-1])]
                    for base, machine in machines.get(names[number], ()):
                        rank = ranks(machine, text, spans)[back]
                        ordinal[place[rank >= 0]] = base + rank[rank >= 0]
                kept = ordinal >= 0
                group = group[kept]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(group // max(len(sources), 1))), sources.take(pa.array(group % max(len(sources), 1))), pa.array(ordinal[kept]), pa.array(n[kept])],
                    ["lang", "source", "ordinal", "n"],
                )

    counts = docs.mapInArrow(count, _COUNTS)
    return counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


# --- exact comparison ---------------------------------------------------------------------------


def probability(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), divided in two steps so that 64 bits hold counts to 10^14."""
    share, whole = count.astype(np.int64) + 2, total + 2 * terms
    high = share * 31_250
    return 1 + high // whole * 32_000 + high % whole * 32_000 // whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """One tile: left has (lang, tile, source number, ordinal, n), right one row with the totals of the language's sources
    by number and its number of terms. Gives sums over pairs of sources and each source's first terms by value."""
    lang = right["lang"][0].as_py() if len(right) else None
    none = {k: [] for k in ("lang", "source", "other", "ordinal", "value")}
    if not len(left) or not len(right):
        return pa.table(none, schema=_TILE)
    totals = np.array(right["totals"][0].as_py(), np.int64)
    terms = right["terms"][0].as_py()
    ordinals, at = np.unique(left["ordinal"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(totals), len(ordinals)), np.int64)
    counts[left["number"].to_numpy(), at] = left["n"].to_numpy()
    p = probability(counts, totals[:, None], terms)
    q = probability(counts.sum(0), totals.sum(), terms)
    out = {k: list(v) for k, v in none.items()}
    for a in range(len(totals)):
        sums = distance(p[a + 1 :], p[a]).sum(1)
        out["source"].extend([a] * len(sums))
        out["other"].extend(range(a + 1, len(totals)))
        out["ordinal"].extend([None] * len(sums))
        out["value"].extend(sums.tolist())
        there = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        f = distance(p[a, there], q[there])
        best = np.lexsort((there, -f))[:RANKS]
        out["source"].extend([a] * len(best))
        out["other"].extend([None] * len(best))
        out["ordinal"].extend(ordinals[there[best]].tolist())
        out["value"].extend(f[best].tolist())
    out["lang"] = [lang] * len(out["value"])
    return pa.table(out, schema=_TILE)


_TILE = pa.schema([("lang", pa.string()), ("source", pa.int32()), ("other", pa.int32()), ("ordinal", pa.int64()), ("value", pa.int64())])


def divergence_audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language and the sum of the
    distances over all its kept terms. Part `term`: the RANKS terms in which a source exceeds its language most."""
    docs = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vocabulary = transducers(kept_terms(docs))
    counts = recounted(docs, vocabulary)

    # one row a source: the result holds all pairs of them, so their number is bounded by it
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.sum(F.size("terms")).alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums.hint("merge"), ["lang", "source"], "left").join(sizes.hint("merge"), "lang", "left").fillna(0, ["total", "terms"])
    groups = written(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "sources")
    most = groups.agg(F.max("number")).first()[0]
    width = max(1, TILE // (most + 1)) if most is not None else 1

    tile = F.floor(F.col("ordinal") / width).alias("tile")
    left = counts.join(groups.select("lang", "source", "number").hint("merge"), ["lang", "source"]).select("lang", tile, "number", "ordinal", "n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "total"))), lambda s: s["total"]).alias("totals")
    languages = groups.groupBy("lang").agg(ordered, F.max("terms").alias("terms"))
    tiles = languages.where("terms > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / width))).alias("tile"), "totals", "terms")
    met = written(left.groupBy("lang", "tile").cogroup(tiles.groupBy("lang", "tile")).applyInArrow(_compared, "lang string, source int, other int, ordinal long, value long"), "tiles")

    a, b = (groups.select("lang", F.col("source").alias(n), F.col("number").alias(f"{n}_at")) for n in ("source", "item"))
    both = met.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("source").alias("source_at"), F.col("other").alias("item_at")), F.struct(F.col("other").alias("source_at"), F.col("source").alias("item_at")))).alias("p"), "value").select("lang", "p.*", "value")
    pairs = a.join(b.hint("merge"), "lang").where("source_at <> item_at").join(both.hint("merge"), ["lang", "source_at", "item_at"], "left")
    ranked = lambda key: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), key))
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0).cast("long"))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked("item").alias("rank"))

    best = met.where("other is null").withColumn("rank", ranked("ordinal")).where(F.col("rank") <= RANKS)
    names = vocabulary.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    best = best.withColumnRenamed("source", "source_at").join(a.hint("merge"), ["lang", "source_at"]).join(names.hint("merge"), ["lang", "ordinal"])
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_WORDS} as w from documents),
t as materialized (select r, lang, source, unnest(w) as term from d),
k as materialized (select lang, term from t group by lang, term having count(distinct r) >= {LEAST_DOCS}),
v as (select lang, count(*) as v from k group by lang),
c as materialized (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
g as materialized (select lang, source, coalesce(any_value(s.n), 0)::hugeint as n, coalesce(any_value(v), 0)::hugeint as v
  from (select distinct lang, source from d) left join (select lang, source, sum(n) as n from c group by lang, source) s using (lang, source) left join v using (lang) group by lang, source),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v) as p
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as materialized (select lang, term, 1 + ({UNIT}::hugeint * (sum(c.n) + 2)) // (any_value(l.n) + 2 * any_value(l.v)) as q
  from c join (select lang, sum(n) as n, any_value(v) as v from g group by lang) l using (lang) group by lang, term),
pairs as (select x.lang, x.source, y.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source),
allpairs as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (select p.lang, p.source, p.term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where p.n > 0 and p > q)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from allpairs
union all select * from (select lang, source, 'term' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms) where rank <= {RANKS}
"""
