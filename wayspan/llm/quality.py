"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Rules on counts fail a document outright. The others get a vector of transformed statistics (mean word
length, symbol, upper-case, repeated-line and repeated-word shares). For each language and source the
minimum covariance determinant estimate is found by concentration steps: from coordinatewise medians and
median deviations, the share COVERAGE of documents with the smallest distances gives the next mean and
covariance, again and again, which never raises the determinant. Documents whose Mahalanobis distance passes
CUTOFF are rejected.

Statistics are integers (thousandths), so sums are exact and results do not depend on partitioning; medians
and distance quantiles come from counts of values or bins, so no group is ever gathered. The expressions are
SQL text, which the DuckDB query uses as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import written

DIMENSIONS = 5
#: Standard deviations (thousandths) below which a statistic is not resolved: added to every covariance.
FLOORS = (150, 60, 100, 95, 95)
COVERAGE = 0.75
STEPS = 4
#: Squared distance: the 0.999 quantile of a chi-square variable with five degrees of freedom. With the floors above
#: each statistic can pass it on its own.
CUTOFF = 20.515
#: Smaller cells of language and source are estimated together: by language, then all.
LEAST_CELL = 50
X = [f"x{i}" for i in range(DIMENSIONS)]

WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spark_counts() -> dict[str, str]:
    grams = "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))"
    starts = "sort_array(filter(transform(s, (x, j) -> if(x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h, x.i, null)), x -> x is not null))"
    covered = f"aggregate({starts}, struct(0 as n, -5 as at), (a, x) -> struct(a.n + least(5, x - a.at) as n, x as at)).n"
    sorted_ = "sort_array(transform(g, (h, i) -> struct(h as h, i as i)))"
    repeated = _let(grams, "g", f"if(size(array_distinct(g)) = size(g), 0, {_let(sorted_, 's', covered)})")
    lines = rf"filter(split(t, '\n'), l -> l rlike r'{WORD}')"
    return {
        "n_words": "cast(size(w) as bigint)",
        "word_chars": f"cast(length(t) - regexp_count(t, r'{SPACE}') as bigint)",
        "n_symbols": "cast(regexp_count(t, '[#*$%&|<>]') as bigint)",
        "n_dup_lines": f"cast({_let(lines, 'l', 'size(l) - size(array_distinct(l))')} as bigint)",
        "n_repeat_words": f"cast(if(size(w) < 5, 0, {repeated}) as bigint)",
        "n_lines": "cast(size(split(t, '\n')) as bigint)",
        "n_upper": r"cast(regexp_count(t, r'\p{Lu}') as bigint)",
    }


BASE_FAILED = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"
_milli = "cast(floor(1000 * {} + 0.5) as bigint)"
VECTOR = dict(
    zip(
        X,
        (
            _milli.format("ln((word_chars + 1.0e0) / (n_words + 1.0e0))"),
            _milli.format("sqrt(n_symbols / (n_words + 9.0e0))"),
            _milli.format("sqrt(n_upper / (word_chars + 1.0e0))"),
            _milli.format("sqrt(n_dup_lines / (n_lines + 9.0e0))"),
            _milli.format("sqrt(n_repeat_words / (n_words + 9.0e0))"),
        ),
        strict=True,
    )
)

Layer = dict[str, str]


def _moments() -> Layer:
    out = {"n": "count(*)"} | {f"s{i}": f"sum(x{i})" for i in range(DIMENSIONS)}
    return out | {f"q{i}{j}": f"sum(x{i} * x{j})" for i in range(DIMENSIONS) for j in range(i + 1)}


def _estimate() -> list[Layer]:
    """Layers from moments to means m* and the Cholesky factor l** of the covariance."""
    layers = [{f"m{i}": f"(cast(s{i} as double) / n)" for i in range(DIMENSIONS)}]
    layers.append({f"c{i}{j}": f"(cast(q{i}{j} as double) / n - m{i} * m{j}" + (f" + {FLOORS[i] ** 2}.0e0)" if i == j else ")") for i in range(DIMENSIONS) for j in range(i + 1)})
    for j in range(DIMENSIONS):
        dot = lambda i, j=j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        layers.append({f"l{j}{j}": f"sqrt(c{j}{j}{dot(j)})"})
        if j + 1 < DIMENSIONS:
            layers.append({f"l{i}{j}": f"((c{i}{j}{dot(i)}) / l{j}{j})" for i in range(j + 1, DIMENSIONS)})
    return layers


KEPT = [f"m{i}" for i in range(DIMENSIONS)] + [f"l{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]


def _distance() -> list[Layer]:
    layers = [{f"z{i}": f"((x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i})"} for i in range(DIMENSIONS)]
    return [*layers, {"d2": " + ".join(f"z{i} * z{i}" for i in range(DIMENSIONS))}]


BIN = "cast(floor(ln(d2 + 1.0e-9) * 100) as bigint)"


def _start() -> Layer:
    """First distances: by medians and median deviations, each coordinate on its own."""
    scale = [f"greatest(1.4826e0 * a{i}, {FLOORS[i]}.0e0)" for i in range(DIMENSIONS)]
    return {"d2": " + ".join(f"((x{i} - b{i}) / {scale[i]}) * ((x{i} - b{i}) / {scale[i]})" for i in range(DIMENSIONS))}


def _layered(df: DataFrame, layers: list[Layer]) -> DataFrame:
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def _median_of(df: DataFrame, value: dict[str, str], share: str = "0.5e0") -> DataFrame:
    """cell and, for each name, the smallest value at or above which the share of the cell's rows lies; from
    counts of values, summed up in a window over the values of one cell and name."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in value.items())
    counts = df.selectExpr("cell", f"stack({len(value)}, {pairs}) as (name, v)").groupBy("cell", "name", "v").agg(F.count(F.lit(1)).alias("c"))
    summed = counts.selectExpr("cell", "name", "v", "sum(c) over (partition by cell, name order by v) as upto", "sum(c) over (partition by cell, name) as total")
    at = summed.where(f"upto >= {share} * total").groupBy("cell", "name").agg(F.min("v").alias("v"))
    return at.groupBy("cell").pivot("name", list(value)).agg(F.min("v"))


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper and base_failed. Null counts as empty. Columns of these names are replaced."""
    counts = _spark_counts()
    own = docs.drop("t", "w", *counts, "base_failed", *X)
    bound = own.withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumn("w", F.regexp_extract_all("t", F.lit(f"({WORD}+)"), F.lit(1)))
    return _layered(bound, [counts]).drop("t", "w").withColumn("base_failed", F.expr(BASE_FAILED))


def _cells(stats: DataFrame) -> DataFrame:
    """stats with `cell`: language and source, language alone where that has few documents, or all."""
    own = stats.withColumns({"_l": F.coalesce("lang", F.lit("")), "_s": F.coalesce("source", F.lit(""))})
    usable = own.where("not base_failed")
    small = usable.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("_n"))
    by_lang = small.where(f"_n < {LEAST_CELL}").groupBy("_l").agg(F.sum("_n").alias("_m"))
    names = small.join(by_lang, "_l", "left").selectExpr("_l", "_s", f"case when _n >= {LEAST_CELL} then concat(_l, '/', _s) when _m >= {LEAST_CELL} then concat(_l, '/') else '' end as cell")
    return own.join(names, ["_l", "_s"], "left").drop("_l", "_s")


def estimates(vectors: DataFrame) -> DataFrame:
    """One row for each cell of vectors (cell, x0 to x4): the means and Cholesky factor of its minimum
    covariance determinant estimate."""
    # what is joined is written first, so its real size decides how
    medians = written(_median_of(vectors, {f"b{i}": f"x{i}" for i in range(DIMENSIONS)}), "medians")
    deviations = written(_median_of(vectors.join(medians, "cell"), {f"a{i}": f"abs(x{i} - b{i})" for i in range(DIMENSIONS)}), "deviations")
    told = vectors.join(medians, "cell").join(deviations, "cell").withColumn("d2", F.expr(_start()["d2"]))
    for step in range(STEPS + 1):
        binned = told.withColumn("bin", F.expr(BIN)).select("cell", *X, "bin")
        if step < STEPS:
            binned = binned.join(written(_median_of(binned, {"top": "bin"}, f"{COVERAGE}e0"), "quantiles"), "cell").where("bin <= top")
        else:  # the last step: all that lie within the cutoff
            binned = told.where(f"d2 <= {CUTOFF}")
        moments = binned.groupBy("cell").agg(*[F.expr(v).alias(k) for k, v in _moments().items()])
        parameters = written(_layered(moments, _estimate()).select("cell", *KEPT), "estimates")
        told = _layered(vectors.join(parameters, "cell"), _distance())
    return parameters


def quality_verdicts(docs: DataFrame, keys: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The key columns, the counts, base_failed, d2 (null for failed documents) and kept.

    Null texts are empty and fail; null languages and sources are a value of their own; repeated rows count
    each; an empty table gives an empty one; extra columns are ignored.
    """
    taken = docs.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    stats = written(document_statistics(taken).drop("text"), "statistics")
    stats = written(_layered(_cells(stats), [VECTOR]), "vectors")
    usable = stats.where("not base_failed")
    judged = _layered(stats.join(estimates(usable.select("cell", *X)), "cell", "left"), _distance())
    counts = [c for c in _spark_counts() if c not in ("n_lines", "n_upper")]
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(*[F.col(f"k_{i}").alias(k) for i, k in enumerate(keys)], *counts, "base_failed", d2.alias("d2"), F.coalesce(d2 <= CUTOFF, F.lit(False)).alias("kept"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that the rules or the estimates reject. Rows that agree in
    id and text share their verdict; a null text is rejected."""
    identity, content = F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.xxhash64(docs["text"])
    verdicts = quality_verdicts(docs.select(identity.alias("_id"), content.alias("_text"), "text", "lang", "source"), ["_id", "_text"])
    gone = written(verdicts.where("not kept").select("_id", "_text").distinct(), "rejected")
    return docs.join(gone, (identity == gone["_id"]) & (content == gone["_text"]), "left_anti")


def op8_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_verdicts(docs, ["doc_id"]).drop("d2")


def _duck_layered(source: str, layers: list[Layer]) -> str:
    for layer in layers:
        source = f"(select *, {', '.join(f'{v} as {k}' for k, v in layer.items())} from {source})"
    return source


def _duck_median(source: str, value: dict[str, str], share: str = "0.5e0") -> str:
    long = " union all ".join(f"select cell, '{k}' as name, {v} as v from {source}" for k, v in value.items())
    summed = f"select cell, name, v, sum(c) over (partition by cell, name order by v) as upto, sum(c) over (partition by cell, name) as total from (select cell, name, v, count(*) as c from ({long}) group by all)"
    at = f"select cell, name, min(v) as v from ({summed}) where upto >= {share} * total group by all"
    return f"select cell, {', '.join(f"min(case when name = '{k}' then v end) as {k}" for k in value)} from ({at}) group by cell"


def _oracle() -> str:
    moments = ", ".join(f"{v} as {k}" for k, v in _moments().items())
    xs = ", ".join(X)
    ctes = {
        "t0": "select doc_id, coalesce(text, '') as t, coalesce(lang, '') as l, coalesce(source, '') as s from documents",
        "t1": rf"select *, regexp_extract_all(t, '{WORD}+') as w from t0",
        "g": "select doc_id, i, w[i : i + 4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from t1 where len(w) >= 5)",
        "r": "select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(0, 5)) as k from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id",
        "ln0": r"select doc_id, x from (select doc_id, unnest(string_split(t, chr(10))) as x from t0) where regexp_matches(x, '" + WORD + "')",
        "dl": "select doc_id, count(*) - count(distinct x) as n from ln0 group by doc_id",
        "st": rf"select t1.doc_id, l, s, cast(len(w) as bigint) as n_words, cast(length(t) - length(regexp_replace(t, '{WORD}', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dl.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words, cast(len(string_split(t, chr(10))) as bigint) as n_lines, cast(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as bigint) as n_upper from t1 left join dl using (doc_id) left join r using (doc_id)",
        "sb": f"select *, {BASE_FAILED} as base_failed from st",
        "sm": "select l, s, count(*) as n from sb where not base_failed group by all",
        "bl": f"select l, sum(n) as m from sm where n < {LEAST_CELL} group by l",
        "nm": f"select sm.l, sm.s, case when n >= {LEAST_CELL} then concat(sm.l, '/', sm.s) when m >= {LEAST_CELL} then concat(sm.l, '/') else '' end as cell from sm left join bl on sm.l = bl.l",
        "sv": f"select sb.*, nm.cell, {', '.join(f'{v} as {k}' for k, v in VECTOR.items())} from sb left join nm on sb.l = nm.l and sb.s = nm.s",
        "u": f"select cell, {xs} from sv where not base_failed",
        "md": _duck_median("u", {f"b{i}": f"x{i}" for i in range(DIMENSIONS)}),
        "um": "select u.*, md.* exclude (cell) from u join md using (cell)",
        "ad": _duck_median("um", {f"a{i}": f"abs(x{i} - b{i})" for i in range(DIMENSIONS)}),
        "d0": f"select cell, {xs}, {_start()['d2']} as d2 from (select um.*, ad.* exclude (cell) from um join ad using (cell))",
    }
    for k in range(STEPS + 1):
        chosen = f"select cell, {xs} from d{k} where d2 <= {CUTOFF}"
        if k < STEPS:
            ctes[f"n{k}"] = f"select *, {BIN} as bin from d{k}"
            ctes[f"p{k}"] = _duck_median(f"n{k}", {"top": "bin"}, f"{COVERAGE}e0")
            chosen = f"select n{k}.* from n{k} join p{k} using (cell) where bin <= top"
        ctes[f"e{k}"] = f"select cell, {', '.join(KEPT)} from {_duck_layered(f'(select cell, {moments} from ({chosen}) group by cell)', _estimate())}"
        ctes[f"d{k + 1}"] = f"select cell, {xs}, d2 from {_duck_layered(f'(select u.*, e{k}.* exclude (cell) from u join e{k} using (cell))', _distance())}"
    final = _duck_layered(f"(select sv.*, e{STEPS}.* exclude (cell) from sv left join e{STEPS} using (cell))", _distance())
    body = ", ".join(f"{k} as materialized ({v})" for k, v in ctes.items())
    return f"with {body} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and d2 <= {CUTOFF}, false) as kept from {final}"


ORACLE = _oracle()
