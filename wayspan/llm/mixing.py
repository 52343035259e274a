"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token masses of the cells are raked: scaled to
the target share of every source, then language, then topic, over and over until all three marginals hold. A
cell's factor, times a constant that spends the token budget, is the probability with which each of its
documents is sampled, by a hash of its id.

Raking sees only the cell table. Up to CELL_LIMIT cells (counted first) it is done in numpy on the driver,
beyond that by joins and aggregations on the cell table, with the same result.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import whitespace_words, written

DIMENSIONS = ("source", "lang", "topic")
CELL_LIMIT = 100_000
TOLERANCE, SWEEPS = 1e-9, 200
#: Scales that are tried together when a budget is met.
GRID = 32


def surface_topic(text: Column, words: Column) -> Column:
    """Kind of a text by its looks: symbols, brief (under 100 words), article (under 1000) or long."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    return F.when(symbols * 4 >= words + 1, "symbols").when(words < 100, "brief").when(words < 1000, "article").otherwise("long")


def with_cells(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words; null has none) and _source, _lang, _topic (null is the empty string)."""
    counted = docs.withColumn("n_tokens", whitespace_words(F.col("text")))
    return counted.withColumns({"_source": F.coalesce(F.col("source"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit("")), "_topic": surface_topic(F.col("text"), F.col("n_tokens"))})


def tempered_targets(cells: DataFrame, alpha: float) -> DataFrame:
    """dim, value, share: every dimension's token shares to the power alpha, summing to one again. Values
    without tokens have no share."""
    parts = []
    for dim in DIMENSIONS:
        own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        parts.append(own.select(F.lit(dim).alias("dim"), "value", F.pow(F.col("t").cast("double"), F.lit(alpha)).alias("t")))
    all_ = reduce(DataFrame.unionByName, parts)
    sums = all_.groupBy("dim").agg(F.sum("t").alias("sum"))
    return all_.join(sums, "dim").select("dim", "value", (F.col("t") / F.col("sum")).alias("share"))


def rake_local(cells: list[tuple], targets: dict[tuple[str, str], float]) -> np.ndarray:
    """Raked masses of cells (source, lang, topic, tokens), summing to one."""
    mass = np.array([c[3] for c in cells], float)
    mass /= mass.sum() or 1
    coded = [np.unique([c[k] for c in cells], return_inverse=True) for k in range(len(DIMENSIONS))]
    wanted = [np.array([targets.get((DIMENSIONS[k], v), 0.0) for v in names]) for k, (names, _) in enumerate(coded)]
    for _ in range(SWEEPS):
        for (names, code), goal in zip(coded, wanted, strict=True):
            now = np.bincount(code, mass, len(names))
            mass = mass * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[code]
        off = max(np.abs(np.bincount(code, mass, len(names)) - goal).max() for (names, code), goal in zip(coded, wanted, strict=True))
        if off < TOLERANCE:
            return mass
    _missed(off)
    return mass


def _missed(off: float) -> None:
    warnings.warn(f"after {SWEEPS} sweeps a marginal is still missed by {off:.3g}: no masses meet these targets, or slowly", stacklevel=3)


def rake(cells: DataFrame, targets: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """cells (source, lang, topic, tokens) with `mass`, raked to targets (dim, value, share) and summing to one.
    Cells of a value that has no target get no mass. Marginals that no masses can meet (a target for
    documents that aren't there) stop after SWEEPS sweeps at the masses of the last sweep, with a warning that says by
    how much they are missed. Up to `limit` cells and three times as many targets are raked on the driver."""
    spark = cells.sparkSession
    head = cells.orderBy(*DIMENSIONS).limit(limit + 1).collect()
    wanted = targets.limit(3 * limit + 1).collect() if len(head) <= limit else []
    if len(head) <= limit and len(wanted) <= 3 * limit:
        goals = {(r.dim, r.value): r.share for r in wanted}
        mass = rake_local([tuple(r) for r in head], goals) if head else []
        return spark.createDataFrame([(*r, float(m)) for r, m in zip(head, mass, strict=True)], "source string, lang string, topic string, tokens long, mass double")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("mass", F.col("tokens") / F.lit(float(total)))
    for _ in range(SWEEPS):
        for dim in DIMENSIONS:
            goal = targets.where(F.col("dim") == dim).select(F.col("value").alias(dim), "share")
            sums = now.groupBy(dim).agg(F.sum("mass").alias("_now")).join(goal, dim, "left")
            factor = sums.select(dim, F.when(F.col("_now") > 0, F.coalesce("share", F.lit(0.0)) / F.col("_now")).otherwise(0.0).alias("_f"))
            now = now.join(factor, dim).withColumn("mass", F.col("mass") * F.col("_f")).select(*cells.columns, "mass")
        now = written(now, "raked")
        off = 0.0
        for dim in DIMENSIONS:
            goal = targets.where(F.col("dim") == dim).select(F.col("value").alias(dim), "share")
            gap = now.groupBy(dim).agg(F.sum("mass").alias("_now")).join(goal, dim, "left").agg(F.max(F.abs(F.col("_now") - F.coalesce("share", F.lit(0.0)))))
            off = max(off, gap.first()[0] or 0.0)
        if off < TOLERANCE:
            return now
    _missed(off)
    return now


def sampling_plan(cells: DataFrame, targets: DataFrame, budget: float | None = None, limit: int = CELL_LIMIT, calibrated: bool = False) -> DataFrame:
    """cells with weight (mass over token share) and prob. Without a budget the largest weight has
    probability 1, so the sample's expected marginals are the targets; with one, weights are scaled until
    the expected tokens are that share of all, probabilities capped at 1. Capped cells miss their targets; a
    calibrated plan takes the budget as an upper limit and scales no further than the targets allow."""
    raked = rake(cells, targets, limit)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    weighed = written(raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") * float(total) / F.col("tokens")).otherwise(1.0)), "weights")
    top, least, mass = weighed.where("tokens > 0").agg(F.max("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.sum(F.col("weight") * F.col("tokens"))).first()
    scale = 1.0 / (top or 1.0)
    if budget is not None and calibrated:  # below the cap what is spent grows with the scale
        scale = min(scale, budget * total / mass) if mass else scale
    elif budget is not None:
        low, high = 0.0, 1.0 / max(1e-12, least or 1.0)
        for _ in range(9):  # a job tries GRID scales and narrows the range as many times
            tried = [low + (high - low) * k / GRID for k in range(1, GRID + 1)]
            spent = weighed.agg(*[F.sum(F.least(F.lit(1.0), F.col("weight") * x) * F.col("tokens")) for x in tried]).first()
            short = sum((x or 0.0) < budget * total for x in spent)
            low, high = (tried[short - 1] if short else low), tried[min(short, GRID - 1)]
        scale = high
    return weighed.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))


def uniform(docs: DataFrame, seed: int, doc: str = "doc_id") -> Column:
    """A number in [0, 1) from the id and seed; rows without an id go by their text."""
    key = F.coalesce(F.col(doc).cast("string"), F.concat(F.lit("\x00"), F.coalesce(F.col("text"), F.lit(""))))
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mixed_documents(docs: DataFrame, alpha: float = 0.7, budget: float | None = None, seed: int = 0, targets: DataFrame | None = None, limit: int = CELL_LIMIT, calibrated: bool = False) -> DataFrame:
    """docs with n_tokens, topic, weight, prob and sampled; columns of these names are replaced.

    targets (dim, value, share) default to tempered shares. Null sources and languages are cells of their
    own; null and empty texts have no tokens, a weight of 1 and the scale as probability; repeated rows share
    an id and thus are sampled together; an empty table gives an empty one.
    """
    added = ("n_tokens", "topic", "weight", "prob", "sampled", "_source", "_lang", "_topic", "_u")
    own = with_cells(docs.drop(*added)).withColumn("_u", uniform(docs, seed))
    cells = written(own.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("n_tokens").alias("tokens")), "cells")
    plan = sampling_plan(cells, written(tempered_targets(cells, alpha), "targets") if targets is None else targets, budget, limit, calibrated)
    plan = written(plan.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), "weight", "prob"), "plan")
    out = own.join(plan, ["_source", "_lang", "_topic"]).withColumns({"topic": F.col("_topic"), "sampled": F.col("_u") < F.col("prob")})
    return out.drop("_source", "_lang", "_topic", "_u")


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, weight, sampling probability and the draw."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixed_documents(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "sampled")
