"""Counts, activity metrics, histograms, rankings and keyed choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.operators.graph import checkpointed
from wayspan.operators.sizes import small


def activity(df: DataFrame, by: list[str], trip: str, route: str, stop: str, snapshot: str | None = None) -> DataFrame:
    """Distinct trips, routes and stops, and rows; over snapshots a trip counts in each of them."""
    trips = F.countDistinct(F.struct(snapshot, trip)) if snapshot else F.countDistinct(trip)
    return df.groupBy(*by).agg(trips.alias("trips"), F.countDistinct(route).alias("routes"), F.countDistinct(stop).alias("stops"), F.count(F.lit(1)).alias("events"))


def first_by(df: DataFrame, by: list[str], order: list[str], columns: list[str], counts: dict[str, Column] | None = None) -> DataFrame:
    """Attributes of the first row (smallest order) of each group, with further aggregates."""
    named = [c.alias(k) for k, c in (counts or {}).items()]
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"), *named).select(*by, "_first.*", *(counts or {}))


def consolidate(df: DataFrame, by: list[str], order: str, unanimous: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row a group: values that all rows share (else null), any() flags and the row count."""
    same = [F.when(F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) == 1, F.min(c)).alias(c) for c in unanimous]
    return df.groupBy(*by).agg(F.min(order).alias(order), *same, *[F.bool_or(c).alias(k) for k, c in flags.items()], F.count(F.lit(1)).alias("records"))


def group_centroids(df: DataFrame, key: str, x: str, y: str, least: int) -> DataFrame:
    return df.groupBy(key).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def first_filled(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """For each group and column the first value in order that isn't blank; null if none is."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.groupBy(*by).agg(*[F.min_by(F.col(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def singletons(df: DataFrame, key: str, species: bool = False) -> DataFrame:
    """Rows whose key no other row has; species leaves keys of one word (a genus alone) out."""
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)
    return df.join(once.where(F.contains(key, F.lit(" "))) if species else once, key, "left_semi")


def ranked_keys(df: DataFrame, key: str, position: str) -> DataFrame:
    """key, n, index: keys by descending count, first seen first. Keys are numbered in sorted ranges."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_seen")).withColumn("_less", -F.col("n"))
    return numbered(counts, ["_less", "_seen"], "index").select(key, "n", "index")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Row numbers from 0 in a total order without one task for all rows: ranges are sorted apart and written, and
    the sizes of the ranges before (a row a partition) are added."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    within = checkpointed(placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = within.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")  # a row a partition


def cluster_numbers(labels: DataFrame, component: str = "component", name: str = "cluster") -> DataFrame:
    """labels with a number of each component from 0 on, in the order of the components' first (smallest) members."""
    numbers = numbered(labels.select(F.col(component).alias("_c")).distinct(), ["_c"], name)
    return labels.join(numbers.hint("merge"), labels[component] == numbers["_c"]).drop("_c")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def stability(ranks: DataFrame, by: list[str], rank: str, primary: str, cut: int = 20) -> DataFrame:
    """How steadily a candidate ranks: "not prioritized" unless its primary row ranks within the cut; else by how
    many rows (the primary one too) do: robust from five, mostly robust from three, or sensitive. Rows of scenarios
    that don't apply have no rank."""
    counted = ranks.groupBy(*by).agg(F.count_if(F.col(rank) <= cut).alias("within"), F.count(rank).alias("applicable"), F.min(F.when(F.col(primary), F.col(rank))).alias("_first"))
    kind = F.when(F.coalesce(F.col("_first") > cut, F.lit(True)), "not prioritized").when(F.col("within") >= 5, "robust").when(F.col("within") >= 3, "mostly robust").otherwise("sensitive")
    return counted.withColumn("stability", kind).drop("_first")


def histogram(df: DataFrame, zone: str, value: str, keep: Column) -> DataFrame:
    return df.where(keep).groupBy(zone, value).agg(F.count(F.lit(1)).alias("n"))


def histogram_summary(hist: DataFrame, zone: str, value: str) -> DataFrame:
    """Mean and exact median (even counts split) of a zone's histogram."""
    return hist.groupBy(zone).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.percentile(value, F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("pixels"))


def region_means(hist: DataFrame, zones: DataFrame, zone: str, value: str, flag: str) -> DataFrame:
    """(region, mean, pixels) from zone histograms: inside and outside the flagged zones, and all of them. Means
    come from the sums of the histograms, so zones weigh by their pixels."""
    told = hist.join(zones.select(zone, flag), zone).withColumn("_r", F.explode(F.array(F.when(F.col(flag), "inside").otherwise("outside"), F.lit("all"))))
    return told.groupBy(F.col("_r").alias("region")).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("pixels"))


def extremes(zones: DataFrame, key: str, value: str, k: int, eligible: Column | None = None) -> DataFrame:
    """(key, value, side, place): the k highest and lowest eligible zones; null values never win, ties go to the
    smaller key. k rows a side are ranked."""
    told = zones.where(F.col(value).isNotNull() & (F.lit(True) if eligible is None else eligible)).select(key, value)
    out = None
    for side, order in (("highest", [F.col(value).desc(), F.col(key)]), ("lowest", [F.col(value), F.col(key)])):
        part = told.orderBy(*order).limit(k).withColumns({"side": F.lit(side), "place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))})
        out = part if out is None else out.unionByName(part)
    return out


def shortage_share(zones: DataFrame, by: list[str], median: str, length: str, below: float, holds: float = 25.0) -> DataFrame:
    """(by, poor_km, total_km, share_percent, shortage_holds): length-weighted share of zones under a threshold, and
    whether it reaches `holds` percent. Zones without a median count on neither side; no length at all is 0 percent."""
    known = F.col(median).isNotNull()
    km = lambda c: F.coalesce(F.sum(F.when(c, F.col(length))), F.lit(0.0)) / 1000
    told = zones.groupBy(*by).agg(km(known & (F.col(median) < below)).alias("poor_km"), km(known).alias("total_km"))
    share = F.when(F.col("total_km") > 0, 100 * F.col("poor_km") / F.col("total_km")).otherwise(0.0)
    return told.withColumn("share_percent", share).withColumn("shortage_holds", F.col("share_percent") >= holds)


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, share, quantile): exact quantiles, linear between neighbours, of the values that aren't null.

    Values are counted, dealt into ranges of group and value and written; the counts of a group's ranges say which
    ranges hold the ranks that are asked for, and only these are numbered. Nothing grows with a group's values in one
    task, and a group of any size spreads over ranges. Groups may be null.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = checkpointed(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    ranges = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys)
    sized = ranges.withColumns({"_end": F.sum("_n").over(group.orderBy("_part")), "_all": F.sum("_n").over(group)}).withColumn("_start", F.col("_end") - F.col("_n"))
    # both neighbours of each share's place, in the range that holds them
    asked = sized.withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("_place", F.col("_share") * (F.col("_all") - 1))
    asked = asked.select(*keys, "_part", "_start", "_end", "_share", "_place", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank"))
    asked = checkpointed(asked.where("_rank >= _start and _rank < _end").drop("_end"))
    needed = asked.select(*[F.col(k) for k in keys], "_part", "_start").distinct().alias("w")
    rows = placed.join(small(needed), same(placed, needed) & (placed["_part"] == needed["_part"])).select(*[placed[k] for k in keys], placed["_part"], "_v", "_n", "_start")
    last = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    rows = rows.withColumn("_last", last)
    met = rows.join(small(asked), same(rows, asked) & (rows["_part"] == asked["_part"]) & (F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_n")))
    weight = F.when(F.floor("_place") == F.ceil("_place"), 1.0).when(F.col("_rank") == F.floor("_place"), F.ceil("_place") - F.col("_place")).otherwise(F.col("_place") - F.floor("_place"))
    told = met.select(*[rows[k] for k in keys], "_share", (F.col("_v") * weight).alias("_p"))
    return told.groupBy(*keys, "_share").agg(F.sum("_p").alias("quantile")).select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("_share").alias("share"), "quantile")


def percentiles(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Count, linear p50, p95 and p99, maximum and how many lie above a limit."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = quantiles(df, by, value, list(shares.values()))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for n, s in shares.items()])
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.max(value).alias("max"), F.count_if(F.col(value) > limit).alias("above"))
    same = reduce(Column.__and__, [out[c].eqNullSafe(wide[c]) for c in by], F.lit(True))
    return out.join(wide.hint("merge"), same, "left").select(*[out[c] for c in by], "n", *shares, "max", "above")


def common_spelling(df: DataFrame, key: Column, display: str) -> DataFrame:
    """Most frequent spelling of each key; ties by folded, then raw text."""
    counts = df.groupBy(key.alias("key"), F.col(display).alias("display")).agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(-F.col("n"), F.lower("display"), F.col("display"))
    return counts.groupBy("key").agg(F.min_by("display", best).alias("display"), F.sum("n").alias("n"))


def set_equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has: side and the columns; empty if the sets are equal."""
    a = left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("left"))
    return a.unionByName(right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("right")))
