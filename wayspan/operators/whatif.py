"""What a proposed change would newly cover, how candidates rank, and which of them overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.operators.graph import bucketed, checkpointed
from wayspan.operators.sizes import small


def footprint(distances: DataFrame, source_offsets: DataFrame, stops: DataFrame, active: DataFrame, limit: float) -> DataFrame:
    """(source_id, snapshot_id, stop_id): stops active in a snapshot that a source reaches within the limit, both
    offsets included. distances: label (source), node, dist; source_offsets: source_id, offset; stops: stop_id,
    node, offset; active: snapshot_id, stop_id."""
    met = distances.join(source_offsets.select(F.col("source_id").alias("label"), F.col("offset").alias("_o")), "label").join(stops, "node")
    near = met.where(F.col("dist") + F.col("_o") + F.col("offset") <= limit).select(F.col("label").alias("source_id"), "stop_id").distinct()
    return near.join(active.select("snapshot_id", "stop_id").distinct(), "stop_id").select("source_id", "snapshot_id", "stop_id")


def coverage_gain(footprints: DataFrame, baseline: DataFrame, events: DataFrame) -> DataFrame:
    """Incremental and total activity of each source: trips (per snapshot), routes, stops and snapshots gained.

    footprints: source_id, snapshot_id, stop_id; baseline: snapshot_id, stop_id already covered; events:
    snapshot_id, stop_id, trip, route.
    """
    had = baseline.select("snapshot_id", "stop_id").distinct().withColumn("_had", F.lit(True))
    met = footprints.join(had, ["snapshot_id", "stop_id"], "left").join(events, ["snapshot_id", "stop_id"])
    new = F.col("_had").isNull()
    trip = F.struct("snapshot_id", "trip")
    only = lambda c: F.countDistinct(F.when(new, c))
    return met.groupBy("source_id").agg(
        only(trip).alias("new_trips"), only(F.col("route")).alias("new_routes"), only(F.col("stop_id")).alias("new_stops"), only(F.col("snapshot_id")).alias("snapshots_gained"),
        F.countDistinct(trip).alias("trips"), F.countDistinct("route").alias("routes"), F.countDistinct("stop_id").alias("stops"),
    )


def always(states: DataFrame, place: str, state: str, wanted: str) -> DataFrame:
    """Places in the wanted state at every moment."""
    return states.groupBy(place).agg(F.bool_and(F.col(state) == wanted).alias("_a")).where("_a").select(place)


# Fixed value: up to so many effects a set is looked up by pairs of them.
NARROW = 32


def _pairs_of(items: Column) -> Column:
    """All pairs (a, b) of a sorted list, the earlier item first."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def greedy_distinct(effects: DataFrame, ranks: DataFrame, share: float = 0.8) -> DataFrame:
    """Candidates kept when taken in rank order and skipped if one that is kept covers `share` of their effects.

    effects: candidate_id, effect; ranks: candidate_id, rank (unique). Of candidates with equal effects only the first
    can be kept: what covers it covers the others, and so does it. Sets are told apart by 128 bits and their size, and
    only the first of each go on. A rival that covers c of a candidate's n effects has one of any n - c + 1 of them and
    two of any n - c + 2, so a candidate's rarest effects look for rivals: pairs of them for rivals of up to NARROW
    effects, single ones for wider rivals and where c is 1. Each effect sets one of 64 bits of its set, and who meets
    goes on only if the bits leave room for c common effects, so the join drops nearly all that have just two in
    common. Overlaps are counted for the candidates found. Effects are dealt by candidate once. Rounds decide all
    candidates whose earlier rivals are decided, which gives the sequential result; one test a round reaches the driver.
    """
    every = bucketed(effects.select("candidate_id", "effect").distinct().join(ranks, "candidate_id"), "candidate_id")
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), "effect").cast("decimal(38,0)"))
    alone = F.when(F.bool_or(F.col("effect").isNull()), F.col("candidate_id"))  # nulls equal nothing
    bits = F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(effect), 64) as int))"))
    sets = checkpointed(every.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), digest(0).alias("_g"), digest(1).alias("_h"), alone.alias("_alone"), bits.alias("bits")))
    first = checkpointed(sets.groupBy("n", "_g", "_h", "_alone").agg(F.min_by("candidate_id", "rank").alias("candidate_id"), F.min("bits").alias("bits")).select("candidate_id", "n", "bits"))
    least = F.ceil(F.col("n") * share - 1e-9)
    sized = first.withColumn("c", least.cast("int")).withColumn("paired", (F.col("c") >= 2) & (F.col("n") - F.col("c") + 2 <= NARROW))
    own = bucketed(every.join(sized.hint("merge"), "candidate_id"), "candidate_id")
    common = checkpointed(own.groupBy("effect").agg(F.count(F.lit(1)).alias("common")))
    placed = own.join(small(common), "effect").withColumn("_r", F.row_number().over(Window.partitionBy("candidate_id").orderBy("common", "effect")))
    heads = checkpointed(placed.where(F.col("_r") <= F.col("n") - F.col("c") + F.when(F.col("paired"), 2).otherwise(1)).select("candidate_id", "effect", "n", "c", "bits", "paired", "_r"))
    # ranks are looked at after the join, so that its rows stay small
    earlier = own.select(F.col("candidate_id").alias("rival"), "effect", F.col("rank").alias("_rank"), F.col("n").alias("_n"), F.col("bits").alias("_bits"))
    listed = F.sort_array(F.collect_list("effect"))
    pair = F.xxhash64("_p.a", "_p.b").alias("_key")  # what shares a number by chance is found out with the overlaps
    spread = lambda df, keys: df.groupBy(*keys).agg(listed.alias("_e")).select(*keys, F.explode(_pairs_of(F.col("_e"))).alias("_p")).select(*keys, pair)
    room = F.bit_count(F.col("bits").bitwiseAND(F.col("_bits"))) + F.col("n") - F.bit_count("bits")
    ahead = (F.col("rival") != F.col("candidate_id")) & (F.col("_n") >= F.col("c")) & (room >= F.col("c"))
    asks, is_asked = ["candidate_id", "n", "c", "bits"], ["rival", "_n", "_bits"]
    narrow, wide = (earlier.where(kind).select("effect", *is_asked) for kind in (F.col("_n") <= NARROW, F.col("_n") > NARROW))
    by_two = spread(heads.where("paired"), asks).join(spread(narrow, is_asked).hint("merge"), "_key").where(ahead)
    single = heads.where("_r <= n - c + 1")
    to_wide = single.join(wide.hint("merge"), "effect").where(ahead)
    by_one = single.where("not paired").join(narrow.hint("merge"), "effect").where(ahead)
    found = [df.select("candidate_id", "rival") for df in (by_two, to_wide, by_one)]
    pairs = checkpointed(found[0].union(found[1]).union(found[2]).distinct())
    mine = own.select("candidate_id", "effect", "n", F.col("rank").alias("_own"))
    both = pairs.join(mine.hint("merge"), "candidate_id").join(earlier.select("rival", "effect", "_rank").hint("merge"), ["rival", "effect"]).where("_rank < _own")
    shared = both.groupBy("candidate_id", "rival", "n").agg(F.count(F.lit(1)).alias("common"))
    rivals = checkpointed(shared.where(F.col("common") >= F.col("n") * share).select("candidate_id", "rival"))
    state = checkpointed(first.select("candidate_id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        told = rivals.join(state.select(F.col("candidate_id").alias("rival"), F.col("kept").alias("rival_kept")), "rival")
        seen = told.groupBy("candidate_id").agg(F.bool_or(F.coalesce("rival_kept", F.lit(False))).alias("beaten"), F.bool_or(F.col("rival_kept").isNull()).alias("open"))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(True)
        state = checkpointed(state.join(seen, "candidate_id", "left").select("candidate_id", verdict.alias("kept")))
        if state.where("kept is null").isEmpty():
            break
    # candidates without effects stay, those that repeat an earlier set go
    held = sets.select("candidate_id", F.lit(True).alias("_held"))
    told = ranks.select("candidate_id").join(held.hint("merge"), "candidate_id", "left").join(state.hint("merge"), "candidate_id", "left")
    return told.select("candidate_id", F.coalesce("kept", F.col("_held").isNull()).alias("kept"))


def material_gain(trips: Column, stops: Column, walk: Column) -> Column:
    return (walk == 400) & (trips >= 10) & (stops >= 3)


def release_gate(candidates: DataFrame, robust: Column, valid: Column, material: Column, hours: Column, flagged: Column) -> DataFrame:
    """One row: counts over the candidates that are robust and audited as valid, whether they pass, and the reason,
    the first rule that fails."""
    told = candidates.where(robust & valid).agg(F.count(F.lit(1)).alias("counted"), F.count_if(material).alias("material"), F.count_if(hours).alias("hours"), F.count_if(flagged).alias("flagged"))
    why = (
        F.when(F.col("counted") < 5, "fewer than five robust valid candidates").when(F.col("material") < F.col("counted"), "a robust valid candidate is not material")
        .when(F.col("hours") < 2, "fewer than two robust valid hours extensions").when(F.col("flagged") > 0, "a robust valid candidate has an integrity flag")
    )
    return told.select("counted", "material", "hours", "flagged", why.isNull().alias("passed"), F.coalesce(why, F.lit("all product-gate conditions passed")).alias("reason"))


def query_cells(candidates: DataFrame, dims: DataFrame, active: DataFrame, metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Metrics of every candidate at every combination of dims; inactive or empty cells are zero."""
    grid = candidates.crossJoin(small(dims))
    told = grid.join(active.withColumn("_on", F.lit(True)).hint("merge"), keys, "left").join(metrics.hint("merge"), keys, "left")
    zero = [F.when(F.col("_on"), F.coalesce(v, F.lit(0))).otherwise(0).alias(v) for v in values]
    return told.select(*keys, F.coalesce("_on", F.lit(False)).alias("active"), *zero)


def fingerprint(df: DataFrame, key: str, fold: int = 10_000) -> DataFrame:
    """SHA-256 of a table's content, one row: sha256 and rows, whatever the order and partitions of the rows.

    Rows are hashed and equal ones counted; hashes fall into buckets of about `fold` by their first digits, a
    bucket's sorted hashes make one, and so on with the buckets until one hash is left. No bucket grows with the
    table.
    """
    row = F.sha2(F.concat_ws(" ", F.col(key).cast("string"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 256)
    rows = df.groupBy(row.alias("h")).agg(F.count(F.lit(1)).alias("c"))
    level = checkpointed(rows.select(F.sha2(F.concat_ws(" ", "h", F.col("c").cast("string")), 256).alias("h"), "c"))
    while True:
        n = level.count()
        at = F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("long"), F.lit(max(1, -(-n // fold))))
        level = level.groupBy(at.alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.sum("c").alias("c")).drop("b")
        if n <= fold:
            return level.select(F.col("h").alias("sha256"), F.col("c").alias("rows"))
        level = checkpointed(level)
