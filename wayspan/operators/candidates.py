"""Candidates for change: new zones, verifications, retrofits, and what is published and reviewed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.operators.graph import covered
from wayspan.operators.reviews import GAPS
from wayspan.operators.temporal import effective_state, eligible
from wayspan.operators.whatif import coverage_gain, greedy_distinct


def uncovered_stops(active: DataFrame, baseline: DataFrame) -> DataFrame:
    """(snapshot_id, stop_id) active but not covered."""
    keys = ["snapshot_id", "stop_id"]
    return active.select(*keys).distinct().join(baseline.select(*keys).distinct().hint("merge"), keys, "left_anti")


def seed_stops(uncovered: DataFrame, snaps: DataFrame) -> DataFrame:
    """(node, stop_id): one seed for each node with an uncovered stop, the smallest of its stops. snaps: stop_id,
    node."""
    return uncovered.select("stop_id").distinct().join(snaps.select("stop_id", "node").hint("merge"), "stop_id").groupBy("node").agg(F.min("stop_id").alias("stop_id"))


def trip_effects(footprints: DataFrame, baseline: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, effect): the (snapshot, trip) pairs that a source would newly serve."""
    keys = ["snapshot_id", "stop_id"]
    new = footprints.join(baseline.select(*keys).distinct().hint("merge"), keys, "left_anti")
    return new.join(events.hint("merge"), keys).select("source_id", F.struct("snapshot_id", "trip").alias("effect")).distinct()


def new_zones(footprints: DataFrame, baseline: DataFrame, events: DataFrame, share: float = 0.8) -> DataFrame:
    """New-place zones: the gain (see coverage_gain) of every seed, of which those remain that no better one covers
    by `share` of its effects. Seeds rank by trips, routes and stops gained, then by id. A seed without any effect
    is an error."""
    gain = coverage_gain(footprints, baseline, events)
    if not gain.where("new_trips = 0").isEmpty() or not footprints.select("source_id").distinct().join(gain.select("source_id").hint("merge"), "source_id", "left_anti").isEmpty():
        raise ValueError("a seed has no effect")
    rank = F.struct(-F.col("new_trips"), -F.col("new_routes"), -F.col("new_stops"), F.col("source_id"))
    effects = trip_effects(footprints, baseline, events).select(F.col("source_id").alias("candidate_id"), "effect")
    kept = greedy_distinct(effects, gain.select(F.col("source_id").alias("candidate_id"), rank.alias("rank")), share).where("kept")
    return gain.join(kept.select(F.col("candidate_id").alias("source_id")).hint("merge"), "source_id", "left_semi")


def _active(places: DataFrame, states: DataFrame, scenario: dict[str, str], accepted: list[str]) -> DataFrame:
    """(place_id, snapshot_id) where the effective state under the scenario is accepted, of permitted places."""
    state = effective_state(F.col("observed"), F.col("scheduled"), F.lit(scenario["closure_mode"]), F.lit(scenario["information_mode"]))
    told = states.where(state.isin(*accepted)).select("place_id", "snapshot_id")
    return told.join(eligible(places, F.lit(scenario["access_mode"])).select("place_id").hint("merge"), "place_id", "left_semi")


def _gains(active: DataFrame, footprints: DataFrame, baseline: DataFrame, events: DataFrame, kind: str, prefix: str, label: str) -> DataFrame:
    """Gains of the places with an active snapshot and a footprint, over those snapshots; places that reach no event
    gain nothing, but stay."""
    own = footprints.join(active.select(F.col("place_id").alias("source_id"), "snapshot_id").hint("merge"), ["source_id", "snapshot_id"], "left_semi")
    who = active.select(F.col("place_id").alias("source_id")).distinct().join(footprints.select("source_id").distinct().hint("merge"), "source_id", "left_semi")
    gain = coverage_gain(own, baseline, events)
    numbers = [c for c in gain.columns if c != "source_id"]
    told = who.join(gain.hint("merge"), "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return told.select(F.concat(F.lit(prefix), F.col("source_id").cast("string")).alias("candidate_id"), F.col("source_id").alias("place_id"), F.lit(kind).alias("kind"), F.lit(label).alias("gain_label"), *numbers)


def verifications(places: DataFrame, states: DataFrame, footprints: DataFrame, baseline: DataFrame, accessible_baseline: DataFrame, events: DataFrame, scenario: dict[str, str]) -> DataFrame:
    """What could be gained by verifying: hours of places whose hours are unknown in a snapshot, against all that is
    covered; accessibility of open places of unknown accessibility, against what accessible places cover.

    places: place_id, access_condition, accessibility; states: place_id, snapshot_id, scheduled, observed; scenario:
    access_mode, closure_mode, information_mode. The two kinds are apart; gains are potential.
    """
    hours = _gains(_active(places, states, scenario, ["unknown_hours"]), footprints, baseline, events, "hours", "verify-hours:", "potential_if_verified")
    unsure = places.where("accessibility = 'unknown'")
    access = _gains(_active(unsure, states, scenario, ["open"]), footprints, accessible_baseline, events, "accessibility", "verify-accessibility:", "potential_if_verified")
    return hours.unionByName(access)


def retrofits(places: DataFrame, states: DataFrame, footprints: DataFrame, accessible_baseline: DataFrame, events: DataFrame, scenario: dict[str, str], primary: bool = True) -> DataFrame:
    """What retrofits would gain: places known to be inaccessible that are open (in sensitivity runs also potentially
    open), against what accessible places cover."""
    barred = places.where("accessibility = 'inaccessible'")
    accepted = ["open"] if primary else ["open", "potential_open"]
    return _gains(_active(barred, states, scenario, accepted), footprints, accessible_baseline, events, "retrofit", "retrofit-accessibility:", "incremental")


def applicable(kind: Column, information_mode: Column) -> Column:
    """Whether a scenario applies: optimistic information leaves nothing for hours extensions or verifications."""
    return ~((information_mode == "optimistic_information") & kind.isin("extend_hours", "verify_information"))


# --- summaries and publication ------------------------------------------------------------------


def snapshot_summary(places: DataFrame, states: DataFrame, stops: DataFrame, max_snap: float) -> DataFrame:
    """One row for each snapshot: open access points (clusters) and records, unrestricted and fare-paid, states of the
    unrestricted places, accessible open ones, active and covered stops and the percentage.

    places: place_id, access_condition, accessible, cluster, snap_metres; states: snapshot_id, place_id, state (open,
    closed, temporarily closed, unknown); stops: snapshot_id, stop_id, covered.
    """
    met = states.join(places.hint("merge"), "place_id")
    free, fare = F.col("access_condition") == "unrestricted", F.col("access_condition") == "fare_paid"
    open_ = (F.col("state") == "open") & (F.col("snap_metres") <= max_snap)
    told = met.groupBy("snapshot_id").agg(
        F.countDistinct(F.when(free & open_, F.col("cluster"))).alias("open_access_points"), F.count_if(free & open_).alias("open_records"),
        F.countDistinct(F.when(fare & open_, F.col("cluster"))).alias("fare_paid_open_access_points"), F.count_if(fare & open_).alias("fare_paid_open_records"),
        F.count_if(free & (F.col("state") == "closed")).alias("scheduled_closed"), F.count_if(free & (F.col("state") == "temporarily closed")).alias("temporarily_closed"),
        F.count_if(free & (F.col("state") == "unknown")).alias("unknown_hours"), F.count_if(free & open_ & F.coalesce("accessible", F.lit(False))).alias("accessible_open"),
    )
    active = stops.groupBy("snapshot_id").agg(F.countDistinct("stop_id").alias("active_stops"), F.countDistinct(F.when(F.col("covered"), F.col("stop_id"))).alias("covered_stops"))
    out = told.join(active.hint("merge"), "snapshot_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("active_stops", "covered_stops")})
    return out.withColumn("coverage_percent", F.when(F.col("active_stops") > 0, 100 * F.col("covered_stops") / F.col("active_stops")).otherwise(0.0))


def headlines(summary: DataFrame, stops: DataFrame, events: DataFrame) -> DataFrame:
    """The earlier summary of each snapshot beside the new counts: active stops, events, trips and covered stops.
    stops: snapshot_id, stop_id, event_count, covered; events: snapshot_id, trip."""
    counts = stops.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("active_stop_count"), F.sum("event_count").alias("event_count"), F.count_if("covered").alias("covered_stop_count"))
    trips = events.groupBy("snapshot_id").agg(F.countDistinct("trip").alias("unique_trip_count"))
    return summary.join(counts.hint("merge"), "snapshot_id").join(trips.hint("merge"), "snapshot_id")


def stop_coverage(distances: DataFrame, stops: DataFrame, active: DataFrame, walks: list[int], modes: list[str], gaps: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, stop_id, coverage, and the gap flags if given): for every active stop a map from access mode to a
    map from walking distance to whether it is covered.

    distances: label (snapshot_id, access), node, dist within the largest walk; stops: stop_id, node, offset; active:
    snapshot_id, stop_id; gaps: snapshot_id, stop_id and the flags.
    """
    near = covered(distances, stops, float(max(walks))).select("label.snapshot_id", "label.access", "stop_id", "dist")
    best = near.groupBy("snapshot_id", "stop_id").pivot("access", modes).agg(F.min("dist"))
    told = active.select("snapshot_id", "stop_id").distinct().join(best.hint("merge"), ["snapshot_id", "stop_id"], "left")
    within = lambda m: F.create_map(*[x for w in walks for x in (F.lit(str(w)), F.coalesce(F.col(m) <= w, F.lit(False)))])
    out = told.select("snapshot_id", "stop_id", F.create_map(*[x for m in modes for x in (F.lit(m), within(m))]).alias("coverage"))
    return out if gaps is None else out.join(gaps.select("snapshot_id", "stop_id", *GAPS).hint("merge"), ["snapshot_id", "stop_id"], "left")


def published(df: DataFrame, statuses: DataFrame, key: str, status: str = "valid") -> DataFrame:
    """Rows whose review has the status."""
    return df.join(statuses.where(F.col("status") == status).select(key).hint("merge"), key, "left_semi")


# Fields of the published candidate contract.
CONTRACT = (
    "candidate_id", "candidate_class", "verification_kind", "name", "lon", "lat", "source_stop_id", "facility_id", "facility", "gain_label", "primary_metrics", "sensitivity_metrics",
    "primary_rank", "sensitivity_ranks", "stability", "material_gain", "audit_status", "source_error", "duplicate_candidate", "misclassified_access", "review_flags",
)
METRICS = ("unique_trips", "unique_routes", "active_stops", "stop_time_events")


def public_candidates(candidates: DataFrame, metrics: DataFrame, ranks: DataFrame, primary: str) -> DataFrame:
    """Candidates as published: the fields of the contract that there are and nothing else (no trip ids), with the
    metrics of the primary scenario, those of the others as a list by scenario, and the ranks.

    metrics: candidate_id, scenario_id and METRICS; ranks: candidate_id, scenario_id, applicable, rank.
    """
    row = F.struct("scenario_id", *METRICS)
    nested = metrics.groupBy("candidate_id").agg(F.max(F.when(F.col("scenario_id") == primary, row)).alias("primary_metrics"), F.sort_array(F.collect_list(F.when(F.col("scenario_id") != primary, row))).alias("sensitivity_metrics"))
    rank = F.struct("scenario_id", "applicable", F.when(F.col("applicable"), F.col("rank")).alias("rank"))
    listed = ranks.groupBy("candidate_id").agg(F.max(F.when(F.col("scenario_id") == primary, F.col("rank"))).alias("primary_rank"), F.sort_array(F.collect_list(F.when(F.col("scenario_id") != primary, rank))).alias("sensitivity_ranks"))
    own = candidates.drop("primary_metrics", "sensitivity_metrics", "primary_rank", "sensitivity_ranks")
    told = own.join(nested.hint("merge"), "candidate_id", "left").join(listed.hint("merge"), "candidate_id", "left")
    return told.select(*[c for c in CONTRACT if c in told.columns])


def review_rows(candidates: DataFrame, metrics: DataFrame, others: DataFrame, gained: DataFrame, decisions: DataFrame, near: int = 3) -> DataFrame:
    """A row for each candidate under review: its fields, metrics, the nearest other places as text, the number of
    stops gained, and the decision (source review where there is none for this content).

    metrics: candidate_id and wide columns; others: candidate_id, place_id, name, metres; gained: candidate_id,
    stop_id; decisions: candidate_id, analysis_hash, audit_status, evidence_note, reviewer, reviewed_at.
    """
    order = Window.partitionBy("candidate_id").orderBy("metres", "place_id", "name")
    best = others.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= near)
    text = F.concat_ws(":", F.col("place_id").cast("string"), F.col("name"), F.format_string("%.1fm", F.col("metres").cast("double")))
    listed = best.groupBy("candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), " | ").alias("nearest_others"))
    stops = gained.groupBy("candidate_id").agg(F.countDistinct("stop_id").alias("gained_stops"))
    told = candidates.join(metrics.hint("merge"), "candidate_id", "left").join(listed.hint("merge"), "candidate_id", "left").join(stops.hint("merge"), "candidate_id", "left")
    met = told.join(decisions.hint("merge"), ["candidate_id", "analysis_hash"], "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("nearest_others", "evidence_note", "reviewer", "reviewed_at")}
    return met.withColumns(blank | {"gained_stops": F.coalesce("gained_stops", F.lit(0)), "audit_status": F.coalesce("audit_status", F.lit("source review"))})


def resolved_crossings(crossings: DataFrame, decisions: DataFrame, digits: int = 2) -> DataFrame:
    """crossings (a, b, x, y) with the reviewed action: connect, keep_disconnected, or unresolved where none was made
    for that pair at that place. decisions: a, b, x, y, action."""
    key = lambda df: df.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b"), "_x": F.bround("x", digits), "_y": F.bround("y", digits)})
    told = key(decisions).select("_a", "_b", "_x", "_y", F.col("action")).dropDuplicates(["_a", "_b", "_x", "_y"])
    met = key(crossings).join(told.hint("merge"), ["_a", "_b", "_x", "_y"], "left")
    return met.withColumn("action", F.coalesce("action", F.lit("unresolved"))).drop("_a", "_b", "_x", "_y")


def connecting_cuts(resolved: DataFrame, segments: DataFrame, segment: str) -> DataFrame:
    """(segment, share): where both segments of every connected crossing are to be cut, for split_segments."""
    place = resolved.where("action = 'connect'").select(F.explode(F.array("a", "b")).alias(segment), "x", "y")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    return place.join(segments.hint("merge"), segment).select(segment, share.alias("share"))
