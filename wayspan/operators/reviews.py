"""Review decisions, evidence by category, gap flags, publication maps and control-state matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decided(candidates: DataFrame, decisions: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Candidates with `status` and `binding`: a decision holds only for the content it was made on."""
    told = candidates.join(decisions.select(key, F.col(fingerprint).alias("_f"), F.col("status").alias("_s")), key, "left")
    same = F.col("_f") == F.col(fingerprint)
    binding = F.when(F.col("_f").isNull(), "missing").when(same, "current").otherwise("stale")
    return told.withColumns({"binding": binding, "status": F.when(same, F.col("_s")).otherwise("source review")}).drop("_f", "_s")


def nearest_by_category(pairs: DataFrame, by: list[str], categories: dict[str, Column], distance: str, place: str) -> DataFrame:
    """For each group and category the nearest place (the smaller id on ties) and its distance, as columns."""
    best = [F.min(F.when(c, F.struct(F.col(distance).alias("d"), F.col(place).alias("p")))).alias(name) for name, c in categories.items()]
    out = pairs.groupBy(*by).agg(*best)
    return out.select(*by, *[F.col(f"{n}.p").alias(f"{n}_place") for n in categories], *[F.col(f"{n}.d").alias(f"{n}_distance") for n in categories])


# The categories of evidence that the flags are read from.
EVIDENCE = ("documented", "open", "scheduled_closed", "seasonal_closed", "temporary_closed", "construction_closed", "unknown_hours", "open_accessible", "open_inaccessible", "open_unknown_accessibility")
GAPS = ("geographic_gap", "scheduled_time_gap", "seasonal_gap", "temporary_service_gap", "accessibility_gap", "information_gap")


def gap_flags(nearest: DataFrame, limit: float) -> DataFrame:
    """nearest (a distance column for each category of EVIDENCE, e.g. from nearest_by_category) with has_<category>
    and the flags GAPS, which may hold together. A category is present if its nearest place lies within the limit."""
    has = {c: F.coalesce(F.col(f"{c}_distance") <= limit, F.lit(False)) for c in EVIDENCE}
    closed = ~has["open"]
    flags = (
        ~has["documented"], closed & has["scheduled_closed"], closed & has["seasonal_closed"], closed & (has["temporary_closed"] | has["construction_closed"]),
        has["open"] & has["open_inaccessible"] & ~has["open_accessible"],
        (closed & has["unknown_hours"]) | (has["open"] & ~has["open_accessible"] & has["open_unknown_accessibility"]),
    )
    return nearest.withColumns({f"has_{c}": v for c, v in has.items()} | dict(zip(GAPS, flags, strict=True)))


def evidence_categories(state: Column, accessibility: Column) -> dict[str, Column]:
    """The condition of each category of EVIDENCE on a place's effective state and accessibility."""
    open_ = state.isin("open", "potential_open")
    plain = {c: state == c for c in ("scheduled_closed", "seasonal_closed", "temporary_closed", "construction_closed", "unknown_hours")}
    told = {"documented": F.lit(True), "open": open_, **plain, "open_accessible": open_ & (accessibility == "accessible"), "open_inaccessible": open_ & (accessibility == "inaccessible"), "open_unknown_accessibility": open_ & (accessibility == "unknown")}
    return {c: told[c] for c in EVIDENCE}


def state_maps(states: DataFrame, key: str, moment: str, values: list[str]) -> DataFrame:
    """(key, state_by_time): one map from moments to the named values."""
    entry = F.struct(F.col(moment), F.struct(*values))
    return states.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("state_by_time"))


def wide_metrics(metrics: DataFrame, key: str, scenario: str, scenarios: list[str], values: list[str]) -> DataFrame:
    """One column for each scenario and metric; the scenario list is fixed, so no pass finds it."""
    return metrics.groupBy(key).pivot(scenario, scenarios).agg(*[F.max(v).alias(v) for v in values])


def with_applicability(runs: DataFrame, applicable: Column, rank: str) -> DataFrame:
    """Sensitivity runs with `applicable`; other runs keep a row without a rank."""
    told = runs.withColumn("applicable", F.coalesce(applicable, F.lit(False)))
    return told.withColumn(rank, F.when(F.col("applicable"), F.col(rank)))


def surface_heights(surface: DataFrame, terrain: DataFrame, low: float, high: float, most: float = 600.0) -> DataFrame:
    """(row, col, height, valid): surface less terrain, 0 to most; invalid and 0 where either is missing or out of
    range."""
    met = surface.select("row", "col", F.col("z").alias("s")).join(terrain.select("row", "col", F.col("z").alias("t")), ["row", "col"], "full")
    good = F.coalesce(F.col("s").between(low, high) & F.col("t").between(low, high), F.lit(False))
    return met.select("row", "col", F.when(good, F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("s") - F.col("t")))).otherwise(0.0).alias("height"), good.alias("valid"))


def correction_report(pixels: DataFrame, canopy: Column, before: str, after: str, measured: Column) -> DataFrame:
    """One row: canopy pixels, raised ones, mean and greatest rise, and how many rises were measured."""
    rise = F.col(after) - F.col(before)
    up = canopy & (rise > 0)
    return pixels.agg(
        F.count_if(canopy).alias("canopy"), F.count_if(up).alias("raised"), F.avg(F.when(up, rise)).alias("mean_rise"), F.max(F.when(up, rise)).alias("max_rise"),
        F.count_if(up & measured).alias("measured"), F.count_if(up & ~measured).alias("defaulted"),
    )


def state_matrix(cells: DataFrame, keys: list[str], dims: DataFrame, key: str) -> DataFrame:
    """(keys, results, first): number of active cells with a gain and the smallest id, for every control state of
    dims, empty ones too."""
    told = cells.where("active and gain > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("results"), F.min(key).alias("first"))
    return dims.join(told.hint("merge"), keys, "left").withColumn("results", F.coalesce("results", F.lit(0)))


def disclosure(condition: Column) -> Column:
    """(condition, requires_fare, label) to show with a place; null where the condition isn't known."""
    told = lambda fare, label: F.struct(condition.alias("condition"), F.lit(fare).alias("requires_fare"), F.lit(label).alias("label"))
    return F.when(condition == "fare_paid", told(True, "Fare-paid area, valid fare required")).when(condition == "unrestricted", told(False, "No fare required"))


def default_results(features: DataFrame, cells: str, action: str, moment: str, access: str, walk: int) -> DataFrame:
    """The headline list: audited, material features of an action whose cell for the control state is active and
    gains stops, events or trips, by rank. features: action, audit_status, material_gain, primary_rank, cells."""
    same = lambda c: (c["time"] == moment) & (c["access"] == access) & (c["walk"] == walk)
    told = features.where((F.col("action") == action) & (F.col("audit_status") == "valid") & F.col("material_gain")).withColumn("cell", F.get(F.filter(cells, same), F.lit(0)))
    gains = (F.col("cell.activeStops") > 0) | (F.col("cell.events") > 0) | (F.col("cell.uniqueTrips") > 0)
    return told.where(F.col("cell.active") & gains).orderBy("primary_rank")
