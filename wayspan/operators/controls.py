"""What a control state shows: visible features in groups and order, and whether the selected one is still among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.functions.text import text_key
from wayspan.operators.serve import contains_all

# Groups in the order in which they are shown; access modes of the controls and of the data; gains that count.
GROUPS = ("extend_hours", "new_facility_zone", "verify-hours", "verify-accessibility", "verify-information", "retrofit_accessibility")
ACCESS = {"public": "public", "rider": "rider_conditional"}
GAINS = ("activeStops", "events", "uniqueRoutes", "uniqueTrips")


def group_of(action: Column, subtype: Column, action_class: Column) -> Column:
    """The group of a proposal: verifications go by their subtype, others by their class."""
    verify = F.when(subtype.isin("hours", "accessibility"), F.concat(F.lit("verify-"), subtype)).otherwise("verify-information")
    return F.when(action == "verify", verify).otherwise(F.coalesce(action_class, F.lit("unknown")))


def _place(group: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, GROUPS)), group)
    return F.coalesce(F.nullif(at, F.lit(0)), F.lit(len(GROUPS) + 1)).cast("int")


def counts_by_action(proposals: DataFrame, action: str = "action") -> DataFrame:
    """(action, n) of all published proposals."""
    return proposals.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def visible_features(states: DataFrame, places: DataFrame, proposals: DataFrame) -> DataFrame:
    """(state_id, group, group_place, position, id): what each control state lists, positions from 1 in each group.

    states: state_id, action, time, access (public or rider; others show nothing), walk, search (null or blank: all).
    places (action "open"): id, name, search_text, condition, observed (map of times to states); they are one group, by
    folded name, then id. proposals (other actions): id, action, subtype, action_class, rank, material_gain, search_text
    and cells (time, access, walk, active and numbers named as GAINS); a proposal shows where it is material and exactly
    one cell fits the state, which is active with a gain; groups come in a fixed order, unknown ones last by name, their
    members by rank (null last), then id. Every token of a search is in the folded search_text.

    States meet features by their keys; a state's list is as long as its result, and no list is held in one row.
    """
    s = states.withColumn("_query", text_key(F.coalesce("search", F.lit(""))))
    mode = reduce(lambda c, kv: c.when(F.col("access") == kv[0], kv[1]), list(ACCESS.items())[1:], F.when(F.col("access") == "public", ACCESS["public"]))
    shown = places.select("id", F.struct(F.lit(0).alias("r"), text_key(F.coalesce("name", F.lit(""))).alias("n")).alias("_order"), "condition", text_key(F.coalesce("search_text", F.lit(""))).alias("_text"), F.explode("observed").alias("time", "now")).where("now = 'open'")
    met = s.where("action = 'open'").select("state_id", "time", "access", "_query").join(shown.hint("merge"), "time")
    allowed = (F.col("condition") == "unrestricted") & F.col("access").isin("public", "rider") | ((F.col("condition") == "fare_paid") & (F.col("access") == "rider"))
    open_ = met.where(allowed & contains_all(F.col("_text"), F.col("_query"))).select("state_id", F.lit("open").alias("group"), F.lit(0).alias("group_place"), "_order", "id")

    cell = proposals.where("material_gain").select("id", "action", group_of(F.col("action"), F.col("subtype"), F.col("action_class")).alias("group"), F.coalesce(F.col("rank").cast("double"), F.lit(float("inf"))).alias("_rank"), text_key(F.coalesce("search_text", F.lit(""))).alias("_text"), F.explode("cells").alias("c"))
    some = reduce(Column.__or__, [F.coalesce(F.col(f"c.{g}") > 0, F.lit(False)) for g in GAINS])
    one = cell.groupBy("id", "action", "group", "_rank", "_text", F.col("c.time").alias("time"), F.col("c.access").alias("mode"), F.col("c.walk").alias("walk")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("c.active", F.lit(False)) & some).alias("gains")).where("n = 1 and gains")
    asked = s.where("action <> 'open'").select("state_id", "action", "time", mode.alias("mode"), "walk", "_query")
    fits = asked.join(one.hint("merge"), ["action", "time", "mode", "walk"]).where(contains_all(F.col("_text"), F.col("_query")))
    ranked = fits.select("state_id", "group", _place(F.col("group")).alias("group_place"), F.struct(F.col("_rank").alias("r"), F.lit("").alias("n")).alias("_order"), "id")

    both = open_.select("state_id", "group", "group_place", "_order.*", "id").unionByName(ranked.select("state_id", "group", "group_place", "_order.*", "id"))
    at = F.row_number().over(Window.partitionBy("state_id", "group").orderBy("r", "n", "id"))
    return both.withColumn("position", at).select("state_id", "group", "group_place", "position", "id")


def selections(states: DataFrame, visible: DataFrame) -> DataFrame:
    """(state_id, selected_id, invalidated): the selected feature (selected) of each state where it is still visible;
    invalidated where it no longer is. Nothing selected is not invalidated."""
    seen = visible.select("state_id", F.col("id").alias("selected")).distinct().withColumn("_seen", F.lit(True))
    told = states.select("state_id", "selected").join(seen.hint("merge"), ["state_id", "selected"], "left")
    return told.select("state_id", F.when(F.col("_seen"), F.col("selected")).alias("selected_id"), (F.col("selected").isNotNull() & F.col("_seen").isNull()).alias("invalidated"))
