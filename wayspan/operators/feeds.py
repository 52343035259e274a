"""Transit feeds: stop times joined to active trips, stops and stations, in time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.functions.text import blank_to_null
from wayspan.operators.temporal import events_in_windows, service_seconds


def active_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    """(date, feed_id, trip_id, route_id) of the trips whose service (date, service_id, and feed_id if named there)
    runs."""
    keys = [c for c in ("feed_id", "service_id") if c in services.columns]
    return trips.join(services.hint("merge"), keys).select("date", "feed_id", "trip_id", "route_id")


def timed_stops(stop_times: DataFrame) -> DataFrame:
    """stop_times with seconds of the service day: the departure, else the arrival; rows without either go."""
    raw = F.coalesce(blank_to_null(F.col("departure_time")), blank_to_null(F.col("arrival_time")))
    # the explode binds the text: the filter and the seconds don't compute it again
    return stop_times.withColumn("_raw", F.explode(F.array(raw))).where("_raw is not null").withColumn("seconds", service_seconds(F.col("_raw"))).drop("_raw")


def stop_events(feed: dict[str, DataFrame], services: DataFrame, windows: DataFrame, half_minutes: int) -> DataFrame:
    """One row for each stop time of an active trip and each window (window_id, minute) that it falls into, both ends
    included: date, window_id, feed_id, trip_id, route_id, event_minute, and of the stop stop_id, stop_name, lon,
    lat, parent_station and the parent's name (stations only; empty if there is none).

    Windows are met before trips: what lies in none never moves. Stop times of unknown stops are left out.
    """
    centres = windows.select("window_id", (F.col("minute") * 60).alias("centre"))
    near = events_in_windows(timed_stops(feed["stop_times"]).select("feed_id", "trip_id", "stop_id", "seconds"), centres, "seconds", half_minutes * 60)
    met = near.join(active_trips(feed["trips"], services).hint("merge"), ["feed_id", "trip_id"])
    stops = feed["stops"].select("feed_id", "stop_id", "stop_name", F.col("stop_lon").cast("double").alias("lon"), F.col("stop_lat").cast("double").alias("lat"), F.coalesce("parent_station", F.lit("")).alias("parent_station"))
    stations = feed["stops"].where("location_type = '1'").select("feed_id", F.col("stop_id").alias("parent_station"), F.col("stop_name").alias("parent_station_name"))
    named = stops.join(stations.hint("merge"), ["feed_id", "parent_station"], "left").withColumn("parent_station_name", F.coalesce("parent_station_name", F.lit("")))
    out = met.join(named.hint("merge"), ["feed_id", "stop_id"]).withColumn("event_minute", F.floor(F.col("seconds") / 60).cast("int"))
    return out.select("date", "window_id", "feed_id", "trip_id", "route_id", "event_minute", "stop_id", "stop_name", "lon", "lat", "parent_station", "parent_station_name")


def in_trip_order(events: DataFrame) -> DataFrame:
    """Events by window, trip, minute and stop, sorted in ranges."""
    return events.orderBy("window_id", "trip_id", "event_minute", "stop_id")


def collapsed_stops(events: DataFrame, stops: DataFrame, by: list[str], inside: Column | None = None) -> DataFrame:
    """(by, feed_id, stop_id, name, lon, lat): active stops, each child replaced by its parent station where the feed
    has it (else the child's own place under the parent's id). inside keeps places by their lon and lat."""
    key = F.coalesce(blank_to_null(F.col("parent_station")), F.col("stop_id"))
    told = events.select(*by, "feed_id", key.alias("_key"), F.struct("stop_id", F.col("stop_name").alias("name"), "lon", "lat").alias("_own"))
    once = told.groupBy(*by, "feed_id", "_key").agg(F.min("_own").alias("_own"))
    known = stops.select("feed_id", F.col("stop_id").alias("_key"), F.col("stop_name").alias("_name"), F.col("stop_lon").cast("double").alias("_lon"), F.col("stop_lat").cast("double").alias("_lat"), F.lit(True).alias("_known"))
    met = once.join(known.hint("merge"), ["feed_id", "_key"], "left")
    pick = lambda c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(f"_own.{c}")).alias(c)
    out = met.select(*by, "feed_id", F.col("_key").alias("stop_id"), pick("name"), pick("lon"), pick("lat"))
    return out if inside is None else out.where(inside)
