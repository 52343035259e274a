"""The six published sources of places, each brought from its own columns to the one schema (ways.PLACE).

Every mapping takes tables as they are published (text columns) and gives one row a place. Blank texts count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.functions.text import blank_to_null
from wayspan.functions.ways import as_places
from wayspan.operators.temporal import hours_text

# Codes of days in the keyed hours, and texts that stand for what a source does not publish.
DAY_CODES = (("mo", "Mon"), ("tu", "Tue"), ("w", "Wed"), ("th", "Thu"), ("f", "Fri"), ("sa", "Sat"), ("su", "Sun"))
PLACEHOLDER_IDS = ("n/a", "none", "unknown")
AUTOMATED_HOURS, AUTOMATED_NOTES = "Seasonal Apr-Oct; daily hours not published", "Barrier-free and seasonal. Exact daily hours are not published."
STATION_HOURS, STATION_NOTES = "Mon-Sat 6 a.m. to 2 a.m.; Sun 8 a.m. to 2 a.m.", "Located in the fare-paid area."


def position(geometry: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON point, or of a multi-point's first position; null where there are none."""
    numbers = F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    return F.get(numbers, F.lit(0)).cast("double"), F.get(numbers, F.lit(1)).cast("double")


def _said(c: str, *words: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*words), F.lit(False))


def _told(c: str) -> Column:
    """A text that says something: not blank and not the word None."""
    return F.when(F.col(c) != "None", blank_to_null(F.col(c)))


def park_places(rows: DataFrame, hours: DataFrame, url: str) -> DataFrame:
    """Parks. hours: id and, for each day code, oh<code>o and oh<code>c; they stand in where the published hours only
    name the centre's. Status 0 is closed for now, 2 partly open; reasons and comments are the notes, which tell the kind
    of closure. url: where the source is published, for rows without a link."""
    keyed = hours.select(F.col("id").alias("_id"), hours_text({label: (F.col(f"oh{code}o"), F.col(f"oh{code}c")) for code, label in DAY_CODES}).alias("_city")).dropDuplicates(["_id"])
    met = rows.join(keyed.hint("merge"), rows["id"] == keyed["_id"], "left")
    named = F.when(F.contains(F.lower("hours"), F.lit("centre")), F.col("_city"))
    lon, lat = position(F.col("geometry"))
    notes = F.concat_ws("; ", _told("Reason"), _told("Comments"))
    return as_places(
        met, "parks",
        {
            "place_id": F.coalesce(blank_to_null(F.col("asset_id")), F.col("id")), "name": F.coalesce(blank_to_null(F.col("alternative_name")), blank_to_null(F.col("location")), F.lit("Park washroom")),
            "address": F.col("address"), "lon": lon, "lat": lat, "hours_raw": F.coalesce(named, F.col("hours")), "accessible": F.when(~F.coalesce(F.lower(F.trim("accessible")).isin("", "none"), F.lit(True)), True),
            "all_gender": F.when(F.contains(F.lower("type"), F.lit("all-gender")), True), "reason": notes, "temporarily_closed": F.coalesce(F.col("Status") == "0", F.lit(False)),
            "partial_service": F.coalesce(F.col("Status") == "2", F.lit(False)), "source_url": F.coalesce(blank_to_null(F.col("url")), F.lit(url)), "notes": notes,
        },
    )


def library_places(rows: DataFrame) -> DataFrame:
    """Branches with a public washroom."""
    lon, lat = position(F.col("geometry"))
    own = rows.where("PublicWashroom = '1'")
    return as_places(own, "library", {"place_id": F.col("BranchCode"), "name": F.concat("BranchName", F.lit(" library")), "address": F.col("Address"), "lon": lon, "lat": lat, "hours_raw": F.col("Hours"), "source_url": F.col("Website")})


def museum_places(rows: DataFrame, points: DataFrame, url: str) -> DataFrame:
    """Museums with a washroom. rows have number (the row of the file, from 1), which is the id; points: name, geometry.
    A museum without a point is an error that names it."""
    name = "Museums and Cultural Centres"
    own = rows.where("`Washroom?` = 'Yes'").withColumnRenamed("geometry", "_unused") if "geometry" in rows.columns else rows.where("`Washroom?` = 'Yes'")
    at = points.groupBy(F.col("name").alias("_name")).agg(F.min("geometry").alias("geometry"))
    met = own.join(at.hint("merge"), own[name] == at["_name"], "left")
    found = F.when(F.col("geometry").isNotNull(), F.col("geometry")).otherwise(F.raise_error(F.concat(F.lit("no address point: "), F.coalesce(F.col(name), F.lit("")))))
    lon, lat = position(found)
    accessible = F.when(_said("Accessible?", "yes"), True).when(_said("Accessible?", "no"), False)
    return as_places(met, "museum", {"place_id": F.col("number"), "name": F.col(name), "address": F.col("Address"), "lon": lon, "lat": lat, "hours_raw": F.col("Hours"), "accessible": accessible, "all_gender": _said("Gender Inclusive?", "yes"), "reason": F.col("Notes"), "source_url": F.lit(url), "notes": F.col("Notes")})


def automated_places(rows: DataFrame, url: str) -> DataFrame:
    """Automated washrooms: barrier-free, hours unknown, closed for now unless they exist already."""
    lon, lat = position(F.col("geometry"))
    address = F.concat_ws(" ", blank_to_null(F.col("ADDRESSNUMBERTEXT")), blank_to_null(F.col("ADDRESSSTREET")))
    return as_places(rows, "automated", {"place_id": F.col("ID"), "name": F.concat(F.lit("Automated public washroom at "), address), "address": address, "lon": lon, "lat": lat, "hours_raw": F.lit(AUTOMATED_HOURS), "accessible": F.lit(True), "reason": F.col("STATUS"), "temporarily_closed": F.coalesce(F.col("STATUS") != "Existing", F.lit(True)), "source_url": F.lit(url), "notes": F.lit(AUTOMATED_NOTES)})


def building_places(rows: DataFrame, url: str) -> DataFrame:
    """Buildings with public washrooms, one place a building: rows (with number, their order) of one FLOC_ID, or of one
    name and address where that is a placeholder. The first row gives name, address and position; hours hold only if all
    rows agree; any row makes it accessible or gender inclusive."""
    ident = blank_to_null(F.col("FLOC_ID"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.when(ident.isNull() | F.lower(ident).isin(*PLACEHOLDER_IDS), F.concat(text("Building Description"), F.lit("|"), text("Address"))).otherwise(ident)
    public = rows.where("`Washroom Status` = 'Open - Public Access'").withColumn("_key", key)
    hours = F.trim(text("Hours Available"))
    whole = public.groupBy("_key").agg(
        F.min_by(F.struct(F.col("Building Description").alias("name"), F.col("Address").alias("address"), "geometry"), "number").alias("f"), F.min(hours).alias("lo"), F.max(hours).alias("hi"),
        F.bool_or(_said("Accessible Washroom", "yes")).alias("accessible"), F.bool_or(_said("Gender Inclusive", "yes")).alias("inclusive"), F.count(F.lit(1)).alias("n"),
    )
    lon, lat = position(F.col("f.geometry"))
    return as_places(whole, "crem", {"place_id": F.col("_key"), "name": F.coalesce("f.name", F.lit("City building")), "address": F.col("f.address"), "lon": lon, "lat": lat, "hours_raw": F.when(F.col("lo") == F.col("hi"), F.col("lo")), "accessible": F.col("accessible"), "all_gender": F.col("inclusive"), "record_count": F.col("n"), "source_url": F.lit(url)})


def station_places(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Stations with a washroom behind the gate, one place a station (rows: station, source_url, number). The place is
    that of the feed's station of the same name; a station that the feed lacks is an error that names it."""
    own = rows.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min_by("source_url", "number").alias("url"))
    known = stops.where("location_type = '1'").groupBy(F.col("stop_name").alias("_name")).agg(F.max_by(F.struct("stop_lon", "stop_lat"), "stop_id").alias("at"))
    met = own.join(known.hint("merge"), own["station"] == known["_name"], "left")
    at = F.when(F.col("at").isNotNull(), F.col("at")).otherwise(F.raise_error(F.concat(F.lit("station missing from the feed: "), F.col("station"))).cast("struct<stop_lon:string,stop_lat:string>"))
    place = F.replace(F.lower("station"), F.lit(" "), F.lit("-"))
    return as_places(met, "ttc", {"place_id": place, "name": F.concat("station", F.lit(" station")), "address": F.col("station"), "lon": at["stop_lon"].cast("double"), "lat": at["stop_lat"].cast("double"), "hours_raw": F.lit(STATION_HOURS), "accessible": F.lit(True), "record_count": F.col("n"), "source_url": F.col("url"), "notes": F.lit(STATION_NOTES)})
