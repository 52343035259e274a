"""Street, rail and water ways by their tags, layers by class, and sources brought to one schema of places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.functions.text import access_condition, blank_to_null, closure_category, text_key

# Tags that leave a way out of the walkable streets.
EXCLUDED_HIGHWAYS = ("construction", "motorway", "motorway_link", "proposed", "raceway", "service")
BLOCKED_ACCESS = ("no", "private")
# Services of spur track, and tunnels that bury a watercourse.
SPUR_SERVICES = ("spur", "yard", "siding")
BURIED_TUNNELS = ("culvert", "yes", "building_passage")

#: Columns of the one schema of places.
PLACE = ("place_id", "source", "name", "address", "lon", "lat", "hours_raw", "accessible", "all_gender", "access_condition", "closure_category", "temporarily_closed", "partial_service", "record_count", "source_url", "notes")


def _tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _in(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def rail_tier(tags: Column) -> Column:
    return F.when(_in(_tag(tags, "service"), SPUR_SERVICES), "spur").otherwise("rail")


def water_tier(tags: Column) -> Column:
    return F.when(_tag(tags, "waterway") == "river", "river").otherwise("stream")


def street_tier(tags: Column) -> Column:
    """motorway for motorways and trunk roads, else major."""
    highway = F.coalesce(_tag(tags, "highway"), F.lit(""))
    return F.when(highway.startswith("motorway") | highway.startswith("trunk"), "motorway").otherwise("major")


def buried(tags: Column) -> Column:
    """Whether a watercourse runs in a tunnel or underground."""
    return _in(_tag(tags, "tunnel"), BURIED_TUNNELS) | _in(_tag(tags, "location"), ("underground",))


def walkable(tags: Column) -> Column:
    """Named streets open to walkers: not of an excluded kind, and not barred to them (private access is fine where
    walking is allowed)."""
    highway, foot = _tag(tags, "highway"), _tag(tags, "foot")
    barred = _in(foot, BLOCKED_ACCESS) | (_in(_tag(tags, "access"), BLOCKED_ACCESS) & ~_in(foot, ("yes",)))
    return F.coalesce((text_key(F.coalesce(_tag(tags, "name"), F.lit(""))) != "") & highway.isNotNull() & ~highway.isin(*EXCLUDED_HIGHWAYS) & ~barred, F.lit(False))


def layer(df: DataFrame, fields: dict[str, str], column: str | None = None, classes: list[str] | None = None) -> DataFrame:
    """A layer's rows of the named classes, with the fields (old to new name) that are kept."""
    told = df if column is None else df.where(F.col(column).isin(*(classes or [])))
    return told.select(*[F.col(a).alias(b) for a, b in fields.items()])


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in a box (west, south, east, north)."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def touches_box(coords: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether any vertex (lon, lat) of a line lies in the box."""
    return F.exists(coords, lambda p: within_box(p["lon"], p["lat"], box))


def with_geometry(df: DataFrame, coords: str) -> DataFrame:
    """Rows whose geometry isn't null or empty."""
    return df.where(F.coalesce(F.size(coords) > 0, F.lit(False)))


def tri_state(c: Column, yes: tuple[str, ...], no: tuple[str, ...] = ()) -> Column:
    """True, false or unknown (null) by the words of a column."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*yes), True).when(word.isin(*no), False) if no else F.when(word.isin(*yes), True)


def as_places(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    """A source's rows in the schema PLACE. columns maps its fields to expressions (place_id without the source's
    prefix); `reason` instead of closure_category is classified; fields that a source lacks get their defaults."""
    text = lambda c: c.cast("string")
    told = dict(columns)
    if "reason" in told:
        told["closure_category"] = closure_category(told.pop("reason"))
    told["place_id"] = F.concat(F.lit(f"{source}:"), text(told["place_id"]))
    told |= {"source": F.lit(source), "access_condition": access_condition(F.lit(source))}
    empty = {"name": F.lit(""), "address": F.lit(""), "hours_raw": F.lit(""), "accessible": F.lit(None), "all_gender": F.lit(None), "closure_category": F.lit("none"), "temporarily_closed": F.lit(False), "partial_service": F.lit(False), "record_count": F.lit(1), "source_url": F.lit(""), "notes": F.lit("")}
    kinds = {"lon": "double", "lat": "double", "accessible": "boolean", "all_gender": "boolean", "temporarily_closed": "boolean", "partial_service": "boolean", "record_count": "bigint"}
    out = []
    for name in PLACE:
        value = told.get(name, empty.get(name))
        if name in ("name", "address", "hours_raw", "source_url", "notes") and name in told:
            value = F.coalesce(blank_to_null(text(value)), F.lit(""))
        out.append(value.cast(kinds.get(name, "string")).alias(name))
    return df.select(*out)


def all_places(*sources: DataFrame) -> DataFrame:
    """The places of all sources, one below the other."""
    return reduce(DataFrame.unionByName, sources)
