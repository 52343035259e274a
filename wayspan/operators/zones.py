"""Zones and pixels: labels by polygon or street band, samples at points, street statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.functions import bits as b
from wayspan.functions import geo
from wayspan.functions.text import composed, slug, text_key
from wayspan.operators.pixels import own_columns, own_rows, with_halo
from wayspan.operators.spatial import _segment_cells, nearest_node, overlapping_boxes, points_in_polygons, with_cell


def with_centres(pixels: DataFrame, x0: float, y0: float, resolution: float) -> DataFrame:
    """pixels (row, col) with the x and y of their centres in a grid that runs down from (x0, y0)."""
    return pixels.withColumns({"x": F.lit(x0) + (F.col("col") + 0.5) * resolution, "y": F.lit(y0) - (F.col("row") + 0.5) * resolution})


def label_pixels(pixels: DataFrame, edges: DataFrame, zone: str, size: float, x0: float, y0: float, resolution: float) -> DataFrame:
    """(row, col, zone) of the pixels whose centre a zone covers; where zones overlap the largest one wins. edges:
    zone, ax, ay, bx, by of the zones' rings."""
    own = with_centres(pixels.select("row", "col"), x0, y0, resolution).select(F.struct("row", "col").alias("pixel"), "x", "y")
    met = points_in_polygons(own, edges, "pixel", zone, size)
    return met.groupBy("pixel").agg(F.max(zone).alias(zone)).select("pixel.row", "pixel.col", zone)


def band_labels(pixels: DataFrame, segments: DataFrame, zone: str, inner: float, outer: float, x0: float, y0: float, resolution: float) -> DataFrame:
    """(row, col, zone) of the pixels whose distance to the zone's nearest segment is over `inner` (from 0 on if it
    is 0) and at most `outer`; the largest zone wins. Pixels meet the segments of their cell only."""
    if not 0 <= inner < outer:
        raise ValueError("a band needs 0 <= inner < outer")
    own = with_cell(with_centres(pixels.select("row", "col"), x0, y0, resolution), "x", "y", outer)
    met = own.join(_segment_cells(segments, outer, outer).hint("merge"), ["_cx", "_cy"])
    _, sx, sy = geo.segment_projection(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = met.withColumn("_d", geo.distance(F.col("x"), F.col("y"), sx, sy)).groupBy("row", "col", zone).agg(F.min("_d").alias("_d"))
    inside = (F.col("_d") <= outer) & ((F.col("_d") > inner) if inner > 0 else F.lit(True))
    return near.where(inside).groupBy("row", "col").agg(F.max(zone).alias(zone))


def under_any(points: DataFrame, edges: DataFrame, point: str, polygon: str, size: float, name: str = "under") -> DataFrame:
    """points with a flag: whether any polygon covers them."""
    met = points_in_polygons(points, edges, point, polygon, size).select(point).distinct().withColumn(name, F.lit(True))
    return points.join(met.hint("merge"), point, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def touching_segments(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: float) -> DataFrame:
    """(left, right) of segments (ax, ay, bx, by) that share a point, end points included."""
    columns = ("ax", "ay", "bx", "by")
    a = _segment_cells(left.select(F.col(left_key).alias("l_k"), *columns), size, 0.0).select("_cx", "_cy", "l_k", *[F.col(c).alias(f"l_{c}") for c in columns])
    z = _segment_cells(right.select(F.col(right_key).alias("r_k"), *columns), size, 0.0).select("_cx", "_cy", "r_k", *[F.col(c).alias(f"r_{c}") for c in columns])
    c = F.col
    turn = lambda p, q, e: (c(f"{p}_bx") - c(f"{p}_ax")) * (c(f"{q}_{e}y") - c(f"{p}_ay")) - (c(f"{p}_by") - c(f"{p}_ay")) * (c(f"{q}_{e}x") - c(f"{p}_ax"))
    apart = lambda k: (F.greatest(f"l_a{k}", f"l_b{k}") < F.least(f"r_a{k}", f"r_b{k}")) | (F.greatest(f"r_a{k}", f"r_b{k}") < F.least(f"l_a{k}", f"l_b{k}"))
    meets = (turn("l", "r", "a") * turn("l", "r", "b") <= 0) & (turn("r", "l", "a") * turn("r", "l", "b") <= 0) & ~apart("x") & ~apart("y")
    return a.hint("merge").join(z, ["_cx", "_cy"]).where(meets).select(c("l_k").alias(left_key), c("r_k").alias(right_key)).distinct()


def lines_touching(segments: DataFrame, edges: DataFrame, line: str, polygon: str, names: list[str], size: float) -> DataFrame:
    """(line): the lines that touch any of the named polygons: an end lies inside or a segment meets a ring. A name
    without a polygon is an error that lists it."""
    known = {r[0] for r in edges.where(F.col(polygon).isin(*names)).select(polygon).distinct().collect()}  # the names asked for
    if missing := sorted(set(names) - known):
        raise ValueError(f"no polygon is named {missing}")
    rings = edges.where(F.col(polygon).isin(*names))
    ends = segments.select(F.monotonically_increasing_id().alias("_p"), line, F.col("ax").alias("x"), F.col("ay").alias("y")).select(F.struct(line, "x", "y").alias("_p"), "x", "y").distinct()
    inside = points_in_polygons(ends, rings, "_p", polygon, size).select(F.col(f"_p.{line}").alias(line))
    return inside.union(touching_segments(segments, rings, line, polygon, size).select(line)).distinct()


def sampled_points(points: DataFrame, pixels: DataFrame, x0: float, y0: float, resolution: float, values: list[str]) -> DataFrame:
    """points (x, y) with row, col and the pixel's values; null where there is no pixel."""
    row, col = geo.cell(F.col("x"), F.col("y"), x0, y0, resolution)
    told = points.withColumns({"row": row.cast("long"), "col": col.cast("long")})
    return told.join(pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *values).hint("merge"), ["row", "col"], "left")


def labelled_surfaces(labels: DataFrame, classes: DataFrame, measured: DataFrame, corrected: DataFrame) -> DataFrame:
    """(row, col, zone, class, measured, corrected) of labelled ground pixels: labels (row, col, zone), classes (row,
    col, class) and two tables of masks (row, col, bits), joined on the cell. Under canopy the corrected mask has
    all frames."""
    mask = lambda df, name: df.select("row", "col", F.col("bits").alias(name)).hint("merge")
    met = labels.join(classes.where("class >= 2").hint("merge"), ["row", "col"]).join(mask(measured, "measured"), ["row", "col"]).join(mask(corrected, "corrected"), ["row", "col"])
    return met.withColumn("corrected", b.with_canopy(F.col("corrected"), F.lit(True), F.col("class") == 3))


def merged_lines(parts: DataFrame, by: list[str], length: str, least: float = 0.0) -> DataFrame:
    """(by, length, parts): the parts of one key together, those that are long enough. The parts keep the key, so
    their geometry stays where it is."""
    return parts.groupBy(*by).agg(F.sum(length).alias(length), F.count(F.lit(1)).alias("parts")).where(F.col(length) >= least)


def named_streets(ways: DataFrame, name: str, length: str, least: float = 100.0) -> DataFrame:
    """(key, street_id, name, length, parts) of ways with one name (spaces, case and compatibility forms apart): the
    most frequent spelling names the street, its slug is the id; of all streets with one slug all but the first key get
    a suffix. Streets that are too short are left out after that, so an id doesn't hang on a length."""
    counts = ways.withColumn("key", text_key(F.col(name))).where("key <> ''").groupBy("key", composed(F.col(name)).alias("name")).agg(F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_l"))
    whole = counts.withColumn("_f", text_key(F.col("name"))).groupBy("key").agg(F.min_by("name", F.struct(-F.col("_n"), F.col("_f"), F.col("name"))).alias("name"), F.sum("_l").alias(length), F.sum("_n").alias("parts"))
    return unique_slugs(whole, "key", "name", "street_id").where(F.col(length) >= least)


def unique_slugs(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """df with a slug of the name; where keys share one, all but the smallest key get a hash of theirs behind it."""
    first = F.row_number().over(Window.partitionBy("_s").orderBy(key)) == 1
    told = df.withColumn("_s", slug(F.col(name)))
    return told.withColumn(out, F.when(first, F.col("_s")).otherwise(F.concat("_s", F.lit("-"), F.substring(F.sha1(F.col(key).cast("binary")), 1, 8)))).drop("_s")


def stop_statistics(stops: DataFrame, hours: str, ground: str) -> DataFrame:
    """One row: measured stops (on sampled ground), excluded ones, all, the mean of shaded hours, and those with no
    usable shade (one frame, which counts everything as shaded). Unmeasured stops are on neither side."""
    on = F.coalesce(F.col(ground), F.lit(False))
    return stops.agg(
        F.count_if(on).alias("measured"), F.count_if(~on).alias("excluded"), F.count(F.lit(1)).alias("published"),
        F.avg(F.when(on, F.col(hours))).alias("mean_hours"), F.count_if(on & (F.col(hours) == 1)).alias("no_usable_shade"),
    )


def bare_on_every_surface(samples: DataFrame, stop: str, surface: str, hours: str, surfaces: list[str]) -> DataFrame:
    """(stop): stops with exactly one shaded hour on every one of the surfaces. No surface at all is an error."""
    if not surfaces:
        raise ValueError("no surfaces given")
    told = samples.where(F.col(surface).isin(*surfaces)).groupBy(stop).agg(F.bool_and(F.col(hours) == 1).alias("_b"), F.countDistinct(surface).alias("_n"))
    return told.where(F.coalesce(F.col("_b"), F.lit(False)) & (F.col("_n") == len(surfaces))).select(stop)


def bare_stop_records(bare: DataFrame, stops: DataFrame, stop: str, name: str, lon: str, lat: str) -> DataFrame:
    """(id, name, lon, lat) of the bare stops, by name, then id."""
    told = stops.join(bare.hint("merge"), stop, "left_semi")
    return told.select(F.col(stop).cast("string").alias("id"), F.col(name).cast("string").alias("name"), F.bround(lon, 6).alias("lon"), F.bround(lat, 6).alias("lat")).orderBy("name", "id")


def best_block(swings: DataFrame, streets: DataFrame, block: str, least_ground: float, least_metres: float) -> DataFrame:
    """The block with the largest swing among those with enough ground (a share) and metres of named street: block,
    swing, metres, names (sorted). swings: block, swing, ground_share; streets: block, name, metres. Ties go to the
    smaller block."""
    named = streets.where(F.coalesce(F.trim("name"), F.lit("")) != "").groupBy(block).agg(F.sum("metres").alias("metres"), F.sort_array(F.collect_set("name")).alias("names"))
    told = swings.where(F.col("swing").isNotNull() & (F.col("ground_share") >= least_ground)).join(named.hint("merge"), block).where(F.col("metres") >= least_metres)
    return told.orderBy(F.col("swing").desc(), block).limit(1).select(block, "swing", "metres", "names")


def corrected_heights(pixels: DataFrame, radius: int = 25, bare: float = 3.0, default: float = 8.0, side: int | None = None) -> DataFrame:
    """(row, col, height, corrected, source) of a complete grid (row, col, height, canopy): canopy pixels under the bare
    height are raised to the mean of the crowns in the square around them, or to the default where it holds none.
    source says measured, default or kept.

    Sums slide along rows, then along columns, inside blocks that hold their surroundings: one shuffle. Beyond the grid
    the edge cell goes on, as often as the square hangs over; a block's own pixels reach its edge only where the grid
    ends. Null rows or columns are left out.
    """
    crown = F.coalesce(F.col("canopy"), F.lit(False)) & (F.col("height") >= bare)
    own = pixels.where("row is not null and col is not null").select("row", "col", "height", F.coalesce("canopy", F.lit(False)).alias("canopy"), F.when(crown, F.col("height")).otherwise(0.0).cast("double").alias("s"), F.when(crown, 1.0).otherwise(0.0).alias("n"))

    def slid(df: DataFrame, line: str, at: str) -> DataFrame:
        lines = Window.partitionBy("_by", "_bx", line).orderBy(at)
        near, whole = lines.rangeBetween(-radius, radius), lines.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        over = lambda c: F.greatest(F.lit(0), F.lit(radius) - c)
        ends = df.withColumns({"_low": F.first(at).over(whole), "_high": F.last(at).over(whole)} | {f"_{c}a": F.first(c).over(whole) for c in ("s", "n")} | {f"_{c}z": F.last(c).over(whole) for c in ("s", "n")} | {f"_{c}": F.sum(c).over(near) for c in ("s", "n")})
        sums = {c: F.col(f"_{c}") + over(F.col(at) - F.col("_low")) * F.col(f"_{c}a") + over(F.col("_high") - F.col(at)) * F.col(f"_{c}z") for c in ("s", "n")}
        return ends.select("_by", "_bx", "_side", "row", "col", "height", "canopy", *[v.alias(c) for c, v in sums.items()])

    local = slid(slid(with_halo(own, radius, side), "row", "col").where(own_columns()), "col", "row").where(own_rows())
    low = F.col("canopy") & (F.col("height") < bare)
    seen = (F.col("n") > 0.5) & (F.col("s") > 0)
    source = F.when(low & seen, "measured").when(low, "default").otherwise("kept")
    return local.select("row", "col", "height", F.when(low, F.when(seen, F.col("s") / F.col("n")).otherwise(default)).otherwise(F.col("height")).alias("corrected"), source.alias("source"))


def mosaic(tiles: DataFrame, pixels: DataFrame, tile: str, size: float, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(row, col, value) of all tiles' pixels as one grid, within bounds (first row, last row, first column, last
    column) if given. tiles: tile, x0, y0, x1, y1; pixels: tile, row, col, value. Two tiles that cover the same
    ground are an error that names them, as one of them would have to win."""
    own = tiles.select(tile, "x0", "y0", "x1", "y1")
    other = own.select(F.col(tile).alias("_other"), "x0", "y0", "x1", "y1")
    met = overlapping_boxes(own, other, tile, "_other", size).where(F.col(tile) < F.col("_other"))
    both = met.join(own.hint("merge"), tile).join(other.select("_other", *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")]).hint("merge"), "_other")
    clash = both.where("x0 < ox1 and ox0 < x1 and y0 < oy1 and oy0 < y1").select(tile, "_other").limit(1).collect()
    if clash:
        raise ValueError(f"tiles overlap: {clash[0][0]} and {clash[0][1]}")
    told = pixels.join(own.select(tile).hint("merge"), tile, "left_semi").select("row", "col", "value")
    return told if bounds is None else told.where(F.col("row").between(bounds[0], bounds[1]) & F.col("col").between(bounds[2], bounds[3]))


def tiles_for_boundary(tiles: DataFrame, edges: DataFrame, tile: str, polygon: str, size: float) -> DataFrame:
    """The tiles (x0, y0, x1, y1) that share ground with the boundary's polygons: a corner lies inside, or a side
    meets a ring, or the tile holds the ring."""
    c = F.col
    sides = tiles.select(tile, F.explode(F.array(*[F.struct(F.col(p).alias("ax"), F.col(q).alias("ay"), F.col(r).alias("bx"), F.col(s).alias("by")) for p, q, r, s in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))])).alias("s")).select(tile, "s.*")
    corners = tiles.select(F.struct(tile, "x0", "y0").alias("_p"), c("x0").alias("x"), c("y0").alias("y"))
    inside = points_in_polygons(corners, edges, "_p", polygon, size).select(c(f"_p.{tile}").alias(tile))
    crossed = touching_segments(sides, edges, tile, polygon, size).select(tile)
    rings = edges.select(polygon, c("ax").alias("x0"), c("ay").alias("y0"), c("ax").alias("x1"), c("ay").alias("y1"))
    holding = overlapping_boxes(tiles.select(tile, "x0", "y0", "x1", "y1"), rings.withColumn("_v", F.struct(polygon, "x0", "y0")), tile, "_v", size).select(tile)
    return tiles.join(inside.union(crossed).union(holding).distinct().hint("merge"), tile, "left_semi")


def packages(tiles: DataFrame, package: str) -> DataFrame:
    return tiles.groupBy(package).agg(F.count(F.lit(1)).alias("tiles"))


def sibling_name(name: Column, old: str = "_DSM", new: str = "_DTM") -> Column:
    """The name of a tile's sibling product; names without the old mark are an error."""
    return F.when(F.contains(name, F.lit(old)), F.replace(name, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit("not a tile name: "), name)).cast("string"))


def point_profiles(points: DataFrame, classes: DataFrame, measured: DataFrame, corrected: DataFrame, point: str, zoom: int, hours: int = b.HOURS) -> DataFrame:
    """(point, status, class, under_canopy, measured, corrected) for points (lon, lat): the pixel of the zoom level that
    a point falls on decides: missing (no pixel, or class 0), non-ground, or ground with an hourly profile of each
    surface; under canopy the corrected one is shaded throughout. Tables of pixels have tile_x, tile_y, pixel_x,
    pixel_y and class or bits."""
    at = ["tile_x", "tile_y", "pixel_x", "pixel_y"]
    own = points.select(point, *geo.tile_address(F.col("lon"), F.col("lat"), zoom))
    mask = lambda df, name: df.select(*at, F.col("bits").alias(name)).hint("merge")
    met = own.join(classes.select(*at, "class").hint("merge"), at, "left").join(mask(measured, "_m"), at, "left").join(mask(corrected, "_c"), at, "left")
    ground, under = F.coalesce(F.col("class") >= 2, F.lit(False)), F.coalesce(F.col("class") == 3, F.lit(False))
    status = F.when(F.coalesce(F.col("class"), F.lit(0)) == 0, "missing").when(F.col("class") == 1, "non-ground").when(F.col("class") <= 3, "ground").otherwise("error")
    fixed = b.with_canopy(F.col("_c"), ground, under, hours)
    return met.select(point, status.alias("status"), "class", under.alias("under_canopy"), F.when(ground, b.profile(F.col("_m"), hours)).alias("measured"), F.when(ground, b.profile(fixed, hours)).alias("corrected"))


def street_at(points: DataFrame, inventory: DataFrame, point: str, key: str, street: str, size: float) -> DataFrame:
    """(point, key, street, metres): the nearest inventory point and its street."""
    met = nearest_node(points, inventory.select(key, "x", "y"), point, key, "x", "y", size)
    return met.join(inventory.select(key, street).hint("merge"), key).select(point, key, street, "metres")
