"""Spatial joins as equi joins on grid cells. No operator compares all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.functions.geo import distance, segment_projection
from wayspan.operators.graph import checkpointed
from wayspan.operators.sizes import small


def with_cell(df: DataFrame, x: str, y: str, size: float, names: tuple[str, str] = ("_cx", "_cy")) -> DataFrame:
    return df.withColumns({names[0]: F.floor(F.col(x) / size).cast("long"), names[1]: F.floor(F.col(y) / size).cast("long")})


def with_neighbour_cells(df: DataFrame, x: str, y: str, size: float, ring: int = 1) -> DataFrame:
    """Every row once for its own cell and each cell within `ring`."""
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    own = with_cell(df, x, y, size, ("_ox", "_oy"))
    spread = own.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return spread.withColumns({"_cx": F.col("_ox") + F.col("_dx"), "_cy": F.col("_oy") + F.col("_dy")}).drop("_ox", "_oy", "_dx", "_dy")


def pairs_within(df: DataFrame, key: str, x: str, y: str, limit: float, different: str | None = None) -> DataFrame:
    """(a, b, metres) with a < b and distance at most limit, of different sources if named."""
    columns = [key, x, y, *([different] if different else [])]
    left = with_neighbour_cells(df.select(*[F.col(c).alias(f"l_{c}") for c in columns]), f"l_{x}", f"l_{y}", limit)
    right = with_cell(df.select(*[F.col(c).alias(f"r_{c}") for c in columns]), f"r_{x}", f"r_{y}", limit)
    met = left.hint("merge").join(right, ["_cx", "_cy"]).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    if different:
        met = met.where(F.col(f"l_{different}") != F.col(f"r_{different}"))
    gap = distance(F.col(f"l_{x}"), F.col(f"l_{y}"), F.col(f"r_{x}"), F.col(f"r_{y}"))
    return met.withColumn("metres", gap).where(F.col("metres") <= limit).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), "metres")


def same_key_pairs(df: DataFrame, key: str, group: str, x: str, y: str, limit: float) -> DataFrame:
    """Pairs of one group within a distance: cells and the group together are the join key."""
    left = with_neighbour_cells(df.select(F.col(key).alias("a"), F.col(group).alias("_g"), F.col(x).alias("ax"), F.col(y).alias("ay")), "ax", "ay", limit)
    right = with_cell(df.select(F.col(key).alias("b"), F.col(group).alias("_g"), F.col(x).alias("bx"), F.col(y).alias("by")), "bx", "by", limit)
    met = left.hint("merge").join(right, ["_g", "_cx", "_cy"]).where("a < b").withColumn("metres", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return met.where(F.col("metres") <= limit).select("a", "b", F.col("_g").alias(group), "metres")


# Places that the average place may have in its cell at the start of a search, how often a cell is halved
# for that at most, and rows of a block.
SPARSE, HALVINGS, BLOCK = 8, 10, 2000


def _sparse_size(places: DataFrame, x: str, y: str, size: float) -> float:
    """`size`, or less: halved until the average row shares its cell with SPARSE rows at most, HALVINGS times at most.
    places holds no place twice; one row a step reaches the driver."""
    least = size / 2**HALVINGS
    while True:
        held = with_cell(places, x, y, size).groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("n"))
        mean = held.agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()[0]
        if mean is None or mean <= SPARSE or size <= least:
            return size
        size = max(least, size / 2 ** max(1, math.ceil(math.log(mean / SPARSE, 4))))


def nearest_node(points: DataFrame, nodes: DataFrame, point: str, node: str, x: str, y: str, size: float) -> DataFrame:
    """(point, node, metres): the nearest node of each point, the smaller id on ties.

    A found node is final once its distance is at most the searched ring's inner reach; other points go on, written
    first, with cells twice as large, until each point is final or a ring has covered all nodes. Of nodes at one place
    only the smallest counts, and cells start smaller than `size` where the nodes lie dense, so a point meets some
    nodes, however many there are.
    """
    waiting, done = points.select(F.col(point), F.col(x).alias("px"), F.col(y).alias("py")), None
    own = checkpointed(nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("nx"), F.col(y).alias("ny")).agg(F.min(node).alias(node)))
    box = own.agg(F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny")).first()
    if box[0] is None:
        return waiting.limit(0).join(own.select(node).limit(0), F.lit(True)).select(point, node, F.lit(0.0).alias("metres"))
    far = F.greatest(F.abs(F.col("px") - box[0]), F.abs(F.col("px") - box[1]), F.abs(F.col("py") - box[2]), F.abs(F.col("py") - box[3]))
    waiting = checkpointed(waiting.where("px is not null and py is not null"))
    size = _sparse_size(own, "nx", "ny", size)
    while True:
        near = with_neighbour_cells(waiting, "px", "py", size).join(with_cell(own, "nx", "ny", size).hint("merge"), ["_cx", "_cy"])
        gap = distance(F.col("px"), F.col("py"), F.col("nx"), F.col("ny"))
        best = near.groupBy(point, "px", "py").agg(F.min(F.struct(gap.alias("metres"), F.col(node).alias("node"))).alias("m"))
        found = checkpointed(best.where((F.col("m.metres") <= size) | (far <= size)).select(point, F.col("m.node").alias(node), F.col("m.metres").alias("metres")))
        done = found if done is None else done.unionByName(found)
        waiting, size = checkpointed(waiting.join(found.select(point).hint("merge"), point, "left_anti")), size * 2
        if waiting.isEmpty():
            return done


def _segment_cells(segments: DataFrame, size: float, reach: float) -> DataFrame:
    """Every segment (ax, ay, bx, by) once for each cell of its box widened by reach."""
    low = lambda a, b: F.floor((F.least(a, b) - reach) / size).cast("long")
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / size).cast("long")
    spread = segments.withColumn("_cx", F.explode(F.sequence(low(F.col("ax"), F.col("bx")), high(F.col("ax"), F.col("bx")))))
    return spread.withColumn("_cy", F.explode(F.sequence(low(F.col("ay"), F.col("by")), high(F.col("ay"), F.col("by")))))


def snap_to_segments(points: DataFrame, segments: DataFrame, point: str, segment: str, reach: float, size: float | None = None) -> DataFrame:
    """(point, segment, share, sx, sy, metres): the nearest segment within reach of each point (x, y) and the
    place on it; ties go to the smaller segment id. segments: segment, ax, ay, bx, by."""
    size = size or reach
    met = with_cell(points.select(point, "x", "y"), "x", "y", size).join(_segment_cells(segments, size, reach).hint("merge"), ["_cx", "_cy"])
    share, sx, sy = segment_projection(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = met.withColumns({"share": share, "sx": sx, "sy": sy}).withColumn("metres", distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).where(F.col("metres") <= reach)
    best = met.groupBy(point).agg(F.min(F.struct("metres", segment, "share", "sx", "sy")).alias("m"))
    return best.select(point, f"m.{segment}", "m.share", "m.sx", "m.sy", "m.metres")


def split_segments(segments: DataFrame, cuts: DataFrame, segment: str) -> DataFrame:
    """Pieces (segment, piece, from_share, to_share) between the ends and the cut shares of each segment."""
    ends = segments.select(segment, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("share"))
    every = ends.union(cuts.select(segment, "share").join(segments.select(segment).hint("merge"), segment, "left_semi")).distinct()
    order = F.expr(f"lead(share) over (partition by {segment} order by share)")
    rows = every.withColumn("to_share", order).where("to_share is not null")
    return rows.select(segment, F.expr(f"row_number() over (partition by {segment} order by share) - 1").alias("piece"), F.col("share").alias("from_share"), "to_share")


def rim_cells(edges: DataFrame, polygon: str, size: float) -> DataFrame:
    """(polygon, _cx, _cy, crossings): the cells that a polygon's edges pass, row by row of cells, so a slanting edge
    has cells by its length. crossings counts the edges that cross the middle line of the row in the cell."""
    rows = edges.where("ax is not null").withColumn("_cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size).cast("long"), F.floor(F.greatest("ay", "by") / size).cast("long"))))
    rise, run = F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)), F.col("bx") - F.col("ax")
    at = lambda y: F.coalesce(F.col("ax") + (F.least(F.greatest(y, F.least("ay", "by")), F.greatest("ay", "by")) - F.col("ay")) / rise * run, F.col("ax"))
    low, high, middle = at(F.col("_cy") * size), at((F.col("_cy") + 1) * size), (F.col("_cy") + 0.5) * size
    ends = lambda f: F.when(rise.isNull(), f("ax", "bx")).otherwise(f(low, high))
    cell = lambda x: F.floor(x / size).cast("long")
    slack = size * 1e-9  # rounding of the places above never leaves a touched cell out
    rows = rows.withColumns({"_x0": cell(ends(F.least) - slack), "_x1": cell(ends(F.greatest) + slack)})
    passed = rows.select(polygon, F.explode(F.sequence("_x0", "_x1")).alias("_cx"), "_cy", F.lit(0).alias("n"))
    crossed = rows.where((F.col("ay") > middle) != (F.col("by") > middle)).select(polygon, cell(at(middle)).alias("_cx"), "_cy", F.lit(1).alias("n"))
    return passed.unionByName(crossed).groupBy(polygon, "_cx", "_cy").agg(F.sum("n").alias("crossings"))


def inner_runs(rim: DataFrame, polygon: str) -> DataFrame:
    """(polygon, _cy, level, block): the cells inside a polygon that no edge passes, as blocks of 2^level cells of a row.

    Between two neighbouring rim cells of a row all cells lie on one side, inside if the middle line has crossed an odd
    number of edges so far. A run of them is cut into aligned blocks, two a level at most, so a polygon has blocks by
    its edge (times a logarithm), not by its area."""
    row = Window.partitionBy(polygon, "_cy").orderBy("_cx")
    gaps = rim.withColumns({"a": F.col("_cx") + 1, "b": F.lead("_cx").over(row), "odd": F.sum("crossings").over(row) % 2 == 1}).where("odd and b > a")
    level = gaps.select(polygon, "_cy", "a", "b", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("b") - F.col("a"))).cast("int") + 1)).alias("level"))
    first, end = F.expr("-shiftright(-a, level)"), F.expr("shiftright(b, level)")
    starts = F.when(first % 2 != 0, first)
    stops = F.when(end % 2 != 0, end - 1)
    blocks = level.where(first < end).withColumn("block", F.explode(F.array_compact(F.array(starts, stops))))
    return blocks.select(polygon, "_cy", "level", "block")


def points_in_polygons(points: DataFrame, edges: DataFrame, point: str, polygon: str, size: float) -> DataFrame:
    """(point, polygon) for every polygon that covers a point, boundary included. Points have x, y, edges polygon, ax, ay, bx, by.

    Cells that no edge passes are decided by the crossings of their row and joined in blocks (inner_runs); only points
    of cells that an edge passes meet edges, and then those of their row of cells, as the ray to the right does. The
    cover grows with the polygons' edges, not with their areas.
    """
    low = lambda a, b: F.floor(F.least(a, b) / size).cast("long")
    high = lambda a, b: F.floor(F.greatest(a, b) / size).cast("long")
    rows = edges.where("ax is not null").withColumn("_cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))
    rim = checkpointed(rim_cells(edges, polygon, size))
    blocks = checkpointed(inner_runs(rim, polygon))
    placed = with_cell(points.select(point, "x", "y"), "x", "y", size)
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())  # at most the bits of a cell number
    held = placed.select("_cx", "_cy").where("_cx is not null and _cy is not null").distinct()
    spread = held.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("block", F.expr("shiftright(_cx, level)")) if levels else held.withColumns({"level": F.lit(0), "block": F.col("_cx")}).limit(0)
    inner = spread.join(blocks.hint("merge"), ["_cy", "level", "block"]).select(polygon, "_cx", "_cy")
    sure = placed.join(inner.hint("merge"), ["_cx", "_cy"]).select(point, polygon)

    tested = placed.join(rim.select(polygon, "_cx", "_cy").hint("merge"), ["_cx", "_cy"]).withColumnsRenamed({"x": "_x", "y": "_y"})
    met = tested.join(rows.hint("merge"), [polygon, "_cy"])
    at = F.col("ax") + (F.col("_y") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) * (F.col("bx") - F.col("ax"))
    crosses = ((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y"))) & (F.col("_x") < at)
    side = (F.col("bx") - F.col("ax")) * (F.col("_y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("_x") - F.col("ax"))
    on = (side == 0) & F.col("_x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & F.col("_y").between(F.least("ay", "by"), F.greatest("ay", "by"))
    told = met.groupBy(point, polygon).agg(F.count_if(F.coalesce(crosses, F.lit(False))).alias("c"), F.bool_or(on).alias("on"))
    return sure.unionByName(told.where("on or c % 2 = 1").select(point, polygon))


def ray_obstruction(points: DataFrame, heights: DataFrame, resolution: float, reach: float, horizon: float = 0.5) -> DataFrame:
    """(point_id, row, col, distance, apparent) of the cell that blocks the sun: along the ray towards it, a step of the
    resolution at a time and up to the reach, the cell that looks highest above the sun, the nearest on ties; nulls when
    the point is lit or the sun stands at the horizon or below. apparent is the cell's altitude in degrees.

    points: point_id, row, col, height, altitude and azimuth (degrees, north is 0 and up) of each point's sun; heights:
    row, col, height.
    """
    sun = points.where((F.col("altitude") > horizon) & F.col("height").isNotNull()).select("point_id", "row", "col", "height", F.tan(F.radians("altitude")).alias("_sun"), F.sin(F.radians("azimuth")).alias("_dx"), (-F.cos(F.radians("azimuth"))).alias("_dy"))
    walk = sun.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(reach / resolution)))))
    walk = walk.withColumns({"r": F.col("row") + F.bround(F.col("step") * F.col("_dy"), 0).cast("long"), "c": F.col("col") + F.bround(F.col("step") * F.col("_dx"), 0).cast("long")})
    other = heights.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), F.col("height").alias("h"))
    met = walk.hint("merge").join(other, ["r", "c"]).withColumn("slope", (F.col("h") - F.col("height")) / (F.col("step") * F.lit(float(resolution)))).where("slope > _sun")
    best = met.groupBy("point_id").agg(F.max_by(F.struct("r", "c", "step", "slope"), F.struct("slope", -F.col("step"))).alias("b"))
    told = points.select("point_id").join(best.hint("merge"), "point_id", "left")
    return told.select("point_id", F.col("b.r").alias("row"), F.col("b.c").alias("col"), (F.col("b.step") * F.lit(float(resolution))).alias("distance"), F.degrees(F.atan("b.slope")).alias("apparent"))


def line_segments(lines: DataFrame, line: str, coords: str) -> DataFrame:
    """(line, piece, ax, ay, bx, by): the segments between consecutive vertices (structs of two numbers) of each line.
    No shuffle: a line's vertices are in its row."""
    names = [f.name for f in lines.schema[coords].dataType.elementType.fields]
    point = lambda i, p: [F.get(coords, i)[n].alias(f"{p}{k}") for n, k in zip(names, "xy", strict=False)]
    piece = lambda i: F.struct(i.alias("piece"), *point(i, "a"), *point(i + 1, "b"))
    pieces = F.when(F.size(coords) >= 2, F.transform(F.sequence(F.lit(0), F.size(coords) - 2), piece))
    return lines.select(line, F.explode(pieces).alias("s")).select(line, "s.*")


def overlapping_boxes(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: float) -> DataFrame:
    """(left, right) whose boxes (x0, y0, x1, y1) touch; each pair once, from the cell of their common corner."""

    def spread(df: DataFrame, key: str, p: str) -> DataFrame:
        named = df.select(F.col(key).alias(f"{p}k"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))
        return named.withColumn("_cx", cells(f"{p}x0", f"{p}x1")).withColumn("_cy", cells(f"{p}y0", f"{p}y1"))

    met = spread(left, left_key, "l_").hint("merge").join(spread(right, right_key, "r_"), ["_cx", "_cy"])
    touch = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    corner = (F.floor(F.greatest("l_x0", "r_x0") / size) == F.col("_cx")) & (F.floor(F.greatest("l_y0", "r_y0") / size) == F.col("_cy"))
    return met.where(touch & corner).select(F.col("l_k").alias(left_key), F.col("r_k").alias(right_key))


def segment_crossings(segments: DataFrame, segment: str, feature: str, size: float, clear: float = 0.0, shares: bool = False) -> DataFrame:
    """(a, b, x, y): proper crossings of segments of different features; shared end points are none, nor are places
    within `clear` of an end. Segments are unique. shares: also share_a and share_b, where the place lies on each.

    Segments whose boxes touch meet once, in the cell of their common corner. Cells of more than BLOCK segments are
    dealt into blocks and each pair of blocks is a key of its own, so no key holds more than some BLOCK rows a side,
    however dense the segments lie. The crossings of a dense place still grow with the square of its segments.
    """
    columns = (segment, feature, "ax", "ay", "bx", "by")
    boxed = segments.select(*columns, *[f(f"a{c}", f"b{c}").alias(f"{n}{c}") for n, f in (("low", F.least), ("high", F.greatest)) for c in "xy"])
    boxed = boxed.withColumns({f"at{c}": F.floor(F.col(f"low{c}") / size).cast("long") for c in "xy"})
    cells = checkpointed(_segment_cells(boxed, size, 0.0))
    dense = cells.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n")).where("_n > 1")
    dealt = cells.join(small(checkpointed(dense)), ["_cx", "_cy"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(segment), F.col("_n")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    left, right = (dealt.select("_cx", "_cy", F.col(one).alias("_i"), F.col(two).alias("_j"), *[F.col(c).alias(f"{p}_{c}") for c in boxed.columns]) for p, one, two in (("l", "_own", "_other"), ("r", "_other", "_own")))
    touch = [(F.col(f"l_low{c}") <= F.col(f"r_high{c}")) & (F.col(f"r_low{c}") <= F.col(f"l_high{c}")) & (F.greatest(f"l_at{c}", f"r_at{c}") == F.col(f"_c{c}")) for c in "xy"]
    side = lambda p, q, x: (F.col(f"{p}_bx") - F.col(f"{p}_ax")) * (F.col(f"{q}_{x}y") - F.col(f"{p}_ay")) - (F.col(f"{p}_by") - F.col(f"{p}_ay")) * (F.col(f"{q}_{x}x") - F.col(f"{p}_ax"))
    apart = (side("l", "r", "a") * side("l", "r", "b") < 0) & (side("r", "l", "a") * side("r", "l", "b") < 0)
    met = left.hint("merge").join(right, ["_cx", "_cy", "_i", "_j"]).where(touch[0] & touch[1] & apart & (F.col(f"l_{segment}") < F.col(f"r_{segment}")) & (F.col(f"l_{feature}") != F.col(f"r_{feature}")))
    t = side("r", "l", "a") / (side("r", "l", "a") - side("r", "l", "b"))
    x, y = (F.col(f"l_a{c}") + t * (F.col(f"l_b{c}") - F.col(f"l_a{c}")) for c in "xy")
    # an inner row, so that conditions on the place stay out of the join: with them, the code that tests a pair gets too long to be compiled
    crossing = met.select("*", F.inline(F.array(F.struct(x.alias("_x"), y.alias("_y")))))
    if clear:
        crossing = crossing.where(F.least(*[distance(F.col("_x"), F.col("_y"), F.col(f"{p}_{e}x"), F.col(f"{p}_{e}y")) for p in "lr" for e in "ab"]) > clear)
    run = lambda p, c: F.col(f"{p}_b{c}") - F.col(f"{p}_a{c}")
    share = lambda p: ((F.col("_x") - F.col(f"{p}_ax")) * run(p, "x") + (F.col("_y") - F.col(f"{p}_ay")) * run(p, "y")) / (run(p, "x") * run(p, "x") + run(p, "y") * run(p, "y"))
    also = [share("l").alias("share_a"), share("r").alias("share_b")] if shares else []
    return crossing.select(F.col(f"l_{segment}").alias("a"), F.col(f"r_{segment}").alias("b"), F.col("_x").alias("x"), F.col("_y").alias("y"), *also)


def vertices_on_segments(vertices: DataFrame, segments: DataFrame, vertex: str, segment: str, tolerance: float, size: float) -> DataFrame:
    """(vertex, segment, share): vertices on the inside of a segment, off by the tolerance at most."""
    met = with_cell(vertices.select(vertex, "x", "y"), "x", "y", size).join(_segment_cells(segments, size, tolerance).hint("merge"), ["_cx", "_cy"])
    share, sx, sy = segment_projection(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    told = met.withColumn("share", share).where((F.col("share") > 0) & (F.col("share") < 1) & (distance(F.col("x"), F.col("y"), sx, sy) <= tolerance))
    ends = F.least(distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay")), distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")))
    return told.where(ends > tolerance).select(vertex, segment, "share")
