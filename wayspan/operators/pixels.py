"""Grids of pixels: hourly shares, overviews, focal means and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.functions.bits import HOURS


def hour_shares(pixels: DataFrame, bits: str, ground: Column, hours: int = HOURS) -> DataFrame:
    """(hour, shaded, ground_pixels, share) over ground pixels, from one pass of conditional sums."""
    sums = [F.sum(F.getbit(F.col(bits), F.lit(h)).cast("long")).alias(f"h{h}") for h in range(hours)]
    once = pixels.where(ground).agg(F.count(F.lit(1)).alias("n"), *sums)
    stacked = ", ".join(f"{h}, h{h}" for h in range(hours))
    return once.selectExpr("n", f"stack({hours}, {stacked}) as (hour, shaded)").select("hour", "shaded", F.col("n").alias("ground_pixels"), (F.col("shaded") / F.nullif("n", F.lit(0))).alias("share"))


def zone_profiles(pixels: DataFrame, zone: str, surfaces: dict[str, str], ground: Column, hours: int = HOURS, digits: int = 4) -> DataFrame:
    """(zone, pixels, and for each surface an array of hourly shares) on ground pixels."""
    sums = [F.sum(F.getbit(F.col(b), F.lit(h)).cast("long")).alias(f"{s}_{h}") for s, b in surfaces.items() for h in range(hours)]
    out = pixels.where(ground).groupBy(zone).agg(F.count(F.lit(1)).alias("pixels"), *sums)
    return out.select(zone, "pixels", *[F.array(*[F.bround(F.col(f"{s}_{h}") / F.col("pixels"), digits) for h in range(hours)]).alias(s) for s in surfaces])


def swing(pixels: DataFrame, block: str, bits: str, early: int, late: int, ground: Column, least: int) -> DataFrame:
    """(block, ground_pixels, swing): shaded share late less early; null under a floor of ground pixels."""
    share = lambda h: F.sum(F.getbit(F.col(bits), F.lit(h)).cast("long"))
    out = pixels.where(ground).groupBy(block).agg(F.count(F.lit(1)).alias("ground_pixels"), (share(late) - share(early)).alias("_d"))
    return out.select(block, "ground_pixels", F.when(F.col("ground_pixels") >= least, F.col("_d") / F.col("ground_pixels")).alias("swing"))


def _children(df: DataFrame) -> tuple[Column, Column]:
    return F.floor(F.col("row") / 2).cast("long").alias("row"), F.floor(F.col("col") / 2).cast("long").alias("col")


def overview_mask(pixels: DataFrame, bits: str, ground: str, hours: int = HOURS) -> DataFrame:
    """Parents of 2 x 2 pixels (row, col, bits, ground): a bit is set if at least half of the ground children
    have it; the parent is ground with two ground children or more."""
    sums = [F.sum(F.when(F.col(ground), F.getbit(F.col(bits), F.lit(h)).cast("int")).otherwise(0)).alias(f"b{h}") for h in range(hours)]
    met = pixels.groupBy(*_children(pixels)).agg(F.count_if(F.col(ground)).alias("n"), *sums)
    half = F.greatest(F.floor((F.col("n") + 1) / 2), F.lit(1))
    packed = sum((F.when(F.col(f"b{h}") >= half, 1 << h).otherwise(0) for h in range(1, hours)), F.when(F.col("b0") >= half, 1).otherwise(0))
    return met.select("row", "col", F.when(F.col("n") >= 2, packed).otherwise(0).cast("int").alias("bits"), (F.col("n") >= 2).alias("ground"))


def overview_count(pixels: DataFrame, count: str) -> DataFrame:
    """Parent count: mean of the ground children (count > 0), halves to even; 0 with fewer than two of them."""
    value = F.when(F.col(count) > 0, F.col(count))
    met = pixels.groupBy(*_children(pixels)).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    return met.select("row", "col", F.when(F.col("n") >= 2, F.bround("m", 0).cast("int")).otherwise(0).alias("count"))


def overview_class(pixels: DataFrame, kind: str) -> DataFrame:
    """Parent class of 0 missing, 1 not ground, 2 ground, 3 canopy: two covered children cover it, two ground
    children (2 or 3) make it ground, and canopy wins ties."""
    of = lambda *k: F.count_if(F.col(kind).isin(*k))
    met = pixels.groupBy(*_children(pixels)).agg(of(1, 2, 3).alias("seen"), of(2, 3).alias("land"), of(3).alias("trees"))
    out = F.when(F.col("seen") < 2, 0).when(F.col("land") < 2, 1).when(F.col("trees") * 2 >= F.col("land"), 3).otherwise(2)
    return met.select("row", "col", out.alias("class"))


def class_pyramid(pixels: DataFrame, kind: str, levels: int) -> DataFrame:
    """(level, row, col, class) of the levels above the pixels; a fixed number of aggregations."""
    now, out = pixels.select("row", "col", F.col(kind).alias("class")), None
    for level in range(1, levels + 1):
        now = overview_class(now, "class")
        named = now.select(F.lit(level).alias("level"), "row", "col", "class")
        out = named if out is None else out.unionByName(named)
    return out


def native_overview(pixels: DataFrame, factor: int, count: str, bits: str, ground: str) -> DataFrame:
    """An overview straight from the pixels: ground if half of the cells are; the count is the mean over ground
    cells, 1 at least; the mask is that of the cell nearest to the centre (the lower row, then column, on ties)."""
    middle = (factor - 1) / 2
    gap = F.pow(F.pmod(F.col("row"), F.lit(factor)) - middle, 2) + F.pow(F.pmod(F.col("col"), F.lit(factor)) - middle, 2)
    met = pixels.groupBy(F.floor(F.col("row") / factor).cast("long").alias("row"), F.floor(F.col("col") / factor).cast("long").alias("col")).agg(
        (F.count_if(F.col(ground)) * 2 >= F.count(F.lit(1))).alias("ground"),
        F.avg(F.when(F.col(ground), F.col(count))).alias("_m"),
        F.min_by(bits, F.struct(gap, F.col("row"), F.col("col"))).alias("bits"),
    )
    return met.select("row", "col", "ground", F.when(F.col("ground"), F.greatest(F.lit(1), F.bround("_m", 0).cast("int"))).otherwise(0).alias("count"), "bits")


def with_halo(pixels: DataFrame, radius: int, side: int | None = None) -> DataFrame:
    """pixels (row, col) dealt by blocks (_by, _bx) of side x side cells, each with the pixels within radius around it:
    one shuffle, after which windows over a block's lines need none. Pixels near a border are in up to four blocks, so
    what moves grows by about 4 x radius / side; the side is eight radii (64 at least) unless given, radius at least."""
    side = max(64, 8 * radius) if side is None else side
    if side < max(1, radius):
        raise ValueError("a block must be as wide as the radius")
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side) for d in (-radius, 0, radius)]))
    spread = pixels.withColumn("_by", F.explode(near("row"))).withColumn("_bx", F.explode(near("col")))
    return spread.repartition("_by", "_bx").withColumn("_side", F.lit(side))


def own_columns() -> Column:
    """The pixel lies in the columns of its block and not in the halo beside them."""
    return F.floor(F.col("col") / F.col("_side")) == F.col("_bx")


def own_rows() -> Column:
    return F.floor(F.col("row") / F.col("_side")) == F.col("_by")


def focal_sums(pixels: DataFrame, value: str, radius: int, side: int | None = None) -> DataFrame:
    """(row, col, total, n): sums and counts of the non-null values in the square around each pixel of a complete grid
    (pixels without a value have a null), by sliding sums along rows, then columns, inside blocks that hold their
    surroundings: one shuffle. Null rows or columns are left out; of an absent pixel, its row's sum is absent too."""
    block = with_halo(pixels.where("row is not null and col is not null").select("row", "col", F.col(value).alias("_v")), radius, side)
    along = Window.partitionBy("_by", "_bx", "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("_by", "_bx", "col").orderBy("row").rangeBetween(-radius, radius)
    first = block.withColumns({"_s": F.sum("_v").over(along), "_n": F.count("_v").over(along)}).where(own_columns())
    return first.withColumns({"total": F.sum("_s").over(down), "n": F.sum("_n").over(down)}).where(own_rows()).select("row", "col", "total", "n")


def tiles_for_box(boxes: DataFrame, key: str, zooms: list[int], tile_x0: dict[int, Column], tile_x1: dict[int, Column], tile_y0: dict[int, Column], tile_y1: dict[int, Column]) -> DataFrame:
    """(key, zoom, tiles): how many tiles each box touches."""
    counts = F.array(*[F.struct(F.lit(z).alias("zoom"), ((F.floor(tile_x1[z]) - F.floor(tile_x0[z]) + 1) * (F.floor(tile_y1[z]) - F.floor(tile_y0[z]) + 1)).alias("tiles")) for z in zooms])
    return boxes.select(key, F.explode(counts).alias("t")).select(key, "t.*")


def gaussian_kernel(radius: int, sigma: float, least: float = 0.02) -> dict[tuple[int, int], float]:
    """Weights of the cells around a point, 1 at its own; those below the least are left out."""
    steps = range(-radius, radius + 1)
    told = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in steps for dy in steps}
    return {k: w for k, w in told.items() if w >= least}


def density(points: DataFrame, x: str, y: str, size: float, weight: Column, kernel: dict[tuple[int, int], float], channels: dict[str, Column] | None = None, gain: float = 1.0) -> DataFrame:
    """(ix, iy, energy, tone, channels...): a weighted kernel splatted on the cells around each point; the tone is
    1 - exp(-gain x energy), and a channel (a number of each point, e.g. linear light) its mean by energy, 0 to 1."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for (dx, dy), k in kernel.items()])
    named = channels or {}
    spread = points.withColumns({"_w": weight} | {f"_ch_{n}": c for n, c in named.items()}).withColumn("_o", F.explode(offsets))
    cell = lambda c, d: (F.floor(F.col(c) / size) + F.col(f"_o.{d}")).cast("long")
    power = F.col("_w") * F.col("_o.k")
    out = spread.groupBy(cell(x, "dx").alias("ix"), cell(y, "dy").alias("iy")).agg(F.sum(power).alias("energy"), *[F.sum(power * F.col(f"_ch_{n}")).alias(n) for n in named])
    mean = {n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(n) / F.greatest(F.col("energy"), F.lit(1e-6)))) for n in named}
    return out.withColumns({"tone": 1 - F.exp(-gain * F.col("energy"))} | mean)


def darkest_hour(shares: DataFrame) -> DataFrame:
    """The row (hour, share, ...) with the smallest share, the earlier hour on ties; no row from none."""
    return shares.where("share is not null").orderBy("share", "hour").limit(1)


def share_change(shares: DataFrame, stored: DataFrame) -> DataFrame:
    """(hour, share, stored_hour, stored_share, change) of a run of one date beside another's stored minimum (one row)."""
    least = darkest_hour(stored).select(F.col("hour").alias("stored_hour"), F.col("share").alias("stored_share"))
    return shares.select("hour", "share").crossJoin(F.broadcast(least)).withColumn("change", F.col("share") - F.col("stored_share"))  # one row
