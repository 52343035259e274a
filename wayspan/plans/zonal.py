"""Queries on zones, bands, samples, mosaics and their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions import bits as b
from wayspan.functions import geo, text
from wayspan.operators import candidates, checks, graph, metrics, pixels, spatial, zones
from wayspan.plans.access import table
from wayspan.plans.surfaces import GRID, PLACES, STREETS, grid, places, streets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ZONES = {1: [(5.2, -3.1), (100.3, -20.7), (90.1, -70.2), (12.4, -60.3)], 2: [(60.6, -10.2), (120.7, -40.1), (70.3, -90.8)], 3: [(0.1, -30.4), (30.2, -30.9), (20.8, -44.7)]}
_BANDS = {1: [(3.3, -10.2, 110.4, -35.8), (110.4, -35.8, 60.1, -80.3)], 2: [(20.7, -60.1, 100.9, -15.3)], 3: [(64.2, -1.3, 64.2, -100.9)]}


def _edges(rings: dict) -> list[tuple]:
    return [(n, *r[i], *r[(i + 1) % len(r)]) for n, r in rings.items() for i in range(len(r))]


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({n}, {', '.join(f'{v}::double' for v in rest)})" for n, *rest in rows)


def zone_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_edges(_ZONES), "zone int, ax double, ay double, bx double, by double")


def band_segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *s) for n, own in _BANDS.items() for s in own], "zone int, ax double, ay double, bx double, by double")


CENTRES = f"{GRID}, q as (select row, col, col + 0.5::double as x, -(row + 0.5::double) as y from g)"
LABELS = f"""e as (select * from (values {_values(_edges(_ZONES))}) t(zone, ax, ay, bx, by_)),
l as materialized (select row, col, max(zone) as zone from (select row, col, zone from q, e group by row, col, zone having sum(case when (ay > y) <> (by_ > y) and x < ax + (y - ay) / (by_ - ay) * (bx - ax) then 1 else 0 end) % 2 = 1) group by row, col)"""
_T = "greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))))"
BAND = f"""e as (select * from (values {_values([(n, *s) for n, own in _BANDS.items() for s in own])}) t(zone, ax, ay, bx, by_)),
bd as (select row, col, zone, min(sqrt(pow(x - (ax + {_T} * (bx - ax)), 2) + pow(y - (ay + {_T} * (by_ - ay)), 2))) as d from q, e group by row, col, zone),
l as materialized (select row, col, max(zone) as zone from bd where d > 3 and d <= 8 group by row, col)"""


@query(f"with {CENTRES}, {LABELS} select row, col, zone from l")
def zone_labels(spark, sf_dir):
    return zones.label_pixels(grid(spark, sf_dir), zone_edges(spark), "zone", 16.0, 0.0, 0.0, 1.0)


@query(f"with {CENTRES}, {BAND} select row, col, zone from l")
def street_bands(spark, sf_dir):
    return zones.band_labels(grid(spark, sf_dir), band_segments(spark), "zone", 3.0, 8.0, 0.0, 0.0, 1.0)


@query(f"""with {CENTRES}, {BAND}, j as (select zone, bits as measured, case when kind = 3 then 32767 else (bits * 5 + 3) % 32768 end as corrected from l join g on l.row = g.row and l.col = g.col where kind >= 2)
select zone, hour, count(*) as ground_pixels, round_even(sum((measured >> hour) & 1) / count(*), 6) as measured, round_even(sum((corrected >> hour) & 1) / count(*), 6) as corrected from j, range(0, 15) t(hour) group by zone, hour""")
def street_profiles(spark, sf_dir):
    own = grid(spark, sf_dir)
    labels = zones.band_labels(own, band_segments(spark), "zone", 3.0, 8.0, 0.0, 0.0, 1.0)
    met = zones.labelled_surfaces(labels, own.select("row", "col", F.col("kind").alias("class")), own.select("row", "col", "bits"), own.select("row", "col", ((F.col("bits") * 5 + 3) % 32768).alias("bits")))
    out = pixels.zone_profiles(met, "zone", {"measured": "measured", "corrected": "corrected"}, F.lit(True), digits=6)
    return out.select("zone", F.col("pixels").alias("ground_pixels"), F.posexplode(F.arrays_zip("measured", "corrected")).alias("hour", "v")).select("zone", "hour", "ground_pixels", "v.measured", "v.corrected")


SAMPLES = f"{GRID}, {PLACES}, sp as (select vec_id, cast(floor(abs(y) / 3) as bigint) as row, cast(floor(abs(x) / 3) as bigint) as col from p), sm as materialized (select vec_id, sp.row, sp.col, bits, ground from sp left join g on sp.row = g.row and sp.col = g.col)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = places(spark, sf_dir).select("vec_id", (F.abs("x") / 3).alias("x"), (-(F.abs("y") / 3)).alias("y"))
    return zones.sampled_points(points, grid(spark, sf_dir), 0.0, 0.0, 1.0, ["bits", "ground"])


@query(f"with {SAMPLES} select vec_id, row, col, coalesce(bits, -1) as bits from sm")
def sampled_places(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", "row", "col", F.coalesce("bits", F.lit(-1)).alias("bits"))


@query(f"with {SAMPLES}, h as (select coalesce(ground, false) as ground, case when bits % 4 = 0 then 1 else cast(bit_count(bits) as int) end as hours from sm) select count(*) filter (ground) as measured, count(*) filter (not ground) as excluded, count(*) as published, round_even(avg(case when ground then hours end), 6) as mean_hours, count(*) filter (ground and hours = 1) as no_usable_shade from h")
def stop_statistics(spark, sf_dir):
    told = _samples(spark, sf_dir).withColumn("hours", F.when(F.col("bits") % 4 == 0, 1).otherwise(b.shaded_hours(F.col("bits"))))
    return zones.stop_statistics(told, "hours", "ground").withColumn("mean_hours", F.bround("mean_hours", 6))


_RINGS = {"north": [(-200.0, 10.0), (150.0, -30.0), (90.0, 210.0), (-20.0, 60.0)], "west": [(-300.0, -300.0), (5.0, -250.0), (-40.0, 120.0)]}
RINGS = "r as (select * from (values " + ", ".join(f"('{n}', {', '.join(f'{v}::double' for v in rest)})" for n, *rest in _edges(_RINGS)) + ") t(name, ux, uy, vx, vy))"


def ring_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_edges(_RINGS), "name string, ax double, ay double, bx double, by double")


def _inside(x: str, y: str) -> str:
    return f"sum(case when (uy > {y}) <> (vy > {y}) and {x} < ux + ({y} - uy) / (vy - uy) * (vx - ux) then 1 else 0 end) % 2 = 1"


def _turn(p: tuple, q: tuple, e: tuple) -> str:
    return f"(({q[0]} - {p[0]}) * ({e[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({e[0]} - {p[0]}))"


def _meets(a: tuple, z: tuple, u: tuple, v: tuple) -> str:
    apart = " or ".join(f"greatest({a[k]}, {z[k]}) < least({u[k]}, {v[k]}) or greatest({u[k]}, {v[k]}) < least({a[k]}, {z[k]})" for k in (0, 1))
    return f"({_turn(a, z, u)} * {_turn(a, z, v)} <= 0 and {_turn(u, v, a)} * {_turn(u, v, z)} <= 0 and not ({apart}))"


@query(f"with {PLACES}, {RINGS}, i as (select distinct vec_id from (select vec_id, name from p, r group by vec_id, name having {_inside('x', 'y')})) select label, count(*) as n, count(i.vec_id) as under from p left join i on p.vec_id = i.vec_id group by label")
def places_under(spark, sf_dir):
    told = zones.under_any(places(spark, sf_dir), ring_edges(spark), "vec_id", "name", 50.0)
    return told.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("under").alias("under"))


@query(f"""with {PLACES}, {STREETS}, {RINGS}, k as (select * from r where name = 'west') select distinct street from (select street from s, k where bx is not null group by street, ax, ay having {_inside('ax', 'ay')}
union all select street from s, k where bx is not null and {_meets(('ax', 'ay'), ('bx', 'by_'), ('ux', 'uy'), ('vx', 'vy'))})""")
def streets_touching(spark, sf_dir):
    return zones.lines_touching(streets(spark, sf_dir), ring_edges(spark), "street", "name", ["west"], 80.0)


_TILES = "tl as (select i * 10 + j as tile, (i - 5) * 80.0::double as x0, (j - 5) * 80.0::double as y0, (i - 4) * 80.0::double as x1, (j - 4) * 80.0::double as y1 from (select distinct n_nationkey % 10 as i from nation), (select distinct n_nationkey % 10 as j from nation))"
_SIDES = [(("x0", "y0"), ("x1", "y0")), (("x1", "y0"), ("x1", "y1")), (("x1", "y1"), ("x0", "y1")), (("x0", "y1"), ("x0", "y0"))]


@query(f"""with {_TILES}, {RINGS}, t as (select distinct tile from (select tile from tl, r group by tile, name, x0, y0 having {_inside('x0', 'y0')} union all select tile from tl, r where {" or ".join(_meets(a, z, ("ux", "uy"), ("vx", "vy")) for a, z in _SIDES)} union all select tile from tl, r where ux between x0 and x1 and uy between y0 and y1))
select tile % 3 as package, count(*) as tiles, min(concat('t', tile, '_DTM.tif')) as first from t group by 1""")
def boundary_tiles(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 10).alias("i")).distinct()
    size = F.lit(80.0)
    tiles = n.crossJoin(n.withColumnRenamed("i", "j")).select((F.col("i") * 10 + F.col("j")).alias("tile"), ((F.col("i") - 5) * size).alias("x0"), ((F.col("j") - 5) * size).alias("y0"), ((F.col("i") - 4) * size).alias("x1"), ((F.col("j") - 4) * size).alias("y1"))
    kept = zones.tiles_for_boundary(tiles, ring_edges(spark), "tile", "name", 80.0).withColumns({"package": F.col("tile") % 3, "sibling": zones.sibling_name(F.concat(F.lit("t"), F.col("tile").cast("string"), F.lit("_DSM.tif")))})
    return zones.packages(kept, "package").join(kept.groupBy("package").agg(F.min("sibling").alias("first")).hint("merge"), "package")


_FOCAL = lambda c, line, at: f"sum({c}) over (partition by {line} order by {at} range between 3 preceding and 3 following) + greatest(0, 3 - ({at} - min({at}) over (partition by {line}))) * arg_min({c}, {at}) over (partition by {line}) + greatest(0, 3 - (max({at}) over (partition by {line}) - {at})) * arg_max({c}, {at}) over (partition by {line})"


@query(f"""with f0 as (select o_orderkey // 128 as row, o_orderkey % 128 as col, (o_custkey % 12)::double as height, o_orderstatus = 'F' and o_custkey % 5 = 0 as canopy from orders), f1 as (select *, case when canopy and height >= 3 then height else 0 end as s, case when canopy and height >= 3 then 1.0 else 0 end as n from f0),
f2 as (select row, col, height, canopy, {_FOCAL("s", "row", "col")} as s, {_FOCAL("n", "row", "col")} as n from f1), f3 as (select row, col, height, canopy, {_FOCAL("s", "col", "row")} as s, {_FOCAL("n", "col", "row")} as n from f2)
select row, col, round_even(case when canopy and height < 3 then case when n > 0.5 and s > 0 then s / n else 8 end else height end, 6) as corrected, case when canopy and height < 3 then case when n > 0.5 and s > 0 then 'measured' else 'default' end else 'kept' end as source from f3""")
def corrected_heights(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = o.select(F.floor(F.col("o_orderkey") / 128).alias("row"), F.pmod("o_orderkey", F.lit(128)).alias("col"), (F.col("o_custkey") % 12).cast("double").alias("height"), ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 5 == 0)).alias("canopy"))
    return zones.corrected_heights(own, 3).select("row", "col", F.bround("corrected", 6).alias("corrected"), "source")


@query(f"with {GRID} select row, col, bits from g where row between 5 and 40 and col between 30 and 100")
def tile_mosaic(spark, sf_dir):
    own = grid(spark, sf_dir).withColumn("tile", F.concat_ws("/", F.floor(F.col("row") / 64).cast("string"), F.floor(F.col("col") / 64).cast("string")))
    box = own.groupBy("tile").agg(*[(F.floor(F.min(c) / 64) * 64).cast("double").alias(n) for c, n in (("col", "x0"), ("row", "y0"))], *[(F.floor(F.max(c) / 64) * 64 + 64).cast("double").alias(n) for c, n in (("col", "x1"), ("row", "y1"))])
    out = zones.mosaic(box, own.withColumnRenamed("bits", "value"), "tile", 64.0, (5, 40, 30, 100))
    return out.withColumnRenamed("value", "bits")


ADDRESS = """a as (select vec_id, label, (cast(embedding[1] as double) * 100 + 180) / 360 * 8 as tx, (1 - asinh(tan(radians(cast(embedding[2] as double) * 60))) / pi()) / 2 * 8 as ty from embeddings),
ad as (select vec_id, label, floor(tx) as tile_x, floor(ty) as tile_y, floor((tx - floor(tx)) * 256) as px, floor((ty - floor(ty)) * 256) as py from a),
px as materialized (select tile_x, tile_y, px, py, min(vec_id % 4) as class, cast(min(vec_id * 37 % 32768) as int) as m, cast(min(vec_id * 11 % 32768) as int) as c from ad where vec_id % 3 = 0 group by all)"""


@query(f"""with {ADDRESS} select vec_id, case when coalesce(class, 0) = 0 then 'missing' when class = 1 then 'non-ground' else 'ground' end as status, coalesce(class = 3, false) as under_canopy, case when class >= 2 then array_to_string(list_transform(range(0, 15), lambda h: (m >> h::int) & 1), '') else '' end as measured,
case when class >= 2 then array_to_string(list_transform(range(0, 15), lambda h: ((case when class = 3 then 32767 else c end) >> h::int) & 1), '') else '' end as corrected from ad left join px using (tile_x, tile_y, px, py)""")
def point_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 100).alias("lon"), (F.get("embedding", F.lit(1)).cast("double") * 60).alias("lat"))
    at = ["tile_x", "tile_y", "pixel_x", "pixel_y"]
    own = e.where("vec_id % 3 = 0").select("vec_id", *geo.tile_address(F.col("lon"), F.col("lat"), 3)).groupBy(*at).agg(F.min(F.col("vec_id") % 4).alias("class"), F.min(F.col("vec_id") * 37 % 32768).cast("int").alias("m"), F.min(F.col("vec_id") * 11 % 32768).cast("int").alias("c"))
    mask = lambda n: own.select(*at, F.col(n).alias("bits"))
    out = zones.point_profiles(e, own.select(*at, "class"), mask("m"), mask("c"), "vec_id", 3)
    flat = lambda n: F.coalesce(F.array_join(F.transform(n, lambda x: x.cast("string")), ""), F.lit("")).alias(n)
    return out.select("vec_id", "status", "under_canopy", flat("measured"), flat("corrected"))


@query(f"with {PLACES}, n as (select a.vec_id, b.vec_id as key, b.label as street, row_number() over (partition by a.vec_id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) as r from p a join p b on a.label = 0 and b.label <> 0) select vec_id, key, street from n where r = 1")
def nearest_street(spark, sf_dir):
    own = places(spark, sf_dir)
    inventory = own.where("label <> 0").select(F.col("vec_id").alias("key"), "x", "y", F.col("label").alias("street"))
    return zones.street_at(own.where("label = 0"), inventory, "vec_id", "key", "street", 20.0).select("vec_id", "key", "street")


@query("""with n as (select p_size, case p_partkey % 11 when 0 then replace(p_name, ' ', '-') when 1 then upper(p_name) when 2 then concat('  ', replace(p_name, ' ', '   ')) else p_name end as raw from part), k as (select lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) as key, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as name, count(*) as n, sum(p_size) as l from n group by all),
w as (select key, arg_min(name, (-n, lower(name), name)) as name, sum(l) as length, sum(n) as parts from k group by key), d as (select *, replace(lower(name), ' ', '-') as s, row_number() over (partition by replace(lower(name), ' ', '-') order by key) as r from w)
select key, name, cast(length as bigint) as length, cast(parts as bigint) as parts, case when r = 1 then s else concat(s, '-', substr(sha1(key), 1, 8)) end as street_id from d where length >= 100""")
def named_streets(spark, sf_dir):
    k, name = F.col("p_partkey") % 11, F.col("p_name")
    raw = F.when(k == 0, F.replace(name, F.lit(" "), F.lit("-"))).when(k == 1, F.upper(name)).when(k == 2, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("   ")))).otherwise(name)
    out = zones.named_streets(table(spark, sf_dir, "part").select(raw.alias("raw"), F.col("p_size").cast("long").alias("length")), "raw", "length")
    return out.select("key", "name", "length", "parts", "street_id")


@query("select l_suppkey, l_returnflag, sum(l_quantity) as length, count(*) as parts from lineitem group by all having sum(l_quantity) >= 1500")
def merged_lines(spark, sf_dir):
    return zones.merged_lines(table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "length"), ["l_suppkey", "l_returnflag"], "length", 1500)


_CROSS = """t as (select street, ax, ay, bx, by_ as dy, street % 2 as f from s where bx is not null),
x as (select a.street as a, b.street as b, (a.bx - a.ax) * (b.ay - a.ay) - (a.dy - a.ay) * (b.ax - a.ax) as d1, (a.bx - a.ax) * (b.dy - a.ay) - (a.dy - a.ay) * (b.bx - a.ax) as d2,
(b.bx - b.ax) * (a.ay - b.ay) - (b.dy - b.ay) * (a.ax - b.ax) as d3, (b.bx - b.ax) * (a.dy - b.ay) - (b.dy - b.ay) * (a.bx - b.ax) as d4 from t a join t b on a.street < b.street and a.f <> b.f),
k as (select a, b, case a % 3 when 0 then 'connect' when 1 then 'keep_disconnected' else 'unresolved' end as action from x where d1 * d2 < 0 and d3 * d4 < 0)"""


@query(f"with {PLACES}, {STREETS}, {_CROSS}, c as (select street, count(*) as cuts from (select a as street from k where action = 'connect' union all select b from k where action = 'connect') group by 1) select action, count(*) as n, cast(case when action = 'connect' then (select sum(cuts) from c) else 0 end as bigint) as cuts from k group by action")
def reviewed_crossings(spark, sf_dir):
    own = streets(spark, sf_dir).withColumn("feature", F.col("street") % 2)
    found = graph.checkpointed(spatial.segment_crossings(own, "street", "feature", 120.0))
    action = F.when(F.col("a") % 3 == 0, "connect").when(F.col("a") % 3 == 1, "keep_disconnected")
    resolved = candidates.resolved_crossings(found, found.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y", action.alias("action")).where("action is not null"))
    cuts = candidates.connecting_cuts(resolved, own, "street").where("share > 0 and share < 1").agg(F.count(F.lit(1)).alias("_c"))
    return resolved.groupBy("action").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(cuts)).select("action", "n", F.when(F.col("action") == "connect", F.col("_c")).otherwise(0).alias("cuts"))  # one row


@query("""with l as (select l_suppkey as id, round_even(l_quantity / 10, 0) as ax, l_linenumber as ay, round_even(l_discount * 50, 0) as bx, l_partkey % 5 as by_, l_quantity as length from lineitem), e as (select least(concat(ax::int, ',', ay), concat(bx::int, ',', by_)) as src, greatest(concat(ax::int, ',', ay), concat(bx::int, ',', by_)) as dst, min(length) as length from l where ax <> bx or ay <> by_ group by all)
select count(*) as edges, sum(length) as total, (select count(*) from (select ax, ay from l union select bx, by_ from l)) as nodes from e""")
def network_tables(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    i = table(spark, sf_dir, "lineitem")
    lines = i.select("l_suppkey", "l_quantity", F.array(point(F.bround(F.col("l_quantity") / 10, 0), F.col("l_linenumber")), point(F.lit(99.5), F.lit(99.5)), point(F.bround(F.col("l_discount") * 50, 0), F.col("l_partkey") % 5)).alias("coords"))
    nodes, edges = graph.network_tables(lines, "l_suppkey", "coords", "l_quantity")
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("total")).crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("nodes"))))  # one row each


# --- contracts ----------------------------------------------------------------------------------


@query("""with w as (select s_suppkey as place, walk from supplier, (values (300), (400), (500)) v(walk)), f as (select place, walk, case when place % 11 = 0 and walk = 300 then 'x' else concat('reach:p', place, ':', walk) end as id from w where not (place % 7 = 0 and walk = 400) union all select place, 400, concat('reach:p', place, ':400') from w where place % 13 = 0 and walk = 400 and place % 7 > 0 union all select place, 900, concat('reach:p', place, ':900') from w where walk = 300 and place % 17 = 0)
select place, walk, 'missing' as problem from w where place % 7 = 0 and walk = 400 union all select place, walk, 'unexpected' from f where walk = 900 union all select place, walk, 'repeated' from f group by all having count(*) > 1 union all select place, walk, 'wrong id' from f where id = 'x'""")
def reach_problems(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"))
    k = F.col("place")
    whole = own.withColumn("walk", F.explode(F.array(*map(F.lit, (300, 400, 500)))))
    rows = whole.where(~((k % 7 == 0) & (F.col("walk") == 400))).union(own.where((k % 13 == 0) & (k % 7 > 0)).withColumn("walk", F.lit(400))).union(own.where(k % 17 == 0).withColumn("walk", F.lit(900)))
    expected = text.reach_id(F.concat(F.lit("p"), F.col("place").cast("string")), F.col("walk"))
    reach = rows.withColumn("id", F.when((k % 11 == 0) & (F.col("walk") == 300), "x").otherwise(expected))
    return checks.incomplete_reach(reach, own, "place", [300, 400, 500], expected)


@query("""with s as (select case when s_suppkey % 10 = 9 then 'S1' when s_suppkey % 10 = 8 then 'no good' else concat('S', s_suppkey) end as id, case when s_suppkey % 10 = 7 then ' ' else s_name end as name, -79.5 + case when s_suppkey % 10 = 6 then 1 else 0 end as lon, 43.7 as lat from supplier)
select distinct id, name, lon from s where id = 'no good' or trim(name) = '' or lon > -79.1 or id in (select id from s group by id having count(*) > 1)""")
def stop_list_problems(spark, sf_dir):
    k = F.col("s_suppkey") % 10
    s = table(spark, sf_dir, "supplier").select(F.when(k == 9, "S1").when(k == 8, "no good").otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("id"), F.when(k == 7, " ").otherwise(F.col("s_name")).alias("name"), (F.lit(-79.5) + F.when(k == 6, 1).otherwise(0)).alias("lon"), F.lit(43.7).alias("lat"))
    return checks.bad_stop_list(s, "id", "name", "lon", "lat", (-79.7, 43.5, -79.1, 43.9)).select("id", "name", "lon")


@query("""with h as (select n_nationkey as key, n_nationkey % 3 + 3 as count, case when n_nationkey % 4 = 0 then 1 else 99 end as of_total, case when n_nationkey % 5 = 0 then 'rank' else 'name' end as "order" from nation), c as (select s_nationkey, count(*) as have from supplier group by 1)
select key, coalesce(have, 0) as have from h left join c on s_nationkey = key where not (count = coalesce(have, 0) and of_total >= count and "order" = 'name')""")
def list_count_problems(spark, sf_dir):
    n = F.col("n_nationkey")
    heads = table(spark, sf_dir, "nation").select(n.alias("key"), (n % 3 + 3).alias("count"), F.when(n % 4 == 0, 1).otherwise(99).alias("of_total"), F.when(n % 5 == 0, "rank").otherwise("name").alias("order"))
    return checks.bad_list_counts(heads, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")), "key").select("key", "have")


@query("select n_name from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 3 = 0)")
def empty_nations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    facts = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("n_nationkey")).join(n.hint("merge"), "n_nationkey").select("n_name")
    return checks.empty_dimensions(n, facts, ["n_name"])


@query("select c_custkey from customer where c_custkey % 6 = 0 or length(c_name) > 17 or c_mktsegment not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD') or c_custkey % 8 = 0")
def record_problems(spark, sf_dir):
    k = F.col("c_custkey")
    told = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 6 > 0, F.col("c_name")).alias("title"), F.col("c_name").alias("description"), F.col("c_mktsegment").alias("theme"), F.when(k % 8 == 0, "soon").otherwise("2026-07-21").alias("published"))
    return checks.bad_records(told, ["title"], {"description": 17}, {"theme": ["BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"]}, ["published"]).select("c_custkey")


@query("""with z as (select l_suppkey as zone, cast(sum(l_quantity) as bigint) as length, count(*) as pixels, case when l_suppkey % 9 = 0 then 1.5 else 0.5 end as v, case when l_suppkey % 7 = 0 then 'Bad Id' else concat('s-', l_suppkey) end as id, case when l_suppkey % 8 = 0 then ' x' else 'x' end as name, case when l_suppkey % 10 = 0 then -80 else -79.5 end as lon from lineitem group by l_suppkey)
select zone from z where length < 15000 or v > 1 or id = 'Bad Id' or name = ' x' or lon < -79.7""")
def profile_problems(spark, sf_dir):
    k = F.col("l_suppkey")
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("length"), F.count(F.lit(1)).alias("pixels"))
    told = own.select(k.alias("zone"), "length", "pixels", F.array_repeat(F.when(k % 9 == 0, 1.5).otherwise(0.5), 15).alias("m"), F.when(k % 7 == 0, F.concat(F.lit("Bad Id"), F.lit(""))).otherwise(F.concat(F.lit("s-"), k.cast("string"))).alias("id"), F.when(k % 8 == 0, " x").otherwise("x").alias("name"), F.when(k % 10 == 0, -80.0).otherwise(-79.5).alias("lon"), F.lit(43.7).alias("lat"))
    return checks.bad_profiles(told, "id", "name", ["m"], "length", "pixels", "lon", "lat", (-79.7, 43.5, -79.1, 43.9), least=15000).select("zone")


@query("select o_orderkey from orders where cast(o_orderdate as date) <> date '1995-06-01' and o_custkey % 20 = 0")
def unexpected_dates(spark, sf_dir):
    told = table(spark, sf_dir, "orders").where("o_custkey % 20 = 0").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return checks.unexpected_dates(told, "day", "1995-06-01").select("o_orderkey")


@query(f"with {GRID} select zoom, count(*) as boxes, cast(sum(tiles) as bigint) as tiles from (select zoom, (cast(floor((row % 40 + 10) / 100 * (1 << zoom)) as bigint) - cast(floor((row % 40) / 100 * (1 << zoom)) as bigint) + 1) * (cast(floor((col % 50 + 20) / 100 * (1 << zoom)) as bigint) - cast(floor((col % 50) / 100 * (1 << zoom)) as bigint) + 1) as tiles from g, (values (2), (4)) v(zoom)) group by zoom")
def tile_counts(spark, sf_dir):
    own = grid(spark, sf_dir).withColumn("key", F.struct("row", "col"))
    at = lambda c, z: c / 100 * F.lit(1 << z)
    r, c = F.col("row") % 40, F.col("col") % 50
    out = pixels.tiles_for_box(own.withColumn("key", F.col("row") * 128 + F.col("col")), "key", [2, 4], {z: at(r, z) for z in (2, 4)}, {z: at(r + 10, z) for z in (2, 4)}, {z: at(c, z) for z in (2, 4)}, {z: at(c + 20, z) for z in (2, 4)})
    return out.groupBy("zoom").agg(F.count(F.lit(1)).alias("boxes"), F.sum("tiles").alias("tiles"))


@query("select l_suppkey as zone, count(*) as n from lineitem where l_linenumber = 1 group by 1 order by n desc, zone limit 3")
def top_zones(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.extremes(counts, "zone", "n", 3).where("side = 'highest'").select("zone", "n")
