"""Queries on places, pixels, names and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayspan.functions import bits as b
from wayspan.functions import geo, text
from wayspan.operators import checks, metrics, pixels, spatial, zones
from wayspan.operators.graph import components
from wayspan.plans.access import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- inventory ----------------------------------------------------------------------------------


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an inventory of trees: a genus before the second word, some with cultivar names, crosses or nothing."""
    p = table(spark, sf_dir, "part")
    genus = F.get(F.array(*map(F.lit, ("Acer", "Picea", "Malus", "Fraxinus", "Celtis"))), F.col("p_size") % 5)
    second, k = F.substring_index("p_name", " ", -1), (F.col("p_partkey") % 7).cast("int")
    name = F.when(k == 0, F.concat(genus, F.lit(" \u00d7 "), second)).when(k == 1, F.concat(genus, F.lit(" "), second, F.lit(" 'Red'"))).when(k == 2, F.concat(genus, F.lit(" Brandywine"))).when(k == 3, F.lit(" ")).otherwise(F.concat(genus, F.lit(" "), second))
    return p.select("p_partkey", "p_brand", name.alias("botanical"))


TREES = """g as (select p_partkey, p_brand, ['Acer', 'Picea', 'Malus', 'Fraxinus', 'Celtis'][p_size % 5 + 1] as genus, split_part(p_name, ' ', -1) as second, p_partkey % 7 as k from part),
t as (select p_partkey, p_brand, case when k = 3 then '?' when k = 0 then concat(genus, ' x') when k = 2 then genus else concat(genus, ' ', second) end as species from g)"""


@query(f"with {TREES} select species, case split_part(species, ' ', 1) when 'Acer' then 0 when 'Picea' then 4 when 'Malus' then 7 when 'Fraxinus' then 9 else 10 end as category, count(*) as n, count(distinct p_brand) as brands from t group by all")
def species_counts(spark, sf_dir):
    species = text.species_key(F.col("botanical"))
    told = trees(spark, sf_dir).select(species.alias("species"), "p_brand").withColumn("category", text.genus_category(F.substring_index("species", " ", 1)))
    return told.groupBy("species", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"))


@query(f"with {TREES}, s as (select *, case when p_partkey % 5 = 0 then concat(species, p_partkey) else species end as key from t) select p_partkey, key from s where contains(key, ' ') and key in (select key from s group by key having count(*) = 1)")
def single_species(spark, sf_dir):
    told = trees(spark, sf_dir).withColumn("key", text.species_key(F.col("botanical")))
    own = told.withColumn("key", F.when(F.col("p_partkey") % 5 == 0, F.concat("key", F.col("p_partkey").cast("string"))).otherwise(F.col("key")))
    return metrics.singletons(own, "key", species=True).select("p_partkey", "key")


@query("select c_nationkey, arg_min(c_name, c_custkey) filter (c_custkey % 4 > 0) as name, arg_min(c_mktsegment, c_custkey) filter (c_mktsegment <> 'BUILDING') as segment from customer group by c_nationkey")
def first_names(spark, sf_dir):
    told = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return metrics.first_filled(told, ["c_nationkey"], "c_custkey", ["name", "segment"])


@query("select p_partkey, concat(p_brand, p_type, p_size) as kind from part where concat(p_brand, p_type, p_size) in (select concat(p_brand, p_type, p_size) from part group by 1 having count(*) = 1)")
def species_singletons(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("kind"))
    return metrics.singletons(keyed, "kind").select("p_partkey", "kind")


@query("select p_name, count(*) as n, row_number() over (order by count(*) desc, min(p_partkey)) - 1 as index from part group by p_name")
def species_index(spark, sf_dir):
    return metrics.ranked_keys(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("select p_partkey, row_number() over (order by p_name, p_partkey) - 1 as number from part")
def position_ids(spark, sf_dir):
    return metrics.numbered(table(spark, sf_dir, "part"), ["p_name", "p_partkey"]).select("p_partkey", "number")


@query("select count(*) filter (starts_with(p_name, 'red')) as red, count(*) filter (p_size <= 10 and contains(p_type, 'EC')) as small_economy, count(*) as all_parts from part")
def prefix_counts(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").agg(F.count_if(name.startswith("red")).alias("red"), F.count_if((F.col("p_size") <= 10) & F.col("p_type").contains("EC")).alias("small_economy"), F.count(F.lit(1)).alias("all_parts"))


@query("""select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey, case when count(distinct c_acctbal >= 0) = 1 then min(case when c_acctbal >= 0 then 'credit' else 'debt' end) end as sign, bool_or(c_acctbal > 9000) as rich, count(*) as records from customer group by all""")
def consolidated_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("sign", F.when(F.col("c_acctbal") >= 0, "credit").otherwise("debt"))
    return metrics.consolidate(c, ["c_nationkey", "c_mktsegment"], "c_custkey", ["sign"], {"rich": F.col("c_acctbal") > 9000})


@query("""with c as (select lower(c_mktsegment) as key, case when c_custkey % 3 = 0 then lower(c_mktsegment) else c_mktsegment end as display, count(*) as n from customer group by all),
r as (select *, row_number() over (partition by key order by n desc, lower(display), display) as r, sum(n) over (partition by key) as total from c) select key, display, cast(total as bigint) as n from r where r = 1""")
def common_spellings(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("spelt", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return metrics.common_spelling(c, F.lower("spelt"), "spelt")


@query("""select l_returnflag, count(l_extendedprice) as n, round_even(quantile_cont(l_extendedprice, 0.5), 4) as p50, round_even(quantile_cont(l_extendedprice, 0.95), 4) as p95, round_even(quantile_cont(l_extendedprice, 0.99), 4) as p99, max(l_extendedprice) as max, count(*) filter (l_extendedprice > 50000) as above from lineitem group by l_returnflag""")
def price_percentiles(spark, sf_dir):
    out = metrics.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 50000)
    return out.withColumns({c: F.bround(c, 4) for c in ("p50", "p95", "p99")})


@query("select 'right' as side, k from (select distinct c_nationkey as k from customer where c_nationkey < 20 except select distinct s_nationkey from supplier where s_suppkey % 3 = 0) union all select 'left', k from (select distinct s_nationkey as k from supplier where s_suppkey % 3 = 0 except select distinct c_nationkey from customer where c_nationkey < 20)")
def nation_sets(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))
    return metrics.set_equality(left, table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("k")))


# --- places -------------------------------------------------------------------------------------


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.get("embedding", F.lit(0)).cast("double") * 1000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 1000).alias("y"))


PLACES = "p as materialized (select vec_id, label, cast(embedding[1] as double) * 1000 as x, cast(embedding[2] as double) * 1000 as y from embeddings)"
GAP = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"with {PLACES} select label, round_even(avg(x), 5) as cx, round_even(avg(y), 5) as cy, count(*) as n from p group by label having count(*) >= 3")
def group_centroids(spark, sf_dir):
    return metrics.group_centroids(places(spark, sf_dir), "label", "x", "y", 3).withColumns({"cx": F.bround("cx", 5), "cy": F.bround("cy", 5)})


@query(f"with {PLACES} select a.vec_id as a, b.vec_id as b, round_even({GAP}, 3) as metres from p a join p b on a.vec_id < b.vec_id and a.label <> b.label and {GAP} <= 12")
def nearby_pairs(spark, sf_dir):
    return spatial.pairs_within(places(spark, sf_dir), "vec_id", "x", "y", 12.0, "label").withColumn("metres", F.bround("metres", 3))


@query(f"with {PLACES} select a.vec_id as a, b.vec_id as b, a.label as label, round_even({GAP}, 3) as metres from p a join p b on a.vec_id < b.vec_id and a.label = b.label and {GAP} <= 15")
def same_label_pairs(spark, sf_dir):
    return spatial.same_key_pairs(places(spark, sf_dir), "vec_id", "label", "x", "y", 15.0).withColumn("metres", F.bround("metres", 3))


@query(f"""with recursive {PLACES}, l as materialized (select a.vec_id as a, b.vec_id as b from p a join p b on a.vec_id <> b.vec_id and {GAP} <= 6),
r(node, other) as (select vec_id, vec_id from p union select r.node, l.b from r join l on r.other = l.a) select vec_id, component, dense_rank() over (order by component) - 1 as cluster from (select node as vec_id, min(other) as component from r group by node)""")
def place_clusters(spark, sf_dir):
    own = places(spark, sf_dir)
    links = spatial.pairs_within(own, "vec_id", "x", "y", 6.0)
    return metrics.cluster_numbers(components(own.select(F.col("vec_id").alias("node")), links)).withColumnRenamed("node", "vec_id")


@query(f"""with {PLACES} select vec_id, other, metres from (select a.vec_id, b.vec_id as other, round_even({GAP}, 3) as metres, row_number() over (partition by a.vec_id order by {GAP}, b.vec_id) as r from p a join p b on a.label = 0 and b.label <> 0) where r = 1""")
def nearest_places(spark, sf_dir):
    own = places(spark, sf_dir)
    out = spatial.nearest_node(own.where("label = 0"), own.where("label <> 0").withColumnRenamed("vec_id", "other"), "vec_id", "other", "x", "y", 20.0)
    return out.withColumn("metres", F.bround("metres", 3))


@query(f"""with {PLACES}, q as (select a.vec_id as a, b.vec_id as b, {GAP} as m from p a join p b on a.vec_id < b.vec_id and {GAP} <= 25)
select a, string_agg(cast(b as varchar), ', ' order by r) as nearest from (select *, row_number() over (partition by a order by m, b) as r from q) where r <= 3 group by a""")
def three_nearest(spark, sf_dir):
    pairs = spatial.pairs_within(places(spark, sf_dir), "vec_id", "x", "y", 25.0)
    top = metrics.top_per_group(pairs, ["a"], [F.col("metres"), F.col("b")], 3)
    return top.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "b"))).alias("_n")).select("a", F.array_join(F.transform("_n", lambda s: s["b"].cast("string")), ", ").alias("nearest"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    own = places(spark, sf_dir).where("label = 1").withColumns({"bx": F.lead("x").over(order), "by": F.lead("y").over(order)})
    return own.where("bx is not null").select(F.col("vec_id").alias("street"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


STREETS = "s as materialized (select vec_id as street, x as ax, y as ay, lead(x) over (order by vec_id) as bx, lead(y) over (order by vec_id) as by_ from p where label = 1)"
SNAPS = f"""{PLACES}, {STREETS}, t as (select vec_id, street, x, y, ax, ay, bx, by_, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as share from p join s on bx is not null where label = 0),
u as (select *, sqrt((x - (ax + share * (bx - ax))) * (x - (ax + share * (bx - ax))) + (y - (ay + share * (by_ - ay))) * (y - (ay + share * (by_ - ay)))) as m from t),
snap as materialized (select * from (select *, row_number() over (partition by vec_id order by m, street) as r from u where m <= 30) where r = 1)"""


@query(f"with {SNAPS} select vec_id, street, round_even(share, 5) as share, round_even(m, 3) as metres from snap")
def snapped_places(spark, sf_dir):
    out = spatial.snap_to_segments(places(spark, sf_dir).where("label = 0"), streets(spark, sf_dir), "vec_id", "street", 30.0)
    return out.select("vec_id", "street", F.bround("share", 5).alias("share"), F.bround("metres", 3).alias("metres"))


@query(f"with {SNAPS}, c as (select street, share from snap union select street, e from s, (values (0.0::double), (1.0::double)) v(e) where bx is not null) select street, count(distinct share) - 1 as pieces from c group by street")
def street_pieces(spark, sf_dir):
    own = streets(spark, sf_dir)
    snaps = spatial.snap_to_segments(places(spark, sf_dir).where("label = 0"), own, "vec_id", "street", 30.0)
    return spatial.split_segments(own, snaps, "street").groupBy("street").agg(F.count(F.lit(1)).alias("pieces"))


_RINGS = {"north": [(-200.0, 10.0), (150.0, -30.0), (90.0, 210.0), (-20.0, 60.0)], "west": [(-300.0, -300.0), (5.0, -250.0), (-40.0, 120.0)]}


def _ring_edges() -> list[tuple]:
    return [(n, *r[i], *r[(i + 1) % len(r)]) for n, r in _RINGS.items() for i in range(len(r))]


@query(f"""with {PLACES}, e as (select * from (values {", ".join(f"('{n}', {ax}::double, {ay}::double, {bx}::double, {by}::double)" for n, ax, ay, bx, by in _ring_edges())}) t(name, ax, ay, bx, by_))
select vec_id, name from p, e group by vec_id, name having sum(case when (ay > y) <> (by_ > y) and x < ax + (y - ay) / (by_ - ay) * (bx - ax) then 1 else 0 end) % 2 = 1""")
def places_in_polygons(spark, sf_dir):
    edges = spark.createDataFrame(_ring_edges(), "name string, ax double, ay double, bx double, by double")
    return spatial.points_in_polygons(places(spark, sf_dir), edges, "vec_id", "name", 50.0)


@query("""with e as (select vec_id, cast(embedding[1] as double) * 100 as lon, cast(embedding[2] as double) * 60 as lat from embeddings), t as (select vec_id, (lon + 180) / 360 * 4096 as tx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 as ty from e)
select vec_id, cast(floor(tx) as bigint) as tile_x, cast(floor(ty) as bigint) as tile_y, cast(floor((tx - floor(tx)) * 256) as bigint) as pixel_x, cast(floor((ty - floor(ty)) * 256) as bigint) as pixel_y from t""")
def tile_addresses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lon, lat = F.get("embedding", F.lit(0)).cast("double") * 100, F.get("embedding", F.lit(1)).cast("double") * 60
    return e.select("vec_id", *geo.tile_address(lon, lat, 12))


@query(f"with {PLACES} select label, round_even(min(x), 4) as x0, round_even(max(x), 4) as x1, round_even(min(y), 4) as y0, round_even(max(y), 4) as y1 from p group by label")
def bounding_boxes(spark, sf_dir):
    low, high = (lambda c, n: F.bround(F.min(c), 4).alias(n)), (lambda c, n: F.bround(F.max(c), 4).alias(n))
    return places(spark, sf_dir).groupBy("label").agg(low("x", "x0"), high("x", "x1"), low("y", "y0"), high("y", "y1"))


_KERNEL = pixels.gaussian_kernel(2, 1.05)


@query(f"""with {PLACES}, k as (select dx, dy, exp(-(dx * dx + dy * dy) / (2 * 1.05::double * 1.05::double)) as w from range(-2, 3) t(dx), range(-2, 3) u(dy)),
e as (select cast(floor(x / 10) + dx as bigint) as ix, cast(floor(y / 10) + dy as bigint) as iy, sum((label + 1) * w) as energy, sum((label + 1) * w * (vec_id % 5) / 4) as red from p, k where w >= 0.02 group by 1, 2)
select ix, iy, round_even(energy, 6) as energy, round_even(1 - exp(-0.5::double * energy), 6) as tone, round_even(least(1, greatest(0, red / greatest(energy, 1e-6))), 6) as red from e""")
def density_grid(spark, sf_dir):
    out = pixels.density(places(spark, sf_dir), "x", "y", 10.0, F.col("label") + 1, _KERNEL, {"red": F.col("vec_id") % 5 / 4}, 0.5)
    return out.select("ix", "iy", *[F.bround(c, 6).alias(c) for c in ("energy", "tone", "red")])


# --- pixels -------------------------------------------------------------------------------------


def zone_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels: zone is the supplier, the mask comes from the keys, open lines are ground."""
    mask = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 31) % 32768).cast("int")
    other = ((F.col("l_orderkey") * 5 + F.col("l_partkey") * 3) % 32768).cast("int")
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), mask.alias("raw"), other.alias("corrected"), (F.col("l_linestatus") == "O").alias("ground"), (F.col("l_returnflag") == "R").alias("canopy"))
    return item.withColumn("value", b.shaded_hours(F.col("raw")).cast("int"))


ZONES = """z as (select l_suppkey as zone, cast((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 32768 as int) as raw, cast((l_orderkey * 5 + l_partkey * 3) % 32768 as int) as corrected, l_linestatus = 'O' as ground, l_returnflag = 'R' as canopy from lineitem),
h as (select zone, cast(bit_count(raw) as int) as value, count(*) as n from z where ground group by all),
s as (select zone, sum(value * n) / sum(n) as mean, cast(sum(n) as bigint) as pixels from h group by zone), md as (select zone, median(bit_count(raw)::int) as median from z where ground group by zone)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram_summary(metrics.histogram(zone_pixels(spark, sf_dir), "zone", "value", F.col("ground")), "zone", "value")


@query(f"with {ZONES} select zone, value, n from h")
def zone_histogram(spark, sf_dir):
    return metrics.histogram(zone_pixels(spark, sf_dir), "zone", "value", F.col("ground"))


@query(f"with {ZONES} select zone, round_even(mean, 6) as mean, cast(median as double) as median, pixels from s join md using (zone)")
def zone_mean_median(spark, sf_dir):
    return _summary(spark, sf_dir).withColumn("mean", F.bround("mean", 6))


@query(f"with {ZONES}, c as (select * from s where zone % 4 > 0) select zone, round_even(mean, 6) as mean, side, place from (select zone, mean, 'highest' as side, row_number() over (order by mean desc, zone) as place from c union all select zone, mean, 'lowest', row_number() over (order by mean, zone) from c) where place <= 5")
def zone_extremes(spark, sf_dir):
    return metrics.extremes(_summary(spark, sf_dir), "zone", "mean", 5, F.col("zone") % 4 > 0).withColumn("mean", F.bround("mean", 6))


@query(f"with {ZONES}, r as (select zone, s_nationkey < 8 as inside from h join supplier on s_suppkey = zone group by all), f as (select case when inside then 'inside' else 'outside' end as region, value, n from h join r using (zone) union all select 'all', value, n from h join r using (zone)) select region, round_even(sum(value * n) / sum(n), 6) as mean, cast(sum(n) as bigint) as pixels from f group by region")
def region_means(spark, sf_dir):
    zones = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone"), (F.col("s_nationkey") < 8).alias("inside"))
    hist = metrics.histogram(zone_pixels(spark, sf_dir), "zone", "value", F.col("ground"))
    return metrics.region_means(hist, zones, "zone", "value", "inside").withColumn("mean", F.bround("mean", 6))


@query(f"with {ZONES}, a as (select s_nationkey, coalesce(sum(case when median < 7.5 then abs(s_acctbal) end), 0) / 1000 as poor_km, coalesce(sum(case when median is not null then abs(s_acctbal) end), 0) / 1000 as total_km from supplier left join md on zone = s_suppkey and zone % 5 > 0 group by s_nationkey) select s_nationkey, round_even(poor_km, 4) as poor_km, round_even(total_km, 4) as total_km, round_even(case when total_km > 0 then 100 * poor_km / total_km else 0 end, 4) as share_percent, case when total_km > 0 then 100 * poor_km / total_km >= 25 else false end as shortage_holds from a")
def shortage_shares(spark, sf_dir):
    told = table(spark, sf_dir, "supplier").join(_summary(spark, sf_dir).where("zone % 5 > 0").hint("merge"), F.col("zone") == F.col("s_suppkey"), "left").withColumn("length", F.abs("s_acctbal"))
    return metrics.shortage_share(told, ["s_nationkey"], "median", "length", 7.5).withColumns({c: F.bround(c, 4) for c in ("poor_km", "total_km", "share_percent")})


@query(f"with {ZONES} select hour, cast(sum((raw >> hour) & 1) as bigint) as shaded, count(*) as ground_pixels, round_even(sum((raw >> hour) & 1) / count(*), 6) as share from z, range(0, 15) t(hour) where ground group by hour")
def hourly_shares(spark, sf_dir):
    return pixels.hour_shares(zone_pixels(spark, sf_dir), "raw", F.col("ground")).withColumn("share", F.bround("share", 6))


@query(f"with {ZONES} select zone, hour, round_even(sum((raw >> hour) & 1) / count(*), 4) as raw, round_even(sum((corrected >> hour) & 1) / count(*), 4) as corrected from z, range(0, 15) t(hour) where ground group by zone, hour")
def zone_profiles(spark, sf_dir):
    out = pixels.zone_profiles(zone_pixels(spark, sf_dir), "zone", {"raw": "raw", "corrected": "corrected"}, F.col("ground"))
    return out.select("zone", F.posexplode(F.arrays_zip("raw", "corrected")).alias("hour", "v")).select("zone", "hour", "v.raw", "v.corrected")


@query(f"with {ZONES} select zone, count(*) as ground_pixels, case when count(*) >= 100 then round_even((sum((raw >> 9) & 1) - sum((raw >> 3) & 1)) / count(*), 6) end as swing from z where ground group by zone")
def zone_swings(spark, sf_dir):
    return pixels.swing(zone_pixels(spark, sf_dir), "zone", "raw", 3, 9, F.col("ground"), 100).withColumn("swing", F.bround("swing", 6))


@query(f"""with {ZONES}, k as (select *, case when not ground then 1 when canopy then 3 else 2 end as kind, case when raw % 9 = 0 then 0 when ground and canopy then 32767 else corrected end as fixed from z)
select kind, case when kind = 3 then 'shaded' when bit_count(fixed) = 0 then 'no data' when (fixed >> 6) & 1 = 1 then 'shaded' else 'sunlit' end as state, count(*) as n, cast(sum(bit_count(fixed) * 65536 + fixed) as bigint) as packed, count(*) filter (bit_count(fixed) = 0) as empty_masks from k group by all""")
def pixel_states(spark, sf_dir):
    own = zone_pixels(spark, sf_dir)
    fixed = F.when(F.col("raw") % 9 == 0, 0).otherwise(b.with_canopy(F.col("corrected"), F.col("ground"), F.col("canopy")))
    own = own.withColumns({"kind": b.pixel_class(F.lit(True), F.col("ground"), F.col("canopy")), "fixed": fixed}).withColumn("packed", b.pack(b.shaded_hours(F.col("fixed")).cast("long"), F.col("fixed")))
    count, bits = b.unpack(F.col("packed"))
    state = b.hour_state(count, bits, 6, F.col("kind") == 3, True)
    return own.groupBy("kind", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("packed").alias("packed"), F.count_if((count == 0) & b.consistent(count, bits)).alias("empty_masks"))


@query("select l_suppkey, cast(bit_or(case when l_linenumber <= 7 and l_quantity > 25 then 1 << (l_linenumber - 1) else 0 end) as int) as bits, cast(bit_count(bit_or(case when l_linenumber <= 7 and l_quantity > 25 then 1 << (l_linenumber - 1) else 0 end)) as int) as hours from lineitem group by l_suppkey")
def packed_hours(spark, sf_dir):
    flags = {h: (F.col("l_linenumber") == h + 1) & (F.col("l_quantity") > 25) for h in range(7)}
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bit_or(b.packed(flags)).alias("bits"))
    return out.withColumn("hours", F.aggregate(b.profile(F.col("bits")), F.lit(0), lambda a, x: a + x))


@query("with m as (select l_partkey, l_returnflag as f, min(l_linenumber) as hours from lineitem group by all) select cast(p_partkey as varchar) as id, p_name as name from part where p_partkey in (select l_partkey from m group by l_partkey having count(*) = 3 and bool_and(hours = 1))")
def bare_stops(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.min("l_linenumber").alias("hours"))
    bare = zones.bare_on_every_surface(samples, "l_partkey", "l_returnflag", "hours", ["A", "N", "R"])
    stops = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return zones.bare_stop_records(bare, stops, "l_partkey", "p_name", "lon", "lat").select("id", "name")


@query(f"with {ZONES}, h2 as (select hour, sum((raw >> hour) & 1) / count(*) as share from z, range(0, 15) t(hour) where ground group by hour), m as (select hour, share from h2 order by share, hour limit 1), o as (select hour, sum((corrected >> hour) & 1) / count(*) as share from z, range(0, 15) t(hour) where ground group by hour) select o.hour, round_even(o.share, 6) as share, m.hour as stored_hour, round_even(o.share - m.share, 6) as change from o, m")
def minimum_hours(spark, sf_dir):
    own = zone_pixels(spark, sf_dir)
    out = pixels.share_change(pixels.hour_shares(own, "corrected", F.col("ground")), pixels.hour_shares(own, "raw", F.col("ground")))
    return out.select("hour", F.bround("share", 6).alias("share"), "stored_hour", F.bround("change", 6).alias("change"))


@query(f"with {ZONES}, w as (select zone, (sum((raw >> 9) & 1) - sum((raw >> 3) & 1)) / count(*) as swing, count(*) as g from z where ground group by zone), y as (select zone, count(*) as n from z group by zone), n as (select l_suppkey as zone, sum(l_quantity) as metres, count(distinct l_returnflag) as names from lineitem where l_returnflag <> 'N' group by 1) select w.zone, round_even(swing, 6) as swing, metres, names from w join y using (zone) join n using (zone) where g / n >= 0.3 and metres >= 100 order by swing desc, zone limit 1")
def best_block(spark, sf_dir):
    own = zone_pixels(spark, sf_dir)
    swings = pixels.swing(own, "zone", "raw", 3, 9, F.col("ground"), 1).join(own.groupBy("zone").agg(F.count(F.lit(1)).alias("_n")).hint("merge"), "zone").withColumn("ground_share", F.col("ground_pixels") / F.col("_n"))
    streets_ = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("name"), F.col("l_quantity").alias("metres"))
    return zones.best_block(swings, streets_, "zone", 0.3, 100.0).select("zone", F.bround("swing", 6).alias("swing"), "metres", F.size("names").cast("long").alias("names"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a grid 128 pixels wide."""
    o = table(spark, sf_dir, "orders")
    mask = ((F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 32768).cast("int")
    status = F.col("o_orderstatus")
    out = o.select(F.floor(F.col("o_orderkey") / 128).alias("row"), F.pmod("o_orderkey", F.lit(128)).alias("col"), mask.alias("bits"), (status != "P").alias("ground"), F.col("o_totalprice").alias("height"), F.when(status == "P", 1).when(F.col("o_custkey") % 2 == 0, 3).otherwise(2).alias("kind"))
    return out.withColumn("count", F.when(F.col("ground"), b.shaded_hours(F.col("bits")).cast("int")).otherwise(0))


GRID = """g as materialized (select o_orderkey // 128 as row, o_orderkey % 128 as col, cast((o_custkey * 37 + o_orderkey * 11) % 32768 as int) as bits, o_orderstatus <> 'P' as ground, o_totalprice as height, case when o_orderstatus = 'P' then 1 when o_custkey % 2 = 0 then 3 else 2 end as kind from orders),
c as materialized (select *, case when ground then cast(bit_count(bits) as int) else 0 end as count from g)"""
_VOTE = " + ".join(f"case when sum(case when ground then (bits >> {h}) & 1 else 0 end) >= greatest((count(*) filter (ground) + 1) // 2, 1) then {1 << h} else 0 end" for h in range(15))


@query(f"with {GRID} select row // 2 as row, col // 2 as col, cast(case when count(*) filter (ground) >= 2 then {_VOTE} else 0 end as int) as bits, count(*) filter (ground) >= 2 as ground from g group by 1, 2")
def mask_overview(spark, sf_dir):
    return pixels.overview_mask(grid(spark, sf_dir), "bits", "ground")


@query(f'with {GRID} select row // 2 as row, col // 2 as col, cast(case when count(*) filter (count > 0) >= 2 then round_even(avg(case when count > 0 then count end), 0) else 0 end as int) as "count" from c group by 1, 2')
def count_overview(spark, sf_dir):
    return pixels.overview_count(grid(spark, sf_dir), "count")


def _class_sql(source: str) -> str:
    return f"select row // 2 as row, col // 2 as col, case when count(*) filter (kind > 0) < 2 then 0 when count(*) filter (kind > 1) < 2 then 1 when count(*) filter (kind = 3) * 2 >= count(*) filter (kind > 1) then 3 else 2 end as kind from {source} group by 1, 2"


@query(f'with {GRID}, l1 as ({_class_sql("g")}), l2 as ({_class_sql("l1")}), l3 as ({_class_sql("l2")}), l4 as ({_class_sql("l3")}) select 1 as level, row, col, kind as "class" from l1 union all select 2, row, col, kind from l2 union all select 3, row, col, kind from l3 union all select 4, row, col, kind from l4')
def class_pyramid(spark, sf_dir):
    return pixels.class_pyramid(grid(spark, sf_dir), "kind", 4)


@query(f"""with {GRID}, w as (select *, pow(row % 4 - 1.5, 2) + pow(col % 4 - 1.5, 2) as gap from c), a as (select row // 4 as row, col // 4 as col, count(*) filter (ground) * 2 >= count(*) as ground, avg(case when ground then count end) as m from w group by 1, 2),
n as (select row // 4 as row, col // 4 as col, bits, row_number() over (partition by row // 4, col // 4 order by gap, row, col) as r from w)
select a.row, a.col, a.ground, cast(case when ground then greatest(1, round_even(m, 0)) else 0 end as int) as "count", bits from a join n on a.row = n.row and a.col = n.col and r = 1""")
def native_overview(spark, sf_dir):
    out = pixels.native_overview(grid(spark, sf_dir), 4, "count", "bits", "ground")
    return out.withColumn("count", F.col("count").cast("int"))


@query(f"""with {GRID}, f as (select row, col, sum(cast(floor(height) as bigint)) over (partition by row order by col range between 2 preceding and 2 following) as s, count(height) over (partition by row order by col range between 2 preceding and 2 following) as n from g)
select row, col, cast(sum(s) over (partition by col order by row range between 2 preceding and 2 following) as bigint) as total, cast(sum(n) over (partition by col order by row range between 2 preceding and 2 following) as bigint) as n from f""")
def focal_sums(spark, sf_dir):
    return pixels.focal_sums(grid(spark, sf_dir).withColumn("height", F.floor("height")), "height", 2)


@query(f"""with {GRID}, q as (select row * 1000 + col as point_id, row, col, height / 1000 as height, (col % 40)::double as altitude, (row * 37 % 360)::double as azimuth from g where not ground), k as (select point_id, height as h0, tan(radians(altitude)) as sun, step, row + cast(round_even(step * -cos(radians(azimuth)), 0) as bigint) as r, col + cast(round_even(step * sin(radians(azimuth)), 0) as bigint) as c from q, range(1, 6) t(step) where altitude > 0.5),
m as (select point_id, r, c, step, (g.height / 1000 - h0) / (step * 20.0::double) as slope, sun from k join g on g.row = r and g.col = c), x as (select *, row_number() over (partition by point_id order by slope desc, step) as n from m where slope > sun)
select q.point_id, coalesce(x.r, -1) as row, coalesce(x.c, -1) as col, coalesce(x.step * 20.0::double, -1) as distance, round_even(coalesce(degrees(atan(slope)), -1), 6) as apparent from q left join x on q.point_id = x.point_id and n = 1""")
def sun_obstructions(spark, sf_dir):
    own = grid(spark, sf_dir).withColumn("height", F.col("height") / 1000)
    points = own.where("not ground").select((F.col("row") * 1000 + F.col("col")).alias("point_id"), "row", "col", "height", (F.col("col") % 40).cast("double").alias("altitude"), (F.col("row") * 37 % 360).cast("double").alias("azimuth"))
    out = spatial.ray_obstruction(points, own, 20.0, 100.0)
    none = lambda c: F.coalesce(c, F.lit(-1))
    return out.select("point_id", none("row").alias("row"), none("col").alias("col"), none("distance").alias("distance"), F.bround(none("apparent"), 6).alias("apparent"))


@query(f"with {PLACES}, l as (select label, list({{'x': x, 'y': y}} order by vec_id) as v from p where label < 3 group by label), s as (select label, unnest(range(1, len(v))) as i, v from l) select label, count(*) as pieces, round_even(sum(sqrt(pow(v[i + 1].x - v[i].x, 2) + pow(v[i + 1].y - v[i].y, 2))), 3) as metres from s group by label")
def polyline_lengths(spark, sf_dir):
    lines = places(spark, sf_dir).where("label < 3").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("coords"))
    pieces = spatial.line_segments(lines, "label", "coords").withColumn("metres", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return pieces.groupBy("label").agg(F.count(F.lit(1)).alias("pieces"), F.bround(F.sum("metres"), 3).alias("metres"))


@query(f"with {PLACES} select vec_id, floor((x - 3) / 25) * 25 + 0.0 as x0, ceil((y + 4) / 25) * 25 + 0.0 as y1, cast(floor(floor((0 - y) / 25) / 4) as int) as block_row, cast(floor(floor(x / 25) / 4) as int) as block_col from p")
def snapped_boxes(spark, sf_dir):
    x0, _, _, y1 = geo.snapped_bounds(F.col("x") - 3, F.col("y") - 4, F.col("x") + 3, F.col("y") + 4, 25.0)
    row, col = geo.cell(F.col("x"), F.col("y"), 0.0, 0.0, 25.0)
    block = geo.block_key(row, col, 4)
    return places(spark, sf_dir).select("vec_id", x0.alias("x0"), y1.alias("y1"), block[0].alias("block_row"), block[1].alias("block_col"))


# --- names and quality --------------------------------------------------------------------------


@query("""with f as (select *, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', -1) as b, case p_partkey % 4 when 0 then concat('part:', p_name) when 1 then concat('p-', p_partkey) when 2 then p_name else concat('no good:', p_name) end as id from part)
select p_partkey, concat(upper(p_name[1]), substr(p_name, 2)) as title, case when p_partkey % 9 = 0 then concat('street-', substr(sha1('??'), 1, 10)) else replace(p_name, ' ', '-') end as slug, case when p_partkey % 5 < 2 then a else concat(upper(b[1]), substr(b, 2), ' ', a) end as display,
coalesce(case when p_retailprice > 900 and p_retailprice <= 905 then cast(floor(p_retailprice) as int) end, -1) as plausible, case p_partkey % 4 when 0 then concat('part:', sha256(id)) when 1 then id else concat('place:', sha256(id)) end as public_id,
case when contains(lower(p_type), 'eco') then 'cheap' when contains(lower(p_type), 'small') then 'small' else 'other' end as kind, p_partkey % 4 in (0, 3) as safe, case when p_partkey % 4 = 1 then concat('reach:', id, ':400') else concat('reach:', sha256(id), ':400') end as reach from f""")
def part_names(spark, sf_dir):
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    first, second = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    flipped = F.when(F.col("p_partkey") % 5 == 0, first).when(F.col("p_partkey") % 5 == 1, F.concat(first, F.lit(", "))).otherwise(F.concat(first, F.lit(", "), second, F.lit(",x")))
    raw = F.when(k == 0, F.concat(F.lit("part:"), name)).when(k == 1, F.concat(F.lit("p-"), F.col("p_partkey").cast("string"))).when(k == 2, name).otherwise(F.concat(F.lit("no good:"), name))
    link = F.get(F.array(*map(F.lit, ("/data/a?b#c", "/data/../a", "https://u:p@x.org/a", "HTTPS://x.org/a"))), k.cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.capitalised(name).alias("title"), text.slug(F.when(F.col("p_partkey") % 9 == 0, "??").otherwise(name)).alias("slug"), text.display_name(flipped).alias("display"), F.coalesce(text.plausible_int(F.col("p_retailprice"), 900, 905), F.lit(-1)).alias("plausible"),
        text.public_id(raw).alias("public_id"), text.first_rule(F.col("p_type"), (("cheap", ("eco",)), ("small", ("small",))), "other").alias("kind"), text.safe_link(link).alias("safe"), text.reach_id(raw, F.lit(400)).alias("reach"),
    )


@query("""select c_custkey, concat(c_custkey % 300, ' ', lower(c_mktsegment), ' st n') as canonical, concat(case when c_custkey % 300 > 0 then concat(c_custkey % 300, ' ') else '' end, upper(c_mktsegment[1]), lower(substr(c_mktsegment, 2)), ' of the McDonald And Mc Street') as title, c_custkey % 3 = 0 as wheel, case c_custkey % 3 when 0 then 'accessible' when 1 then 'inaccessible' else 'unknown' end as access,
case c_custkey % 5 when 0 then 'seasonal' when 1 then 'construction' when 2 then 'temporary' else 'none' end as closure from customer""")
def customer_addresses(spark, sf_dir):
    number = (F.col("c_custkey") % 300).cast("string")
    flag = F.get(F.array(F.lit(" Yes"), F.lit("no "), F.lit("full")), (F.col("c_custkey") % 3).cast("int"))
    reason = F.get(F.array(F.lit("Closed for the season; repairs"), F.lit("UNDER CONSTRUCTION"), F.lit("repair of roof"), F.lit("closed"), F.lit(None)), (F.col("c_custkey") % 5).cast("int"))
    raw = F.concat(number, F.lit(" "), F.initcap("c_mktsegment"), F.lit(" Street. north, back"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.canonical_address(raw).alias("canonical"), text.title_address(number, F.concat("c_mktsegment", F.lit(" OF the mcdonald and MC street"))).alias("title"), text.truthy(flag).alias("wheel"), text.accessibility(flag).alias("access"), text.closure_category(reason).alias("closure"),
    )


@query("select o_custkey, cast(cast(o_orderdate as date) as varchar) as day, count(*) as n from orders group by all having count(*) > 1")
def duplicate_orders(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("day")), ["o_custkey", "day"])


@query("select c_custkey, nullif(c_mktsegment, 'FURNITURE') as segment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')")
def segment_domain(spark, sf_dir):
    told = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"))
    return checks.outside_domain(told, "segment", ["BUILDING", "MACHINERY"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size <= 25) and l_quantity = 50")
def unknown_parts(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size <= 25")
    return checks.dangling(table(spark, sf_dir, "lineitem").where("l_quantity = 50"), "l_partkey", known, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 10 and l_returnflag = 'R')")
def unused_parts(spark, sf_dir):
    return checks.dangling(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "lineitem").where("l_quantity > 10 and l_returnflag = 'R'"), "l_partkey").select("p_partkey")


@query("select lower(p_type) as public, count(distinct p_brand) as n from part group by 1 having count(distinct p_brand) > 1")
def public_collisions(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(text.slug(F.col("p_type")).alias("public"), F.col("p_brand").alias("private"))
    return checks.collisions(own, "public", "private")


@query("select l_returnflag, count(*) as n from lineitem where bit_count(cast((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 32768 as int)) <> l_linenumber group by l_returnflag")
def mask_violations(spark, sf_dir):
    mask = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 31) % 32768).cast("int")
    bad = checks.bad_masks(table(spark, sf_dir, "lineitem").withColumn("bits", mask), "bits", "l_linenumber")
    return bad.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, count(*) as n from lineitem where (l_returnflag = 'A' and l_quantity > 45) or (l_returnflag = 'N' and l_quantity > 48) group by l_returnflag")
def quantity_limits(spark, sf_dir):
    return checks.above_limit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", {"A": 45.0, "N": 48.0}).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, cast(p_size * 50 as double) as computed from part where abs(p_size * 50 - p_retailprice) > p_retailprice * 0.25 and p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
def length_mismatches(spark, sf_dir):
    reviewed = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return checks.length_mismatch(table(spark, sf_dir, "part"), "p_retailprice", (F.col("p_size") * 50).cast("double"), 0.25, reviewed, "p_partkey").select("p_partkey", "computed")


@query(r"select distinct page_id, leaked from (select page_id, unnest(list_distinct(list_concat([url], regexp_extract_all(url, '/([0-9]+)', 1)))) as leaked from pages where url is not null) where leaked in (select cast(conv_id as varchar) from conversations)")
def leaked_ids(spark, sf_dir):
    return checks.leaks(table(spark, sf_dir, "pages"), "url", "/([0-9]+)", table(spark, sf_dir, "conversations"), "conv_id").select("page_id", "leaked")


@query("""with a as (select c_nationkey as k, round(avg(c_acctbal), 2) as v from customer group by 1), e as (select s_nationkey as k, round(avg(s_acctbal), 2) as expected from supplier group by 1) select e.k from e left join a using (k) where v is null or abs(v - expected) > 500""")
def missed_anchors(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 2).alias("v"))
    anchors = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("expected"))
    return checks.missed_anchors(own, "k", "v", anchors, 500).select("k")


@query(r"""with t as (select p_partkey, case when p_partkey % 11 = 0 then '{broken' else concat('{"place":"', p_name, '","note":"see Trip-Key = ', p_partkey % 300, ', or trip_ids:''', p_partkey % 170, '''","rows":[{"', case when p_partkey % 5 = 0 then 'Raw_Trip.IDs' else 'stop' end, '":"', p_partkey % 250, '"},[["', p_partkey * 7 % 500, '"]]],"n":', p_partkey % 100, '}') end as j from part),
e as materialized (select p_partkey, key, case when type = 'VARCHAR' then atom ->> '$' end as leaf from (select * from t where json_valid(j)) t, json_tree(t.j)), r as (select distinct cast(user_id as varchar) as id from events),
f as (select p_partkey, 'value' as kind, leaf as leaked from e where leaf is not null union select p_partkey, 'marker', unnest(regexp_extract_all(leaf, '\btrip[_.-]?(?:id|key|identifier)s?\s*[:=]\s*["'']?([^"''\s,;&?#}\])]+)', 1, 'i')) from e where leaf is not null)
select p_partkey, kind, leaked from f where leaked in (select id from r) union select p_partkey, 'key', key from e where regexp_matches(lower(regexp_replace(key, '[^A-Za-z0-9]', '', 'g')), '(tripid|tripkey|tripidentifier)s?$') union select p_partkey, 'unreadable', null from t where not json_valid(j)""")
def nested_leaks(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "Raw_Trip.IDs").otherwise("stop")
    parts = [F.lit('{"place":"'), F.col("p_name"), F.lit('","note":"see Trip-Key = '), k % 300, F.lit(", or trip_ids:'"), k % 170, F.lit("'\",\"rows\":[{\""), name, F.lit('":"'), k % 250, F.lit('"},[["'), k * 7 % 500, F.lit('"]]],"n":'), k % 100, F.lit("}")]
    docs = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 == 0, "{broken").otherwise(F.concat(*[c.cast("string") for c in parts])).alias("j"))
    return checks.nested_leaks(docs, "p_partkey", "j", table(spark, sf_dir, "events"), "user_id")
