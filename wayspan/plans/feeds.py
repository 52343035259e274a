"""Queries on transit feeds, ways and sources of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions import ways
from wayspan.operators import feeds, sources, temporal
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


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables as one feed: orders are trips, suppliers stops, lines stop times, regions services."""
    text = lambda c: F.col(c).cast("string")
    s, one = F.col("s_suppkey"), F.lit("f").alias("feed_id")
    kind = s % 5
    parent = F.when(kind.isin(1, 2), (s - kind).cast("string")).when(kind == 3, "elsewhere").otherwise("")
    stops = table(spark, sf_dir, "supplier").select(one, text("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), (s * 0.5).cast("string").alias("stop_lon"), text("s_nationkey").alias("stop_lat"), F.when(kind == 0, "1").otherwise("0").alias("location_type"), parent.alias("parent_station"))
    trips = table(spark, sf_dir, "orders").select(one, F.col("o_orderpriority").alias("route_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("service_id"), text("o_orderkey").alias("trip_id"))
    clock = F.format_string("%d:%02d:%02d", (F.col("l_partkey") * 7 % 30).cast("int"), (F.col("l_linenumber") * 7 % 60).cast("int"), (F.col("l_suppkey") % 60).cast("int"))
    departs, arrives = F.when(F.col("l_linenumber").isin(2, 3), " ").otherwise(clock), F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(clock)
    times = table(spark, sf_dir, "lineitem").select(one, text("l_orderkey").alias("trip_id"), arrives.alias("arrival_time"), departs.alias("departure_time"), text("l_suppkey").alias("stop_id"), text("l_linenumber").alias("stop_sequence"))
    return {"stops": stops, "trips": trips, "stop_times": times}


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    flags = [F.when((F.col("r_regionkey") + i) % 2 == 0, "1").otherwise("0").alias(d) for i, d in enumerate(temporal.WEEKDAYS)]
    day = lambda d: F.lit(d).cast("date")
    calendar = r.select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("service_id"), *flags, day("2024-01-01").alias("start_date"), day("2024-01-11").alias("end_date"))
    exceptions = spark.createDataFrame([("S1", "2024-01-12", "1"), ("S0", "2024-01-10", "2")], "service_id string, date string, exception_type string").withColumn("date", F.to_date("date"))
    dates = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).where(F.col("date").between(day("2024-01-10"), day("2024-01-12"))).distinct()
    return temporal.active_services(calendar, exceptions, dates)


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([(0, 720), (1, 1230), (2, 1470)], "window_id int, minute int")
    return feeds.stop_events(feed(spark, sf_dir), services(spark, sf_dir), windows, 15)


FEED_SQL = """d as (select distinct cast(ts as date) as date from events where cast(ts as date) between date '2024-01-10' and date '2024-01-12'),
a as (select date, r_regionkey as k from region, d where (r_regionkey + isodow(date) - 1) % 2 = 0 and date <= date '2024-01-11' and not (r_regionkey = 0 and date = date '2024-01-10') union select date, 1 from d where date = date '2024-01-12'),
t as (select date, o_orderkey as trip, o_orderpriority as route from orders join a on o_custkey % 5 = k),
s as (select s_suppkey as stop, s_name as name, s_suppkey * 0.5 as lon, s_nationkey as lat, case when s_suppkey % 5 in (1, 2) then cast(s_suppkey - s_suppkey % 5 as varchar) when s_suppkey % 5 = 3 then 'elsewhere' else '' end as parent from supplier),
w as (select * from (values (0, 720), (1, 1230), (2, 1470)) v(window_id, minute)),
e as materialized (select date, window_id, trip, route, l_suppkey as stop, sec from (select l_orderkey, l_suppkey, (l_partkey * 7 % 30) * 3600 + (l_linenumber * 7 % 60) * 60 + l_suppkey % 60 as sec from lineitem where l_linenumber <> 3) join w on abs(sec - minute * 60) <= 900 join t on t.trip = l_orderkey)"""


@query(f"""with {FEED_SQL} select cast(date as varchar) as date, window_id, cast(s.stop as varchar) as stop_id, coalesce(p.name, '') as station, count(*) as events, count(distinct trip) as trips, count(distinct route) as routes, cast(min(sec // 60) as int) as first_minute
from e join s on e.stop = s.stop left join s p on cast(p.stop as varchar) = s.parent and p.stop % 5 = 0 group by all""")
def feed_events(spark, sf_dir):
    counts = [F.count(F.lit(1)).alias("events"), F.countDistinct("trip_id").alias("trips"), F.countDistinct("route_id").alias("routes"), F.min("event_minute").alias("first_minute")]
    return feed_rows(spark, sf_dir).groupBy(F.col("date").cast("string").alias("date"), "window_id", "stop_id", F.col("parent_station_name").alias("station")).agg(*counts)


@query(f"""with {FEED_SQL}, k as (select distinct window_id, case when s.parent <> '' then s.parent else cast(s.stop as varchar) end as key from e join s on e.stop = s.stop),
o as (select window_id, case when s.parent <> '' then s.parent else cast(s.stop as varchar) end as key, min(s.stop) as child from (select distinct window_id, stop from e) x join s on x.stop = s.stop group by all)
select k.window_id, k.key as stop_id, coalesce(p.name, c.name) as name, round_even(coalesce(p.lon, c.lon), 3) as lon from k join o on k.window_id = o.window_id and k.key = o.key left join s p on cast(p.stop as varchar) = k.key
left join (select cast(stop as varchar) as id, * from s) c on c.id = (select min(cast(x.stop as varchar)) from (select distinct window_id, stop from e) x join s y on x.stop = y.stop where x.window_id = k.window_id and case when y.parent <> '' then y.parent else cast(y.stop as varchar) end = k.key)""")
def feed_stops(spark, sf_dir):
    out = feeds.collapsed_stops(feed_rows(spark, sf_dir), feed(spark, sf_dir)["stops"], ["window_id"])
    return out.select("window_id", "stop_id", "name", F.bround("lon", 3).alias("lon"))


@query(f"with {FEED_SQL} select cast(date as varchar) as date, window_id, trip as trip_id, cast(sec // 60 as int) as event_minute, cast(stop as varchar) as stop_id from e where stop in (select stop from s) and route = '1-URGENT'")
def ordered_events(spark, sf_dir):
    out = feeds.in_trip_order(feed_rows(spark, sf_dir).where("route_id = '1-URGENT'"))
    return out.select(F.col("date").cast("string").alias("date"), "window_id", F.col("trip_id").cast("long").alias("trip_id"), "event_minute", "stop_id")


# --- ways and sources ---------------------------------------------------------------------------


@query("""with t as (select p_partkey, case p_size % 8 when 0 then 'motorway_link' when 1 then 'trunk' when 2 then 'service' when 3 then null else 'residential' end as highway, case p_partkey % 6 when 0 then 'private' when 1 then 'no' end as access, case p_partkey % 4 when 0 then 'yes' when 1 then 'no' end as foot,
case p_partkey % 5 when 0 then 'yard' when 1 then 'main' end as service, case p_partkey % 3 when 0 then 'river' else 'canal' end as waterway, case p_size % 5 when 0 then 'culvert' when 1 then 'no' end as tunnel, case p_size % 7 when 0 then 'underground' end as location, case when p_partkey % 9 > 0 then p_name else ' ' end as name from part)
select rail, water, street, buried, walkable, count(*) as n from (select case when service = 'yard' then 'spur' else 'rail' end as rail, case when waterway = 'river' then 'river' else 'stream' end as water, case when starts_with(highway, 'motorway') or starts_with(highway, 'trunk') then 'motorway' else 'major' end as street,
coalesce(tunnel = 'culvert', false) or coalesce(location = 'underground', false) as buried, trim(name) <> '' and highway is not null and highway not in ('motorway_link', 'service') and not coalesce(foot = 'no', false) and not (access is not null and not coalesce(foot = 'yes', false)) as walkable from t) group by all""")
def way_kinds(spark, sf_dir):
    pick = lambda c, n, *names: F.get(F.array(*map(F.lit, names)), (F.col(c) % n).cast("int"))
    none = None
    tags = {
        "highway": pick("p_size", 8, "motorway_link", "trunk", "service", none, *["residential"] * 4), "access": pick("p_partkey", 6, "private", "no"), "foot": pick("p_partkey", 4, "yes", "no"), "service": pick("p_partkey", 5, "yard", "main"),
        "waterway": pick("p_partkey", 3, "river", "canal", "canal"), "tunnel": pick("p_size", 5, "culvert", "no"), "location": pick("p_size", 7, "underground"), "name": F.when(F.col("p_partkey") % 9 > 0, F.col("p_name")).otherwise(" "),
    }
    t = table(spark, sf_dir, "part").select(F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("t"))
    c = F.col("t")
    return t.groupBy(ways.rail_tier(c).alias("rail"), ways.water_tier(c).alias("water"), ways.street_tier(c).alias("street"), ways.buried(c).alias("buried"), ways.walkable(c).alias("walkable")).agg(F.count(F.lit(1)).alias("n"))


@query("""select concat('parks:', s_suppkey) as place_id, s_name as name, 'unrestricted' as access_condition, case when s_suppkey % 3 = 0 then 'seasonal' else 'none' end as closure_category, case when s_suppkey % 2 = 0 then 'true' else 'unknown' end as accessible, s_suppkey % 4 = 0 as temporarily_closed, 1::bigint as record_count from supplier
union all select concat('ttc:', n_nationkey), n_name, 'fare_paid', 'none', 'true', false, c from nation join (select c_nationkey, count(*) as c from customer group by 1) on c_nationkey = n_nationkey""")
def all_places(spark, sf_dir):
    s, flag = table(spark, sf_dir, "supplier"), F.when(F.col("s_suppkey") % 2 == 0, "Yes").otherwise("none")
    parks = ways.as_places(s, "parks", {"place_id": F.col("s_suppkey"), "name": F.col("s_name"), "lon": F.lit(0.0), "lat": F.lit(0.0), "accessible": ways.tri_state(flag, ("yes",)), "reason": F.when(F.col("s_suppkey") % 3 == 0, "Closed for the season"), "temporarily_closed": F.col("s_suppkey") % 4 == 0})
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    stations = table(spark, sf_dir, "nation").join(groups.hint("merge"), F.col("c_nationkey") == F.col("n_nationkey"))
    transit = ways.as_places(stations, "ttc", {"place_id": F.col("n_nationkey"), "name": F.col("n_name"), "lon": F.lit(0.0), "lat": F.lit(0.0), "accessible": F.lit(True), "record_count": F.col("c")})
    return ways.all_places(parks, transit).select("place_id", "name", "access_condition", "closure_category", F.coalesce(F.col("accessible").cast("string"), F.lit("unknown")).alias("accessible"), "temporarily_closed", "record_count")


@query("select c_name as name, c_mktsegment as class from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal between -500 and 3000 and c_nationkey between 2 and 11 and (c_custkey % 10 > 0 or c_nationkey + 1 between 2 and 11)")
def layers(spark, sf_dir):
    box = (-500.0, 2.0, 3000.0, 11.0)
    c = table(spark, sf_dir, "customer")
    point = lambda lat: F.struct(F.col("c_acctbal").alias("lon"), lat.cast("double").alias("lat"))
    lines = c.withColumn("coords", F.when(F.col("c_custkey") % 10 > 0, F.array(point(F.col("c_nationkey")))).otherwise(F.array(point(F.col("c_nationkey") + 1))))
    inside = ways.with_geometry(lines, "coords").where(ways.touches_box(F.col("coords"), box) & ways.within_box(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), box))
    return ways.layer(inside, {"c_name": "name", "c_mktsegment": "class"}, "c_mktsegment", ["BUILDING", "MACHINERY"])


def published_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as six published sources (suppliers are parks, customers buildings, nations the others), as places."""
    text = lambda c: c.cast("string")
    point = lambda x: F.concat(F.lit('{"type":"Point","coordinates":['), text(x), F.lit(",43.5]}"))
    s, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    supplier, customer, nation = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    none = F.lit(None).cast("string")
    parks = supplier.select(
        text(s).alias("id"), F.when(s % 3 == 0, F.concat(F.lit("A"), text(s))).alias("asset_id"), F.col("s_name").alias("location"), F.when(s % 4 == 0, "Alt").otherwise("").alias("alternative_name"), F.concat(F.lit(" "), "s_name").alias("address"),
        F.when(s % 2 == 0, "Centre hours").otherwise("9 a.m. to 5 p.m.").alias("hours"), F.when(s % 5 == 0, "None").when(s % 5 == 1, "ramp").alias("accessible"), point(s).alias("geometry"), F.when(s % 6 == 0, "Closed for the season").otherwise("None").alias("Reason"),
        F.when(s % 7 == 0, "repair").alias("Comments"), F.when(s % 8 == 0, "All-Gender").alias("type"), text(s % 3).alias("Status"), none.alias("url"),
    )
    days = [F.lit("8 a.m." if (code, e) == ("mo", "o") else "4 p.m." if code == "mo" else "Closed").alias(f"oh{code}{e}") for code, _ in sources.DAY_CODES for e in "oc"]
    hours = supplier.where(s % 4 < 3).select(text(s).alias("id"), *days)
    libraries = nation.select(text(n % 2).alias("PublicWashroom"), text(n).alias("BranchCode"), F.col("n_name").alias("BranchName"), F.lit("a").alias("Address"), point(n).alias("geometry"), F.lit("9-5").alias("Hours"), none.alias("Website"))
    museums = nation.select(n.alias("number"), F.when(n % 3 == 0, "Yes").otherwise("No").alias("Washroom?"), F.col("n_name").alias("Museums and Cultural Centres"), none.alias("Address"), none.alias("Hours"), F.when(n % 2 == 0, "No").alias("Accessible?"), F.when(n % 4 == 0, "yes").alias("Gender Inclusive?"), F.when(n % 5 == 0, "under construction").alias("Notes"))
    automated = nation.select(text(n).alias("ID"), text(n).alias("ADDRESSNUMBERTEXT"), F.when(n % 2 == 0, "King St").alias("ADDRESSSTREET"), F.when(n % 3 == 0, "Existing").otherwise("Planned work").alias("STATUS"), point(n).alias("geometry"))
    buildings = customer.select(c.alias("number"), F.when(c % 9 > 0, "Open - Public Access").otherwise("Closed").alias("Washroom Status"), F.when(c % 4 > 0, text(c % 50)).otherwise("N/A").alias("FLOC_ID"), F.col("c_mktsegment").alias("Building Description"), text(F.col("c_nationkey")).alias("Address"), text(c % 3).alias("Hours Available"), F.when(c % 10 == 0, "Yes").alias("Accessible Washroom"), F.when(c % 11 == 0, "YES").alias("Gender Inclusive"), point(c).alias("geometry"))
    stations = customer.select(c.alias("number"), F.concat(F.lit("Stop "), text(F.col("c_nationkey"))).alias("station"), F.concat(F.lit("u"), text(c)).alias("source_url"))
    stops = nation.select(text(n).alias("stop_id"), F.concat(F.lit("Stop "), text(n)).alias("stop_name"), text(n).alias("stop_lon"), F.lit("43").alias("stop_lat"), F.lit("1").alias("location_type"))
    points = nation.select(F.col("n_name").alias("name"), point(n).alias("geometry"))
    return ways.all_places(sources.park_places(parks, hours, "p"), sources.library_places(libraries), sources.museum_places(museums, points, "m"), sources.automated_places(automated, "a"), sources.building_places(buildings, "b"), sources.station_places(stations, stops))


@query("""with b as (select c_custkey as c, case when c_custkey % 4 > 0 then cast(c_custkey % 50 as varchar) else concat(c_mktsegment, '|', c_nationkey) end as k, * from customer where c_custkey % 9 > 0),
p as (select concat('parks:', case when s_suppkey % 3 = 0 then concat('A', s_suppkey) else cast(s_suppkey as varchar) end) as place_id, case when s_suppkey % 4 = 0 then 'Alt' else s_name end as name, s_suppkey::double as lon,
case when s_suppkey % 2 = 1 then '9 a.m. to 5 p.m.' when s_suppkey % 4 < 3 then 'Mon 8 a.m. to 4 p.m.; Tue Closed; Wed Closed; Thu Closed; Fri Closed; Sat Closed; Sun Closed' else 'Centre hours' end as hours_raw, case when s_suppkey % 5 = 1 then 'true' else '' end as accessible, case when s_suppkey % 8 = 0 then 'true' else '' end as all_gender,
case when s_suppkey % 6 = 0 then 'seasonal' when s_suppkey % 7 = 0 then 'temporary' else 'none' end as closure_category, s_suppkey % 3 = 0 as temporarily_closed, s_suppkey % 3 = 2 as partial_service, 1 as record_count, concat(case when s_suppkey % 6 = 0 then 'Closed for the season' else '' end, case when s_suppkey % 42 = 0 then '; ' else '' end, case when s_suppkey % 7 = 0 then 'repair' else '' end) as notes from supplier)
select * from p union all select concat('library:', n_nationkey), concat(n_name, ' library'), n_nationkey, '9-5', '', '', 'none', false, false, 1, '' from nation where n_nationkey % 2 = 1
union all select concat('museum:', n_nationkey), n_name, n_nationkey, '', case when n_nationkey % 2 = 0 then 'false' else '' end, case when n_nationkey % 4 = 0 then 'true' else 'false' end, case when n_nationkey % 5 = 0 then 'construction' else 'none' end, false, false, 1, case when n_nationkey % 5 = 0 then 'under construction' else '' end from nation where n_nationkey % 3 = 0
union all select concat('automated:', n_nationkey), concat('Automated public washroom at ', n_nationkey, case when n_nationkey % 2 = 0 then ' King St' else '' end), n_nationkey, 'Seasonal Apr-Oct; daily hours not published', 'true', '', case when n_nationkey % 3 = 0 then 'none' else 'temporary' end, n_nationkey % 3 > 0, false, 1, 'Barrier-free and seasonal. Exact daily hours are not published.' from nation
union all select concat('crem:', k), arg_min(c_mktsegment, c), min(c), case when count(distinct c % 3) = 1 then cast(any_value(c % 3) as varchar) else '' end, cast(bool_or(c % 10 = 0) as varchar), cast(bool_or(c % 11 = 0) as varchar), 'none', false, false, count(*), '' from b group by k
union all select concat('ttc:stop-', c_nationkey), concat('Stop ', c_nationkey, ' station'), c_nationkey, 'Mon-Sat 6 a.m. to 2 a.m.; Sun 8 a.m. to 2 a.m.', 'true', '', 'none', false, false, count(*), 'Located in the fare-paid area.' from customer group by c_nationkey""")
def source_places(spark, sf_dir):
    flag = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return published_sources(spark, sf_dir).select("place_id", "name", "lon", "hours_raw", flag("accessible"), flag("all_gender"), "closure_category", "temporarily_closed", "partial_service", "record_count", "notes")
