"""Queries on schedules, events, coverage and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.functions import text
from wayspan.operators import graph, metrics, reviews, serve, temporal, whatif
from wayspan.streaming.events import clean_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stop events: user is the trip, type the route, props.k the stop."""
    e = table(spark, sf_dir, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    return e.select("event_id", minute.alias("minute"), F.col("user_id").alias("trip"), F.col("event_type").alias("route"), F.get_json_object("props", "$.k").cast("int").alias("stop_id"))


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 720), (1, 1230), (2, 1320), (3, 30)], "window_id int, centre int")


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.events_in_windows(stop_events(spark, sf_dir), windows(spark), "minute", 15)


EVENTS_SQL = """e as (select event_id, hour(ts) * 60 + minute(ts) as minute, user_id as trip, event_type as route, cast(json_extract_string(props, '$.k') as int) as stop_id from events),
w as (select * from (values (0, 720), (1, 1230), (2, 1320), (3, 30)) t(window_id, centre)),
m as (select e.*, window_id from e join w on abs(minute - centre) <= 15)"""


@query(f"with {EVENTS_SQL} select window_id, count(distinct trip) as trips, count(distinct route) as routes, count(distinct stop_id) as stops, count(*) as events from m group by window_id")
def window_activity(spark, sf_dir):
    return metrics.activity(windowed(spark, sf_dir), ["window_id"], "trip", "route", "stop_id")


@query(f"with {EVENTS_SQL} select route, count(distinct (window_id, trip)) as trips, count(distinct route) as routes, count(distinct stop_id) as stops, count(*) as events from m where window_id < 2 group by route")
def combined_activity(spark, sf_dir):
    return metrics.activity(windowed(spark, sf_dir).where("window_id < 2"), ["route"], "trip", "route", "stop_id", "window_id")


@query(f"with {EVENTS_SQL} select stop_id, arg_min(trip, event_id) as trip, arg_min(minute, event_id) as minute, count(*) as n_events, count(distinct trip) as n_trips from m group by stop_id")
def active_stop_rows(spark, sf_dir):
    counts = {"n_events": F.count(F.lit(1)), "n_trips": F.countDistinct("trip")}
    return metrics.first_by(windowed(spark, sf_dir), ["stop_id"], ["event_id"], ["trip", "minute"], counts)


@query("""with d as (select distinct cast(ts as date) as date from events),
c as (select n_name as service_id, n_nationkey as k, date '2024-01-01' + n_nationkey as a, date '2024-01-01' + n_nationkey + 60 as b from nation),
r as (select d.date, service_id from c, d where (k + isodow(d.date) - 1) % 3 = 0 and d.date between a and b),
x as (select date '2024-01-10' + r_regionkey as date, concat('NATION_', r_regionkey) as service_id from region),
y as (select date '2024-01-08' + r_regionkey as date, concat('NATION_', r_regionkey + 5) as service_id from region)
select cast(date as varchar) as date, service_id from (select * from r union select x.* from x join d using (date)) u where not exists (select 1 from y where y.date = u.date and y.service_id = u.service_id)""")
def service_days(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    flags = [F.when((F.col("n_nationkey") + i) % 3 == 0, "1").otherwise("0").alias(d) for i, d in enumerate(temporal.WEEKDAYS)]
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey"))
    calendar = n.select(F.col("n_name").alias("service_id"), *flags, start.alias("start_date"), F.date_add(start, 60).alias("end_date"))
    r = table(spark, sf_dir, "region")
    row = lambda day, shift, kind: r.select(F.concat(F.lit("NATION_"), F.col("r_regionkey") + shift).alias("service_id"), F.date_add(F.lit(day).cast("date"), F.col("r_regionkey")).alias("date"), F.lit(kind).alias("exception_type"))
    dates = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    out = temporal.active_services(calendar, row("2024-01-10", 0, "1").union(row("2024-01-08", 5, "2")), dates)
    return out.select(F.col("date").cast("string").alias("date"), "service_id")


def supplier_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places with one of twelve kinds of hours, known and unknown ones."""
    h = (F.col("s_suppkey") % 4 + 6).cast("string")
    kinds = [
        F.concat(F.lit("Mon-Fri "), h, F.lit(" a.m. to 5 p.m.; Sat & holidays 10am-4pm")), F.concat(h, F.lit("am-8pm & 9pm-11pm")), F.lit("fri-mon 6pm-2am"), F.lit("Closed"), F.lit("by appointment"),
        F.lit("weekends 10am until 4pm, mon closed"), F.lit("daily 9am-5pm"), F.lit("weekdays 9am-5pm"), F.lit("View hours online"), F.lit("mon & wed 9am-5pm"), F.lit("Sunday: 12pm-12am"), F.lit("mon-friday 9am-5pm"),
    ]
    text = F.get(F.array(*kinds), (F.col("s_suppkey") % 12).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), text.alias("hours"))


HOURS_SQL = """p as (select s_suppkey as place_id, s_suppkey % 12 as k, s_suppkey % 4 + 6 as h, s_suppkey % 12 not in (4, 6, 7, 8, 9, 11) as known from supplier),
i as (select place_id, d as weekday, h * 60 as a, 1020 as b from p, range(0, 5) t(d) where k = 0 union all select place_id, 5, 600, 960 from p where k = 0
 union all select place_id, d, h * 60, 1200 from p, range(0, 7) t(d) where k = 1 union all select place_id, d, 1260, 1380 from p, range(0, 7) t(d) where k = 1
 union all select place_id, d, 1080, 1560 from p, range(0, 7) t(d) where k = 2 and d in (0, 4, 5, 6) union all select place_id, d, 600, 960 from p, range(5, 7) t(d) where k = 5
 union all select place_id, 6, 720, 1440 from p where k = 10)"""


@query(f"with {HOURS_SQL} select p.place_id, known as hours_known, count(i.a) as intervals, cast(coalesce(sum(b - a), 0) as bigint) as minutes from p left join i on p.place_id = i.place_id group by all")
def weekly_hours(spark, sf_dir):
    own = supplier_hours(spark, sf_dir)
    told = own.join(temporal.weekly_hours(own, "hours").hint("merge"), "hours")
    return told.groupBy("place_id", "hours_known").agg(F.count("start_min").alias("intervals"), F.coalesce(F.sum(F.col("end_min") - F.col("start_min")), F.lit(0)).alias("minutes"))


AVAILABLE_SQL = f"""{HOURS_SQL}, m as (select * from (values (0, 0, 600), (1, 4, 1200), (2, 5, 60), (3, 6, 660)) t(moment_id, weekday, minute)),
o as (select distinct place_id, moment_id from i join m on (i.weekday = m.weekday and minute >= a and minute < least(b, 1440)) or ((i.weekday + 1) % 7 = m.weekday and b > 1440 and minute < b - 1440)),
st as (select p.place_id, m.moment_id, case when p.place_id % 17 = 0 then 'temporarily closed' when not known then 'unknown' when o.place_id is not null then 'open' else 'closed' end as state
from p cross join m left join o on p.place_id = o.place_id and m.moment_id = o.moment_id)"""


def place_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = supplier_hours(spark, sf_dir)
    parsed = own.join(temporal.weekly_hours(own, "hours").hint("merge"), "hours")
    places = parsed.select("place_id", "hours_known", (F.col("place_id") % 17 == 0).alias("temporarily_closed")).distinct()
    moments = spark.createDataFrame([(0, 0, 600), (1, 4, 1200), (2, 5, 60), (3, 6, 660)], "moment_id int, weekday int, minute int")
    return temporal.availability(places, parsed.where("weekday is not null").select("place_id", "weekday", "start_min", "end_min"), moments)


@query(f"with {AVAILABLE_SQL} select moment_id, state, count(*) as places from st group by all")
def availability(spark, sf_dir):
    return place_states(spark, sf_dir).groupBy("moment_id", "state").agg(F.count(F.lit(1)).alias("places"))


@query("""with p as (select s_suppkey, case s_nationkey % 4 when 0 then 'open' when 1 then 'closed' when 2 then 'temporarily closed' else 'unknown' end as raw, case s_suppkey % 4 when 0 then 'seasonal' when 1 then 'construction' when 2 then 'temporary' else 'none' end as closure,
case (s_suppkey // 4) % 3 when 0 then 'open' when 1 then 'closed' else 'unknown' end as planned from supplier),
o as (select *, case raw when 'open' then 'open' when 'closed' then 'scheduled_closed' when 'unknown' then 'unknown_hours' else case closure when 'seasonal' then 'seasonal_closed' when 'construction' then 'construction_closed' else 'temporary_closed' end end as observed from p),
n as (select *, case when mode = 'normal_operations' and observed = 'temporary_closed' then case planned when 'open' then 'open' when 'closed' then 'scheduled_closed' else 'unknown_hours' end else observed end as now
from o, (values ('normal_operations', 'optimistic_information'), ('normal_operations', 'unknown_unavailable'), ('observed', 'optimistic_information'), ('observed', 'unknown_unavailable')) t(mode, info))
select mode, info, observed, case when info = 'optimistic_information' and now = 'unknown_hours' then 'potential_open' else now end as effective, count(*) as places from n group by all""")
def effective_states(spark, sf_dir):
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    raw = pick(("open", "closed", "temporarily closed", "unknown"), F.col("s_nationkey") % 4)
    closure = pick(("seasonal", "construction", "temporary", "none"), F.col("s_suppkey") % 4)
    planned = pick(("open", "closed", "unknown"), F.floor(F.col("s_suppkey") / 4) % 3)
    modes = [(m, i) for m in ("normal_operations", "observed") for i in ("optimistic_information", "unknown_unavailable")]
    told = table(spark, sf_dir, "supplier").select(temporal.state_name(raw, closure).alias("observed"), planned.alias("planned")).crossJoin(F.broadcast(spark.createDataFrame(modes, "mode string, info string")))
    state = temporal.effective_state(F.col("observed"), F.col("planned"), F.col("mode"), F.col("info"))
    return told.groupBy("mode", "info", "observed", state.alias("effective")).agg(F.count(F.lit(1)).alias("places"))


@query("""with s as (select s_suppkey as place_id, case s_suppkey % 5 when 0 then 'closed for the season' when 1 then 'Under construction' when 2 then 'Roof repair' when 3 then 'open as usual' end as reason, s_suppkey % 3 as k from supplier),
c as (select *, case s.place_id % 5 when 0 then 'seasonal' when 1 then 'construction' when 2 then 'temporary' else 'none' end as closure from s),
o as (select place_id, snap, case when k = 1 and snap = 1 then 'closed' when k = 2 and snap = 0 then 'temporarily closed' end as raw, case when k = 1 and snap = 1 then 'closed' when k = 2 and snap = 0 then 'open' end as scheduled from c, range(0, 2) t(snap)),
n as (select c.closure, o.snap, coalesce(o.scheduled, 'unknown') as scheduled, coalesce(raw, o.scheduled, 'unknown') as raw from c join o using (place_id))
select snap as snapshot_id, scheduled, case raw when 'open' then 'open' when 'closed' then 'scheduled_closed' when 'unknown' then 'unknown_hours' else case closure when 'seasonal' then 'seasonal_closed' when 'construction' then 'construction_closed' else 'temporary_closed' end end as observed, count(*) as places from n group by all""")
def snapshot_states(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    reason = F.get(F.array(F.lit("closed for the season"), F.lit("Under construction"), F.lit("Roof repair"), F.lit("open as usual"), F.lit(None)), (F.col("s_suppkey") % 5).cast("int"))
    places = s.select(F.col("s_suppkey").alias("place_id"), text.closure_category(reason).alias("closure_category"))
    kind = F.col("s_suppkey") % 3
    one = s.where(kind == 1).select(F.col("s_suppkey").alias("place_id"), F.lit(1).alias("snapshot_id"), F.lit("closed").alias("scheduled"), F.lit("closed").alias("raw"))
    two = s.where(kind == 2).select(F.col("s_suppkey").alias("place_id"), F.lit(0).alias("snapshot_id"), F.lit("open").alias("scheduled"), F.lit("temporarily closed").alias("raw"))
    states = temporal.facility_states(places, spark.createDataFrame([(0,), (1,)], "snapshot_id int"), one.union(two))
    return states.groupBy("snapshot_id", "scheduled", "observed").agg(F.count(F.lit(1)).alias("places"))


@query("""with d as (select s_suppkey, case s_suppkey % 6 when 0 then '' when 1 then 'Closed' when 2 then 'permits' when 3 then '9am to 12pm and' when 4 then '8am' else '9am' end as o, case s_suppkey % 6 when 2 then 'only' when 3 then '1pm to 5pm' when 4 then 'closed' else '5pm' end as c from supplier)
select s_suppkey, case s_suppkey % 6 when 3 then 'Mon 9am to 12pm & 1pm to 5pm' when 5 then 'Mon 9am to 5pm' else 'Mon Closed' end as hours, case s_suppkey % 6 when 3 then 420 when 5 then 480 else 0 end as minutes from d""")
def opening_pairs(spark, sf_dir):
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 6).cast("int"))
    told = table(spark, sf_dir, "supplier").select("s_suppkey", temporal.hours_text({"Mon": (pick("", "Closed", "permits", "9am to 12pm and", "8am", "9am"), pick("5pm", "5pm", "only", "1pm to 5pm", "closed", "5pm"))}).alias("hours"))
    spans = temporal.weekly_hours(told, "hours").groupBy("hours").agg(F.coalesce(F.sum(F.col("end_min") - F.col("start_min")), F.lit(0)).cast("int").alias("minutes"))
    return told.join(spans.hint("merge"), "hours").select("s_suppkey", "hours", "minutes")


@query("""with f as (select s_suppkey as hour, s_nationkey as altitude from supplier where s_suppkey between 1 and 12) select hour, array_position([9, 3, 6], hour) - 1 as position, altitude > 12.5 as casting from f where hour in (9, 3, 6)""")
def chosen_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "supplier").where("s_suppkey between 1 and 12").select(F.col("s_suppkey").alias("hour"), F.col("s_nationkey").alias("altitude"))
    return temporal.chosen_frames(frames, [9, 3, 6], least=12.5).select("hour", "position", "casting")


@query("""select mode, count(*) as places from (select case when s_suppkey % 4 = 0 then 'fare_paid' else 'unrestricted' end as c, case s_suppkey % 3 when 0 then 'public' when 1 then 'rider_conditional' else 'staff' end as mode from supplier) where (mode = 'public' and c = 'unrestricted') or mode = 'rider_conditional' group by mode""")
def eligible_places(spark, sf_dir):
    source = F.when(F.col("s_suppkey") % 4 == 0, "ttc").otherwise("parks")
    told = table(spark, sf_dir, "supplier").select(text.access_condition(source).alias("access_condition"), F.get(F.array(*map(F.lit, ("public", "rider_conditional", "staff"))), (F.col("s_suppkey") % 3).cast("int")).alias("mode"))
    return temporal.eligible(told, F.col("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("places"))


@query("select event_type, cast(sum(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + case when user_id % 3 = 0 then 86400 else 0 end) as bigint) as seconds from events group by event_type")
def service_seconds(spark, sf_dir):
    hour = F.hour("ts") + F.when(F.col("user_id") % 3 == 0, 24).otherwise(0)
    text = F.format_string("%02d:%02d:%02d", hour, F.minute("ts"), F.second("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(temporal.service_seconds(text)).alias("seconds"))


@query("""with e as (select user_id, event_id, event_type, cast(floor(epoch(ts)) as bigint) as moment from events), t as (select user_id, cast(floor(avg(moment)) as bigint) as target from e group by user_id)
select user_id, target, moment, event_type from (select *, row_number() over (partition by user_id order by abs(moment - target), moment, event_id) as r from e join t using (user_id)) where r = 1""")
def nearest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("moment"), "event_id", "event_type")
    first = e.groupBy("user_id", "moment").agg(F.min_by("event_type", "event_id").alias("event_type"))
    targets = e.groupBy("user_id").agg(F.floor(F.avg("moment")).alias("target"))
    return temporal.nearest_in_time(targets, first, "user_id", "moment", "target")


@query("select event_id, event_type, case when event_type = 'click' or (event_type = 'view' and json_extract_string(props, '$.k') in ('1', '2', '3')) then json_extract_string(props, '$.k') end as k from events where event_type in ('click', 'view')")
def event_whitelist(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("props"))
    out = clean_events(e, {"click": {"k": None}, "view": {"k": ["1", "2", "3"]}}, "event_type")
    return out.select("event_id", "event_type", F.try_element_at("props", F.lit("k")).alias("k"))


# --- graph and coverage -------------------------------------------------------------------------


def supply_edges(spark: SparkSession, sf_dir: str, within: float | None = None) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"), F.col("l_quantity").alias("length"))
    return graph.shortest_edges(item, within)


def supply_distances(spark: SparkSession, sf_dir: str, labels: int | None = 5) -> DataFrame:
    """Distances from the suppliers of the first nations, or of all (None); nations don't meet, so each has the same ones in any number of them."""
    own = F.col("s_nationkey").isNotNull() if labels is None else F.col("s_nationkey") < labels
    sources = table(spark, sf_dir, "supplier").where(own).select(F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("node"), F.lit(0.0).alias("dist"))
    return graph.bounded_distances(supply_edges(spark, sf_dir, 5.0), sources, 5.0)


_HOPS = 5
DIST_SQL = """g as materialized (select l_suppkey as src, l_partkey + 10000000 as dst, min(l_quantity) as length from lineitem group by all),
b as materialized (select src, dst, length from g where length <= 5 union all select dst, src, length from g where length <= 5),
r0 as materialized (select s_nationkey as label, s_suppkey as node, cast(0 as double) as dist from supplier where s_nationkey < 5)""" + "".join(
    f", r{k + 1} as materialized (select label, node, min(dist) as dist from (select * from r{k} union all select label, dst, dist + length from r{k} join b on node = src where dist + length <= 5) group by all)" for k in range(_HOPS)
) + f", d as materialized (select * from r{_HOPS})"
ALL_DIST_SQL = DIST_SQL.replace("s_nationkey < 5", "s_nationkey is not null")


@query(f"with {DIST_SQL} select label, node, dist from d")
def bounded_distance(spark, sf_dir):
    return supply_distances(spark, sf_dir)


@query(f"with {DIST_SQL} select label, count(distinct p_partkey) as stops, min(dist + p_size * 0.05) as nearest from d join part on node = p_partkey + 10000000 where dist + p_size * 0.05 <= 5 group by label")
def covered_stops(spark, sf_dir):
    stops = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stop_id"), (F.col("p_partkey") + 10_000_000).alias("node"), (F.col("p_size") * F.lit(0.05)).alias("offset"))
    return graph.covered(supply_distances(spark, sf_dir), stops, 5.0).groupBy("label").agg(F.count(F.lit(1)).alias("stops"), F.min("dist").alias("nearest"))


@query(f"""with {ALL_DIST_SQL}, a as (select label, src, dst, length, least(1, greatest(0, (4 - dist) / length)) as fa from g join d on src = node),
z as (select label, src, dst, length, least(1, greatest(0, (4 - dist) / length)) as fb from g join d on dst = node),
f as (select coalesce(a.label, z.label) as label, coalesce(fa, 0) as fa, coalesce(fb, 0) as fb from a full join z on a.label = z.label and a.src = z.src and a.dst = z.dst)
select label, cast(sum(case when fa + fb >= 1 then 1 else (fa > 0)::int + (fb > 0)::int end) as bigint) as pieces, round_even(sum(case when fa + fb >= 1 then 1 else fa + fb end), 4) as covered from f where fa + fb > 0 group by label""")
def reachable_edges(spark, sf_dir):
    parts = graph.edge_reach(supply_edges(spark, sf_dir), supply_distances(spark, sf_dir, None), 4.0)
    return parts.groupBy("label").agg(F.count(F.lit(1)).alias("pieces"), F.bround(F.sum(F.col("to_share") - F.col("from_share")), 4).alias("covered"))


@query(f"with {DIST_SQL} select count(*) as edges, cast(sum(length) as bigint) as total from g where src in (select node from d) and dst in (select node from d)")
def edges_inside(spark, sf_dir):
    inside = graph.edges_inside(supply_edges(spark, sf_dir), supply_distances(spark, sf_dir))
    return inside.agg(F.count(F.lit(1)).alias("edges"), F.sum("length").cast("long").alias("total"))


def _footprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as sources: their suppliers reach the stop of their number, at an offset and a distance of 0 to 9."""
    events = windowed(spark, sf_dir).select(F.col("window_id").alias("snapshot_id"), "stop_id", "trip", "route")
    s = table(spark, sf_dir, "supplier")
    distances = s.select(F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 7).cast("double").alias("dist"))
    offsets = s.select(F.col("s_nationkey").alias("source_id"), (F.col("s_nationkey") % 3).cast("double").alias("offset")).distinct()
    stops = s.select((F.col("s_suppkey") % 100).cast("int").alias("stop_id"), F.col("s_suppkey").alias("node"), F.lit(1.0).alias("offset"))
    return whatif.footprint(distances, offsets, stops, events, 8.0), events


FOOTPRINT_SQL = f"{EVENTS_SQL}, n as (select distinct s_nationkey as source_id, s_suppkey % 100 as stop_id from supplier where s_suppkey % 7 + s_nationkey % 3 + 1 <= 8)"


@query(f"""with {FOOTPRINT_SQL},
f as (select source_id, m.*, m.stop_id in (select stop_id from n where source_id < 3) as had from n join m on n.stop_id = m.stop_id)
select source_id, count(distinct (window_id, trip)) filter (not had) as new_trips, count(distinct route) filter (not had) as new_routes, count(distinct stop_id) filter (not had) as new_stops, count(distinct window_id) filter (not had) as snapshots_gained,
count(distinct (window_id, trip)) as trips, count(distinct route) as routes, count(distinct stop_id) as stops from f group by source_id""")
def coverage_gain(spark, sf_dir):
    footprints, events = _footprints(spark, sf_dir)
    return whatif.coverage_gain(footprints, footprints.where("source_id < 3").select("snapshot_id", "stop_id"), events)


_GREEDY = """recursive e as materialized (select distinct o_custkey as candidate_id, cast(o_orderdate as date) as effect from orders), z as materialized (select candidate_id, count(*) as n from e group by 1),
r as materialized (select candidate_id, n, row_number() over (order by n desc, candidate_id) as rank from z),
v as materialized (select a.candidate_id, list(b.candidate_id) as rivals from (select x.candidate_id, y.candidate_id as rival from e x join e y on x.effect = y.effect join r p on p.candidate_id = x.candidate_id join r q on q.candidate_id = y.candidate_id where q.rank < p.rank group by all having count(*) >= 0.8 * any_value(p.n)) a join r b on b.candidate_id = a.rival group by 1),
t as materialized (select r.rank, r.candidate_id, coalesce(v.rivals, []) as rivals from r left join v using (candidate_id)),
g(rank, candidate_id, kept, every) as (select 0::bigint, 0::bigint, false, []::bigint[] union all select t.rank, t.candidate_id, not list_has_any(t.rivals, every), case when list_has_any(t.rivals, every) then every else list_append(every, t.candidate_id) end from g join t on t.rank = g.rank + 1)"""


@query(f"with {_GREEDY} select candidate_id, kept from g where rank > 0")
def greedy_candidates(spark, sf_dir):
    effects = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), F.to_date("o_orderdate").alias("effect"))
    ranks = effects.distinct().groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranks.select("candidate_id", F.struct(-F.col("n"), F.col("candidate_id")).alias("rank"))
    return whatif.greedy_distinct(effects, ranked)


@query("select o_custkey from orders group by o_custkey having bool_and(o_orderstatus = 'F')")
def always_closed(spark, sf_dir):
    return whatif.always(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F")


@query("""with c as (select o_custkey, count(*) as n, count(distinct o_orderstatus) as kinds, count(distinct o_orderpriority) as levels, count(distinct month(o_orderdate)) as months from orders group by o_custkey)
select * from (select c_mktsegment, c_custkey, n, row_number() over (partition by c_mktsegment order by kinds desc, n desc, levels desc, months desc, lower(c_name), c_name, c_custkey) as rank from c join customer on c_custkey = o_custkey) where rank <= 10""")
def ranked_candidates(spark, sf_dir):
    counts = {"n": F.count(F.lit(1)), "kinds": F.countDistinct("o_orderstatus"), "levels": F.countDistinct("o_orderpriority"), "months": F.countDistinct(F.month("o_orderdate"))}
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[v.alias(k) for k, v in counts.items()])
    told = c.join(table(spark, sf_dir, "customer"), "c_custkey")
    order = [*[F.col(k).desc() for k in ("kinds", "n", "levels", "months")], F.lower("c_name"), F.col("c_name"), F.col("c_custkey")]
    return metrics.top_per_group(told, ["c_mktsegment"], order, 10).select("c_mktsegment", "c_custkey", "n", "rank")


@query("""with c as (select c_nationkey, o_orderpriority, count(*) as n from orders join customer on c_custkey = o_custkey group by all),
r as (select *, case when c_nationkey % 6 > 0 or o_orderpriority <> '5-LOW' then row_number() over (partition by o_orderpriority order by n desc, c_nationkey) end as rank from c),
s as (select c_nationkey, count(*) filter (rank <= 10) as within, count(rank) as applicable, min(case when o_orderpriority = '1-URGENT' then rank end) as first from r group by c_nationkey)
select c_nationkey, within, applicable, case when first is null or first > 10 then 'not prioritized' when within >= 5 then 'robust' when within >= 3 then 'mostly robust' else 'sensitive' end as stability from s""")
def rank_stability(spark, sf_dir):
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    ranked = metrics.top_per_group(c, ["o_orderpriority"], [F.col("n").desc(), F.col("c_nationkey")], 1_000_000)
    told = reviews.with_applicability(ranked, (F.col("c_nationkey") % 6 > 0) | (F.col("o_orderpriority") != "5-LOW"), "rank")
    return metrics.stability(told.withColumn("primary", F.col("o_orderpriority") == "1-URGENT"), ["c_nationkey"], "rank", "primary", 10)


@query("""with c as (select o_custkey, count(*) as trips, count(distinct o_orderstatus) as stops, max(o_totalprice) as top from orders group by o_custkey),
r as (select *, trips >= 10 and stops >= 3 and o_custkey % 9 > 0 as material, trips > 12 as hours from c where top > 300000 and o_custkey % 2 = 0),
k as (select kind, r.* from r, range(0, 4) t(kind) where case kind when 0 then trips >= 10 and stops >= 3 when 1 then o_custkey < 10 when 2 then trips >= 10 and stops >= 3 and o_custkey % 9 > 0 else true end),
a as (select kind, count(*) as counted, count(*) filter (material) as material, count(*) filter (hours) as hours, count(*) filter (kind = 2 and o_custkey % 4 = 0) as flagged from k group by kind)
select kind, counted, material, hours, flagged, not (counted < 5 or material < counted or hours < 2 or flagged > 0) as passed, case when counted < 5 then 'fewer than five robust valid candidates' when material < counted then 'a robust valid candidate is not material' when hours < 2 then 'fewer than two robust valid hours extensions' when flagged > 0 then 'a robust valid candidate has an integrity flag' else 'all product-gate conditions passed' end as reason from a""")
def release_gate(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trips"), F.countDistinct("o_orderstatus").alias("stops"), F.max("o_totalprice").alias("top"))
    walk = F.when(F.col("o_custkey") % 9 > 0, 400).otherwise(300)
    gain = whatif.material_gain(F.col("trips"), F.col("stops"), walk)
    busy = (F.col("trips") >= 10) & (F.col("stops") >= 3)
    robust = {0: busy, 1: F.col("o_custkey") < 10, 2: gain, 3: F.lit(True)}
    out = [whatif.release_gate(c, (F.col("top") > 300000) & r, F.col("o_custkey") % 2 == 0, gain, F.col("trips") > 12, F.lit(k == 2) & (F.col("o_custkey") % 4 == 0)).withColumn("kind", F.lit(k)) for k, r in robust.items()]
    return reduce(DataFrame.unionByName, out).where("counted > 0")


@query("""with a as (select distinct l_suppkey, l_returnflag, l_linestatus from lineitem where l_quantity > 40), m as (select l_suppkey, l_returnflag, l_linestatus, count(*) as lines, count(distinct l_partkey) as parts from lineitem group by all),
d as (select distinct l_returnflag, l_linestatus from lineitem)
select s_suppkey as l_suppkey, d.l_returnflag, d.l_linestatus, a.l_suppkey is not null as active, case when a.l_suppkey is not null then coalesce(lines, 0) else 0 end as lines, case when a.l_suppkey is not null then coalesce(parts, 0) else 0 end as parts
from supplier cross join d left join a on a.l_suppkey = s_suppkey and a.l_returnflag = d.l_returnflag and a.l_linestatus = d.l_linestatus left join m on m.l_suppkey = s_suppkey and m.l_returnflag = d.l_returnflag and m.l_linestatus = d.l_linestatus""")
def query_cells(spark, sf_dir):
    item, keys = table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"]
    measured = item.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_partkey").alias("parts"))
    candidates = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return whatif.query_cells(candidates, item.select(keys[1:]).distinct(), item.where("l_quantity > 40").select(keys).distinct(), measured, keys, ["lines", "parts"])


@query("""with r as (select sha256(concat(c_custkey, ' {"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_nationkey":', c_nationkey, '}')) as h from customer), l1 as (select sha256(concat(h, ' ', count(*))) as h, count(*) as c from r group by h),
n1 as (select count(*) as n from l1), l2 as (select sha256(string_agg(h, '' order by h)) as h, cast(sum(c) as bigint) as c from (select h, c, cast(concat('0x', substr(h, 1, 12)) as bigint) % greatest(1, (n + 999) // 1000) as b from l1, n1) group by b)
select case when any_value(n1.n) <= 1000 then min(h) else sha256(string_agg(h, '' order by h)) end as sha256, cast(sum(c) as bigint) as rows from l2, n1""")
def content_fingerprint(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return whatif.fingerprint(own, "c_custkey", 1000)


# --- serving ------------------------------------------------------------------------------------


@query("""with q as (select distinct split_part(p_name, ' ', 1) as query from part union select distinct concat(substr(split_part(p_name, ' ', 2), 1, 2), ' ', substr(split_part(p_name, ' ', 1), 2, 1)) from part)
select query, p_partkey, p_name, rank from (select query, p_partkey, p_name, row_number() over (partition by query order by starts_with(lower(p_name), query) desc, lower(p_name), p_partkey) as rank from part join q on contains(lower(p_name), split_part(query, ' ', 1)) and contains(lower(p_name), split_part(query, ' ', 2))) where rank <= 8""")
def text_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    queries = part.select(first.alias("query")).union(part.select(F.concat(F.substring(second, 1, 2), F.lit(" "), F.substring(first, 2, 1)))).union(part.select(F.lit("")))
    return serve.search(part.select("p_partkey", "p_name"), queries, F.lower("p_name"), "p_partkey", 8)


@query("""with r as (select s_suppkey, s_name, lower(concat(s_name, ' ', n_name)) as t from supplier join nation on s_nationkey = n_nationkey),
q as (select distinct lower(n_name) as query from nation union select distinct concat(s_suppkey % 1000, ' ', lower(substr(n_name, 1, 2))) from supplier join nation on s_nationkey = n_nationkey union select distinct concat('zz', s_nationkey) from supplier)
select query, s_suppkey, s_name, rank from (select query, s_suppkey, s_name, row_number() over (partition by query order by starts_with(t, query) desc, t, s_suppkey) as rank from r join q on contains(t, split_part(query, ' ', 1)) and contains(t, split_part(query, ' ', 2))) where rank <= 8""")
def indexed_search(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    told = table(spark, sf_dir, "supplier").join(nation.hint("merge"), "s_nationkey")
    records, search_text = told.select("s_suppkey", "s_name", "n_name"), F.lower(F.concat("s_name", F.lit(" "), "n_name"))
    part = F.concat((F.col("s_suppkey") % 1000).cast("string"), F.lit(" "), F.lower(F.substring("n_name", 1, 2)))
    queries = nation.select(F.lower("n_name").alias("query")).union(told.select(part)).union(told.select(F.concat(F.lit("zz"), F.col("s_nationkey").cast("string")))).union(nation.select(F.lit(" ")))
    path = graph.shared_path(spark, "index")
    serve.write_search_index(records, "s_suppkey", search_text, path)
    return serve.search_by_index(path, records, queries, "s_suppkey", search_text, "s_suppkey", 8).drop("n_name")


@query("select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_mktsegment), case when c_custkey % 2 = 0 then 'ld' else '' end) and contains(lower(c_mktsegment), case when c_custkey % 2 = 0 then 'bui' else 'h' end) order by c_name")
def kept_stops(spark, sf_dir):
    query = F.when(F.col("c_custkey") % 2 == 0, "ld bui").otherwise("h")
    return serve.kept_stops(table(spark, sf_dir, "customer"), query, text.search_key(F.col("c_mktsegment"))).select("c_custkey", "c_name", "c_mktsegment").orderBy("c_name")


@query("""select p_partkey, case when p_size % 5 = 0 then concat('Given ', p_partkey) when p_size % 5 = 1 then 'Park Washroom Facilities' when p_size % 5 = 2 then 'Library Branch General Information' when p_size % 5 = 3 then 'TTC station washrooms' else '' end as source,
case p_size % 6 when 0 then 'Verify hours' when 1 then 'Verify information' when 2 then 'Open at selected time' when 3 then 'Extend hours' when 4 then 'New facility zone' else '' end as action from part""")
def part_labels(spark, sf_dir):
    k, a = F.col("p_size") % 5, F.col("p_size") % 6
    source = text.source_label(F.when(k == 0, F.concat(F.lit("Given "), F.col("p_partkey").cast("string"))), F.when(k == 1, "parks"), F.when(k == 2, "library:7"), F.when(k == 3, "https://www.TTC.ca/x").otherwise("https://x.org"))
    action = text.action_label(F.when(a < 2, "verify").when(a == 3, "extend").when(a == 4, "new").when(a == 5, "other"), F.when(a == 0, "hours"))
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), action.alias("action"))


@query("""select c_mktsegment as "group", case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end as place, string_agg(cast(c_custkey as varchar), ',' order by rank, c_custkey) as items
from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 5 group by c_mktsegment""")
def ranked_groups(spark, sf_dir):
    top = metrics.top_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    out = serve.ranked_groups(top, F.col("c_mktsegment"), ["MACHINERY", "BUILDING"], "rank", "c_custkey")
    return out.select("group", F.col("place").cast("int").alias("place"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("""with c as (select c_mktsegment as "group", c_custkey, case when c_custkey % 7 = 0 then null else c_nationkey end as r from customer)
select "group", case "group" when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end as place, row_number() over (partition by "group" order by r nulls last, c_custkey) as position, c_custkey from c""")
def ranked_group_rows(spark, sf_dir):
    own = table(spark, sf_dir, "customer").withColumn("r", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))
    return serve.ranked_group_rows(own, F.col("c_mktsegment"), ["MACHINERY", "BUILDING"], "r", "c_custkey")


@query("""with s as (select o_custkey, o_orderpriority as p, case when bool_or(o_orderstatus = 'O') then 'open' else 'closed' end as state from orders group by all)
select mode, c_custkey from customer join s on o_custkey = c_custkey, (values ('public'), ('rider'), ('staff')) t(mode) where p = '1-URGENT' and state = 'open' and case c_mktsegment when 'BUILDING' then mode in ('public', 'rider') when 'MACHINERY' then mode = 'rider' else false end""")
def open_places(spark, sf_dir):
    states = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.when(F.bool_or(F.col("o_orderstatus") == "O"), "open").otherwise("closed").alias("observed"))
    maps = reviews.state_maps(states, "o_custkey", "o_orderpriority", ["observed"]).withColumnRenamed("o_custkey", "c_custkey")
    condition = F.when(F.col("c_mktsegment") == "BUILDING", "unrestricted").when(F.col("c_mktsegment") == "MACHINERY", "fare_paid").otherwise("staff")
    told = table(spark, sf_dir, "customer").join(maps.hint("merge"), "c_custkey").withColumn("mode", F.explode(F.array(*map(F.lit, ("public", "rider", "staff")))))
    return serve.open_at(told, "state_by_time", F.lit("1-URGENT"), condition, F.col("mode")).select("mode", "c_custkey")


@query("""with c as (select l_suppkey, l_returnflag as time, l_linestatus as access, case when l_linenumber = 5 then 4 else l_linenumber end as walk, l_linenumber, bool_or(l_discount > 0.09) as active, count(*) as gain from lineitem group by all)
select l_suppkey, walk, any_value(gain) as gain from c where time = 'A' and access = 'F' and l_suppkey % 3 > 0 and (l_suppkey % 3 = 1) and walk in (3, 4) group by l_suppkey, walk having count(*) = 1 and any_value(active) and any_value(gain) > 0""")
def matching_cells(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    c = item.groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.bool_or(F.col("l_discount") > 0.09).alias("active"), F.count(F.lit(1)).alias("gain"))
    walk = F.when(F.col("l_linenumber") == 5, 4).otherwise(F.col("l_linenumber"))
    cell = F.struct(F.col("l_returnflag").alias("time"), F.col("l_linestatus").alias("access"), walk.alias("walk"), "active", "gain")
    packed = c.groupBy("l_suppkey").agg(F.collect_list(cell).alias("cells")).withColumns({"material_gain": F.col("l_suppkey") % 3 > 0, "action": F.when(F.col("l_suppkey") % 3 == 1, "extend").otherwise("new")})
    return reduce(DataFrame.unionByName, [serve.one_matching_cell(packed, "cells", "extend", "A", "F", w).select("l_suppkey", F.lit(w).alias("walk"), "cell.gain") for w in (3, 4)])


@query("""with s as (select p_name, row_number() over (order by p_name) - 1 as street_id from (select p_name from part group by p_name having count(*) >= 3)) select p_partkey, coalesce(street_id, -1) as street_id from part left join s using (p_name)""")
def street_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("p_name")
    out = serve.with_street_ids(part, metrics.numbered(names, ["p_name"], "street_id"), "p_name", "street_id")
    return out.select("p_partkey", F.coalesce("street_id", F.lit(-1)).alias("street_id"))


@query("select c_custkey, c_name, coalesce(case when c_custkey % 4 > 0 then c_nationkey end, -1) as rank from customer where c_nationkey < 5")
def ordered_candidates(spark, sf_dir):
    told = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("rank"))
    return serve.in_rank_order(told, "rank", "c_custkey").withColumn("rank", F.coalesce("rank", F.lit(-1)))
