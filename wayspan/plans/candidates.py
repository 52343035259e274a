"""Queries on candidate simulations, summaries and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspan.operators import candidates, reviews
from wayspan.plans.access import AVAILABLE_SQL, DIST_SQL, FOOTPRINT_SQL, _footprints, place_states, supply_distances, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with recursive {FOOTPRINT_SQL}, u as materialized (select source_id, m.window_id, m.trip, m.route, m.stop_id from n join m on n.stop_id = m.stop_id where m.stop_id not in (select stop_id from n where source_id < 3)),
z as materialized (select source_id, count(distinct (window_id, trip)) as new_trips, count(distinct route) as new_routes, count(distinct stop_id) as new_stops from u group by source_id),
k as materialized (select *, row_number() over (order by new_trips desc, new_routes desc, new_stops desc, source_id) as rank from z), ue as materialized (select distinct source_id, window_id, trip from u),
v as materialized (select a.source_id, list(a.rival) as rivals from (select x.source_id, y.source_id as rival from ue x join ue y on x.window_id = y.window_id and x.trip = y.trip join k p on p.source_id = x.source_id join k q on q.source_id = y.source_id where q.rank < p.rank group by all having count(*) >= 0.8 * any_value(p.new_trips)) a group by 1),
t as materialized (select k.*, coalesce(v.rivals, []) as rivals from k left join v using (source_id)),
g(rank, source_id, kept, every) as (select 0::bigint, 0::int, false, []::int[] union all select t.rank, t.source_id, not list_has_any(t.rivals, every), case when list_has_any(t.rivals, every) then every else list_append(every, t.source_id) end from g join t on t.rank = g.rank + 1)
select k.source_id, new_trips, new_routes, new_stops from k join g using (source_id) where kept""")
def new_zones(spark, sf_dir):
    footprints, events = _footprints(spark, sf_dir)
    baseline = footprints.where("source_id < 3").select("snapshot_id", "stop_id")
    effective = candidates.trip_effects(footprints, baseline, events).select("source_id").distinct()
    out = candidates.new_zones(footprints.join(effective.hint("merge"), "source_id", "left_semi"), baseline, events)
    return out.select("source_id", "new_trips", "new_routes", "new_stops")


@query(f"with {FOOTPRINT_SQL}, a as (select distinct window_id, stop_id from m), b as (select stop_id from n where source_id < 3), x as (select distinct stop_id from a where stop_id not in (select stop_id from b)) select s_nationkey as node, min(stop_id) as stop_id from x join (select distinct s_suppkey % 100 as k, s_nationkey from supplier) on k = stop_id group by 1")
def seed_stops(spark, sf_dir):
    footprints, events = _footprints(spark, sf_dir)
    open_ = candidates.uncovered_stops(events, footprints.where("source_id < 3"))
    snaps = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).cast("int").alias("stop_id"), F.col("s_nationkey").alias("node")).distinct()
    return candidates.seed_stops(open_, snaps)


_STATES = ("open", "scheduled_closed", "temporary_closed", "unknown_hours")
SIM_SQL = f"""{FOOTPRINT_SQL}, pl as (select n_nationkey as place_id, case when n_nationkey % 5 = 0 then 'fare_paid' else 'unrestricted' end as cond, ['accessible', 'inaccessible', 'unknown'][n_nationkey % 3 + 1] as access from nation),
st as (select n_nationkey as place_id, snap, ['open', 'scheduled_closed', 'temporary_closed', 'unknown_hours'][(n_nationkey + snap) % 4 + 1] as observed, ['open', 'closed', 'unknown'][n_nationkey % 3 + 1] as planned from nation, range(0, 4) t(snap)),
ef as (select *, case when observed = 'temporary_closed' then case planned when 'open' then 'open' when 'closed' then 'scheduled_closed' else 'unknown_hours' end else observed end as state from st),
f as (select n.source_id, m.*, m.stop_id in (select stop_id from n where source_id < 3) as had, m.stop_id in (select stop_id from n where source_id < 1) as had_access from n join m on n.stop_id = m.stop_id)"""


def _gain_sql(active: str, had: str, kind: str, prefix: str) -> str:
    return f"""select concat('{prefix}', a.place_id) as candidate_id, '{kind}' as kind, count(distinct case when not {had} then (window_id, trip) end) as new_trips, count(distinct case when not {had} then f.stop_id end) as new_stops, count(distinct case when not {had} then window_id end) as snapshots_gained, count(distinct case when trip is not null then (window_id, trip) end) as trips
from (select distinct place_id, snap from ({active})) a left join f on f.source_id = a.place_id and f.window_id = a.snap where a.place_id in (select source_id from f) group by a.place_id"""


def _simulation(spark, sf_dir):
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    nation = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    places = n.select(nation.alias("place_id"), F.when(nation % 5 == 0, "fare_paid").otherwise("unrestricted").alias("access_condition"), pick(("accessible", "inaccessible", "unknown"), nation % 3).alias("accessibility"))
    states = n.withColumn("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(nation.alias("place_id"), "snapshot_id", pick(_STATES, (nation + F.col("snapshot_id")) % 4).alias("observed"), pick(("open", "closed", "unknown"), nation % 3).alias("scheduled"))
    footprints, events = _footprints(spark, sf_dir)
    covered = lambda k: footprints.where(F.col("source_id") < k).select("snapshot_id", "stop_id")
    return places, states, footprints, covered(3), covered(1), events


_PUBLIC = {"access_mode": "public", "closure_mode": "normal_operations", "information_mode": "unknown_unavailable"}
_SHOWN = ["candidate_id", "kind", "new_trips", "new_stops", "snapshots_gained", "trips"]


@query(f"""with {SIM_SQL} {_gain_sql("select place_id, snap from ef join pl using (place_id) where cond = 'unrestricted' and state = 'unknown_hours'", "had", "hours", "verify-hours:")} union all {_gain_sql("select place_id, snap from ef join pl using (place_id) where cond = 'unrestricted' and state = 'open' and access = 'unknown'", "had_access", "accessibility", "verify-accessibility:")}""")
def verifications(spark, sf_dir):
    places, states, footprints, baseline, accessible, events = _simulation(spark, sf_dir)
    return candidates.verifications(places, states, footprints, baseline, accessible, events, _PUBLIC).select(_SHOWN)


@query(f"""with {SIM_SQL} {_gain_sql("select place_id, snap from ef join pl using (place_id) where state = 'open' and access = 'inaccessible'", "had_access", "retrofit", "retrofit-accessibility:")}""")
def retrofits(spark, sf_dir):
    places, states, footprints, _, accessible, events = _simulation(spark, sf_dir)
    return candidates.retrofits(places, states, footprints, accessible, events, _PUBLIC | {"access_mode": "rider_conditional"}).select(_SHOWN)


@query(f"""with {AVAILABLE_SQL}, q as (select s_suppkey as place_id, case when s_suppkey % 5 = 0 then 'fare_paid' else 'unrestricted' end as cond, s_suppkey % 2 = 0 as acc, s_suppkey % 8 as cluster, s_suppkey % 250 as snap from supplier),
j as (select *, state = 'open' and snap <= 200 as o, cond = 'unrestricted' as fr from st join q using (place_id)), k as (select moment_id, s_suppkey as stop, s_suppkey % 3 = moment_id % 3 as covered from supplier, m where s_suppkey % 4 <> moment_id),
w as (select moment_id, count(*) as active_stops, count(*) filter (covered) as covered_stops from k group by 1)
select j.moment_id as snapshot_id, count(distinct case when fr and o then cluster end) as open_access_points, count(*) filter (fr and o) as open_records, count(distinct case when not fr and o then cluster end) as fare_paid_open_access_points, count(*) filter (fr and state = 'closed') as scheduled_closed, count(*) filter (fr and state = 'temporarily closed') as temporarily_closed,
count(*) filter (fr and state = 'unknown') as unknown_hours, count(*) filter (fr and o and acc) as accessible_open, any_value(active_stops) as active_stops, any_value(covered_stops) as covered_stops, round_even(100 * any_value(covered_stops) / any_value(active_stops), 6) as coverage_percent, any_value(active_stops) * 2 as event_count, any_value(active_stops) as unique_trip_count
from j join w on w.moment_id = j.moment_id group by j.moment_id""")
def snapshot_headlines(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    places = s.select(k.alias("place_id"), F.when(k % 5 == 0, "fare_paid").otherwise("unrestricted").alias("access_condition"), (k % 2 == 0).alias("accessible"), (k % 8).alias("cluster"), (k % 250).alias("snap_metres"))
    states = place_states(spark, sf_dir).withColumnRenamed("moment_id", "snapshot_id")
    stops = s.withColumn("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(k % 4 != F.col("snapshot_id")).select("snapshot_id", k.alias("stop_id"), (k % 3 == F.col("snapshot_id") % 3).alias("covered"))
    told = candidates.headlines(candidates.snapshot_summary(places, states, stops, 200.0), stops.withColumn("event_count", F.lit(2)), stops.select("snapshot_id", F.col("stop_id").alias("trip")))
    shown = ["snapshot_id", "open_access_points", "open_records", "fare_paid_open_access_points", "scheduled_closed", "temporarily_closed", "unknown_hours", "accessible_open", "active_stops", "covered_stops"]
    return told.select(*shown, F.bround("coverage_percent", 6).alias("coverage_percent"), "event_count", "unique_trip_count")


@query(f"""with {DIST_SQL}, c as (select label, p_partkey as stop_id, min(dist + p_size * 0.05) as dist from d join part on node = p_partkey + 10000000 where label < 2 group by all), a as (select label, p_partkey as stop_id from part, (values (0), (1)) t(label) where p_size % 2 = 0)
select p_partkey as stop_id, coalesce(c0.dist <= 3, false) as public_3, coalesce(c0.dist <= 5, false) as public_5, coalesce(c1.dist <= 3, false) as rider_3, coalesce(c1.dist <= 5, false) as rider_5 from part left join c c0 on c0.stop_id = p_partkey and c0.label = 0 left join c c1 on c1.stop_id = p_partkey and c1.label = 1 where p_size % 2 = 0""")
def stop_coverage(spark, sf_dir):
    label = F.struct(F.lit("2200").alias("snapshot_id"), F.when(F.col("label") == 0, "public").otherwise("rider").alias("access"))
    distances = supply_distances(spark, sf_dir, 2).select(label.alias("label"), "node", "dist")
    p = table(spark, sf_dir, "part")
    stops = p.select(F.col("p_partkey").alias("stop_id"), (F.col("p_partkey") + 10_000_000).alias("node"), (F.col("p_size") * F.lit(0.05)).alias("offset"))
    out = candidates.stop_coverage(distances, stops, p.where("p_size % 2 = 0").select(F.lit("2200").alias("snapshot_id"), F.col("p_partkey").alias("stop_id")), [3, 5], ["public", "rider"])
    return out.select("stop_id", *[F.col("coverage")[m][str(w)].alias(f"{m}_{w}") for m in ("public", "rider") for w in (3, 5)])


@query("""with r as (select l_suppkey as c, l_returnflag as s, count(distinct l_orderkey) as t, row_number() over (partition by l_returnflag order by count(distinct l_orderkey) desc, l_suppkey) as rank from lineitem group by 1, 2)
select concat('c', c) as candidate_id, cast(max(case when s = 'A' then t end) as bigint) as primary_trips, cast(coalesce(sum(case when s <> 'A' then t end), 0) as bigint) as other_trips, max(case when s = 'A' then rank end) as primary_rank, cast(coalesce(sum(case when s = 'N' then rank end), 0) as bigint) as other_ranks, 7 as fields from r group by c""")
def public_candidates(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("candidate_id"), F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("scenario_id"), F.col("l_orderkey").alias("trip"))
    n = F.countDistinct("trip")
    metrics = item.groupBy("candidate_id", "k", "scenario_id").agg(n.alias("unique_trips"), n.alias("unique_routes"), n.alias("active_stops"), n.alias("stop_time_events"))
    rank = F.expr("row_number() over (partition by scenario_id order by unique_trips desc, k)")
    ranks = metrics.select("candidate_id", "scenario_id", (F.col("scenario_id") != "R").alias("applicable"), rank.alias("rank"))
    own = item.select("candidate_id", F.lit("extend_hours").alias("candidate_class"), F.lit("x").alias("name"), F.lit("secret").alias("trip_ids")).distinct()
    out = candidates.public_candidates(own, metrics, ranks, "A")
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[f].cast("bigint"), F.lit(0)))
    return out.select("candidate_id", F.col("primary_metrics.unique_trips").alias("primary_trips"), total("sensitivity_metrics", "unique_trips").alias("other_trips"), "primary_rank", total("sensitivity_ranks", "rank").alias("other_ranks"), F.lit(len(out.columns)).alias("fields"))


@query("""with c as (select s_suppkey as candidate_id, s_suppkey % 4 as h from supplier), o as (select l_suppkey as candidate_id, l_partkey, l_quantity, row_number() over (partition by l_suppkey order by l_quantity, l_partkey) as r from (select distinct l_suppkey, l_partkey, l_quantity from lineitem)),
n as (select candidate_id, string_agg(concat(l_partkey, ':x:', printf('%.1f', l_quantity), 'm'), ' | ' order by r) as nearest_others from o where r <= 3 group by 1), g as (select l_suppkey as candidate_id, count(distinct l_partkey) as gained_stops from lineitem where l_quantity > 40 group by 1)
select candidate_id, coalesce(nearest_others, '') as nearest_others, coalesce(gained_stops, 0) as gained_stops, case when candidate_id % 4 = 1 and candidate_id % 3 = 0 then 'valid' else 'source review' end as audit_status, case when candidate_id % 4 = 1 and candidate_id % 3 = 0 then 'seen' else '' end as evidence_note, candidate_id * 2 as total from c left join n using (candidate_id) left join g using (candidate_id)""")
def review_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k.alias("candidate_id"), (k % 4).alias("analysis_hash"))
    item = table(spark, sf_dir, "lineitem")
    others = item.select(F.col("l_suppkey").alias("candidate_id"), F.col("l_partkey").alias("place_id"), F.lit("x").alias("name"), F.col("l_quantity").alias("metres")).distinct()
    gained = item.where("l_quantity > 40").select(F.col("l_suppkey").alias("candidate_id"), F.col("l_partkey").alias("stop_id"))
    decisions = own.where("candidate_id % 3 = 0").select("candidate_id", F.lit(1).cast("bigint").alias("analysis_hash"), F.lit("valid").alias("audit_status"), F.lit("seen").alias("evidence_note"), F.lit("r").alias("reviewer"), F.lit("2026-07-21").alias("reviewed_at"))
    out = candidates.review_rows(own, own.select("candidate_id", (F.col("candidate_id") * 2).alias("total")), others, gained, decisions)
    return candidates.published(out, out.select("candidate_id", F.lit("valid").alias("status")), "candidate_id").select("candidate_id", "nearest_others", "gained_stops", "audit_status", "evidence_note", "total")


@query("select case when p_size % 3 = 0 then 'extend_hours' when p_size % 3 = 1 then 'verify_information' else 'new_facility_zone' end as kind, p_size % 2 = 0 and p_size % 3 < 2 as without, count(*) as n from part group by all")
def applicable_runs(spark, sf_dir):
    k = F.col("p_size")
    kind = F.when(k % 3 == 0, "extend_hours").when(k % 3 == 1, "verify_information").otherwise("new_facility_zone")
    mode = F.when(k % 2 == 0, "optimistic_information").otherwise("unknown_unavailable")
    told = reviews.with_applicability(table(spark, sf_dir, "part").withColumn("rank", F.lit(1)), candidates.applicable(kind, mode), "rank")
    return told.groupBy(kind.alias("kind"), F.col("rank").isNull().alias("without")).agg(F.count(F.lit(1)).alias("n"))
