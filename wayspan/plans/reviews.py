"""Queries on crossings, evidence, decisions and control states."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspan.operators import reviews, spatial
from wayspan.plans.access import table
from wayspan.plans.surfaces import PLACES, STREETS, places, streets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with o as (select o_custkey, count(*) as n, max(o_orderkey) as last from orders group by 1), d as (select c_custkey, case when c_custkey % 5 = 0 then -1 else last end as last, case when c_acctbal > 0 then 'accepted' else 'rejected' end as status from customer join o on c_custkey = o_custkey where c_nationkey < 20)
select case when d.last is null then 'missing' when d.last = o.last then 'current' else 'stale' end as binding, case when d.last = o.last then status else 'source review' end as status, count(*) as n from o left join d on o_custkey = c_custkey group by 1, 2""")
def decision_bindings(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    customer = table(spark, sf_dir, "customer").where("c_nationkey < 20")
    decisions = customer.join(own, "c_custkey").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("last")).alias("last"), F.when(F.col("c_acctbal") > 0, "accepted").otherwise("rejected").alias("status"))
    return reviews.decided(own, decisions, "c_custkey", "last").groupBy("binding", "status").agg(F.count(F.lit(1)).alias("n"))


_STATES = ("open", "scheduled_closed", "seasonal_closed", "temporary_closed", "construction_closed", "unknown_hours", "potential_open")


def _evidence(spark, sf_dir):
    """lineitem as pairs of a stop (part) and a place (supplier) at a distance (quantity)."""
    item = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", F.get(F.array(*map(F.lit, _STATES)), ((F.col("l_suppkey") + F.col("l_linenumber")) % 7).cast("int")).alias("state"), F.get(F.array(*map(F.lit, ("accessible", "inaccessible", "unknown"))), (F.col("l_suppkey") % 3).cast("int")).alias("access"))
    return reviews.nearest_by_category(item, ["l_partkey"], reviews.evidence_categories(F.col("state"), F.col("access")), "l_quantity", "l_suppkey")


_PAIRS = """i as (select l_partkey, l_suppkey, l_quantity, ['open', 'scheduled_closed', 'seasonal_closed', 'temporary_closed', 'construction_closed', 'unknown_hours', 'potential_open'][(l_suppkey + l_linenumber) % 7 + 1] as state, ['accessible', 'inaccessible', 'unknown'][l_suppkey % 3 + 1] as access from lineitem),
c as (select l_partkey, l_suppkey, l_quantity, 'documented' as k from i union all select l_partkey, l_suppkey, l_quantity, case when state in ('open', 'potential_open') then 'open' else state end from i
union all select l_partkey, l_suppkey, l_quantity, case access when 'accessible' then 'open_accessible' when 'inaccessible' then 'open_inaccessible' else 'open_unknown' end from i where state in ('open', 'potential_open')),
b as (select l_partkey, k, l_quantity, l_suppkey from (select *, row_number() over (partition by l_partkey, k order by l_quantity, l_suppkey) as r from c) where r = 1)"""


@query(f"with {_PAIRS} select l_partkey, coalesce(max(case when k = 'open' then cast(l_quantity as int) end), -1) as open_distance, coalesce(max(case when k = 'open' then l_suppkey end), -1) as open_place, coalesce(max(case when k = 'unknown_hours' then l_suppkey end), -1) as unknown_place from b group by l_partkey")
def nearest_evidence(spark, sf_dir):
    out = _evidence(spark, sf_dir)
    return out.select("l_partkey", F.coalesce(F.col("open_distance").cast("int"), F.lit(-1)).alias("open_distance"), F.coalesce("open_place", F.lit(-1)).alias("open_place"), F.coalesce("unknown_hours_place", F.lit(-1)).alias("unknown_place"))


@query(f"""with {_PAIRS}, h as (select p.l_partkey, coalesce(list(k) filter (l_quantity <= 5), []) as h from (select distinct l_partkey from i) p left join b on b.l_partkey = p.l_partkey group by 1)
select not list_contains(h, 'documented') as geographic_gap, not list_contains(h, 'open') and list_contains(h, 'scheduled_closed') as scheduled_time_gap, not list_contains(h, 'open') and list_contains(h, 'seasonal_closed') as seasonal_gap,
not list_contains(h, 'open') and (list_contains(h, 'temporary_closed') or list_contains(h, 'construction_closed')) as temporary_service_gap, list_contains(h, 'open') and list_contains(h, 'open_inaccessible') and not list_contains(h, 'open_accessible') as accessibility_gap,
(not list_contains(h, 'open') and list_contains(h, 'unknown_hours')) or (list_contains(h, 'open') and not list_contains(h, 'open_accessible') and list_contains(h, 'open_unknown')) as information_gap, count(*) as n from h group by all""")
def gap_flags(spark, sf_dir):
    return reviews.gap_flags(_evidence(spark, sf_dir), 5).groupBy(*reviews.GAPS).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_suppkey, coalesce(max(case when l_returnflag = 'A' then n end), 0) as a_lines, coalesce(max(case when l_returnflag = 'N' then n end), 0) as n_lines, coalesce(max(case when l_returnflag = 'R' then n end), 0) as r_lines from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by all) group by l_suppkey""")
def wide_metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.max("l_quantity").alias("most"))
    out = reviews.wide_metrics(counts, "l_suppkey", "l_returnflag", ["A", "N", "R"], ["lines", "most"])
    return out.select("l_suppkey", *[F.coalesce(f"{k}_lines", F.lit(0)).alias(f"{k.lower()}_lines") for k in "ANR"])


@query("""with s as (select distinct o_custkey, o_orderpriority as p, o_orderstatus as s from (select o_custkey, o_orderpriority, max(o_orderstatus) as o_orderstatus from orders group by 1, 2))
select o_custkey, string_agg(concat(p, '=', s), ',' order by p) as states from s group by o_custkey""")
def state_maps(spark, sf_dir):
    states = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderstatus").alias("s"))
    maps = reviews.state_maps(states, "o_custkey", "o_orderpriority", ["s"])
    listed = F.array_sort(F.transform(F.map_entries("state_by_time"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["s"])))
    return maps.select("o_custkey", F.array_join(listed, ",").alias("states"))


@query(f"""with {PLACES}, {STREETS}, t as (select street, ax, ay, bx, by_ as dy, street % 2 as f from s where bx is not null),
x as (select a.street as a, b.street as b, (a.bx - a.ax) * (b.ay - a.ay) - (a.dy - a.ay) * (b.ax - a.ax) as d1, (a.bx - a.ax) * (b.dy - a.ay) - (a.dy - a.ay) * (b.bx - a.ax) as d2,
(b.bx - b.ax) * (a.ay - b.ay) - (b.dy - b.ay) * (a.ax - b.ax) as d3, (b.bx - b.ax) * (a.dy - b.ay) - (b.dy - b.ay) * (a.bx - b.ax) as d4, a.ax, a.ay, a.bx, a.dy from t a join t b on a.street < b.street and a.f <> b.f)
select a, b, round_even(ax + d3 / (d3 - d4) * (bx - ax), 4) as x, round_even(ay + d3 / (d3 - d4) * (dy - ay), 4) as y from x where d1 * d2 < 0 and d3 * d4 < 0""")
def street_crossings(spark, sf_dir):
    own = streets(spark, sf_dir).withColumn("feature", F.col("street") % 2)
    out = spatial.segment_crossings(own, "street", "feature", 120.0)
    return out.select("a", "b", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"))


@query(f"""with {PLACES}, {STREETS}, q as (select street, least(ax, bx) as x0, greatest(ax, bx) as x1, least(ay, by_) as y0, greatest(ay, by_) as y1 from s where bx is not null), h as (select vec_id, x - 20 as x0, x + 20 as x1, y - 20 as y0, y + 20 as y1 from p where label = 0)
select vec_id, count(*) as streets from q join h on q.x0 <= h.x1 and h.x0 <= q.x1 and q.y0 <= h.y1 and h.y0 <= q.y1 group by vec_id""")
def boxes_in_view(spark, sf_dir):
    s = streets(spark, sf_dir).select("street", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"))
    v = places(spark, sf_dir).where("label = 0").select("vec_id", (F.col("x") - 20).alias("x0"), (F.col("x") + 20).alias("x1"), (F.col("y") - 20).alias("y0"), (F.col("y") + 20).alias("y1"))
    return spatial.overlapping_boxes(v, s, "vec_id", "street", 150.0).groupBy("vec_id").agg(F.count(F.lit(1)).alias("streets"))


@query("""with s as (select o_orderkey // 128 as row, o_orderkey % 128 as col, o_totalprice / 1000 as z from orders where o_orderstatus <> 'P'), t as (select o_orderkey // 128 as row, o_orderkey % 128 as col, (o_custkey % 100)::double as z from orders where o_orderpriority <> '5-LOW'),
m as (select coalesce(s.row, t.row) as row, coalesce(s.col, t.col) as col, s.z as s, t.z as t from s full join t on s.row = t.row and s.col = t.col), g as (select *, coalesce(s between 1 and 400 and t between 1 and 400, false) as valid from m)
select row, col, case when valid then least(600, greatest(0, s - t)) else 0 end as height, valid from g""")
def surface_heights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 128).alias("row"), F.pmod("o_orderkey", F.lit(128)).alias("col"), "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    surface = o.where("o_orderstatus <> 'P'").select("row", "col", (F.col("o_totalprice") / 1000).alias("z"))
    terrain = o.where("o_orderpriority <> '5-LOW'").select("row", "col", (F.col("o_custkey") % 100).cast("double").alias("z"))
    return reviews.surface_heights(surface, terrain, 1.0, 400.0)


@query("""with p as (select l_returnflag = 'R' as canopy, l_quantity as before_h, l_quantity + l_linenumber - 2 as after_h, l_discount > 0.05 as measured from lineitem)
select count(*) filter (canopy) as canopy, count(*) filter (canopy and after_h > before_h) as raised, round_even(avg(case when canopy and after_h > before_h then after_h - before_h end), 6) as mean_rise, max(case when canopy and after_h > before_h then after_h - before_h end) as max_rise,
count(*) filter (canopy and after_h > before_h and measured) as measured, count(*) filter (canopy and after_h > before_h and not measured) as defaulted from p""")
def correction_report(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").withColumn("after", F.col("l_quantity") + F.col("l_linenumber") - 2)
    return reviews.correction_report(item, F.col("l_returnflag") == "R", "l_quantity", "after", F.col("l_discount") > 0.05).withColumn("mean_rise", F.bround("mean_rise", 6))


@query("""with c as (select l_suppkey, l_returnflag as moment, l_linestatus as access, l_linenumber as walk, bool_or(l_discount > 0.09) as active, count(*) as gain from lineitem where l_quantity > 45 group by all), d as (select distinct l_returnflag as moment, l_linestatus as access, l_linenumber as walk from lineitem)
select d.moment, d.access, d.walk, count(c.l_suppkey) as results, coalesce(min(c.l_suppkey), -1) as first from d left join c on d.moment = c.moment and d.access = c.access and d.walk = c.walk and active and gain > 0 group by all""")
def control_states(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("moment"), F.col("l_linestatus").alias("access"), F.col("l_linenumber").alias("walk"), "l_discount", "l_quantity")
    keys = ["moment", "access", "walk"]
    cells = item.where("l_quantity > 45").groupBy("l_suppkey", *keys).agg(F.bool_or(F.col("l_discount") > 0.09).alias("active"), F.count(F.lit(1)).alias("gain"))
    return reviews.state_matrix(cells, keys, item.select(keys).distinct(), "l_suppkey").withColumn("first", F.coalesce("first", F.lit(-1)))


@query("""select case c_nationkey % 3 when 0 then 'fare_paid' when 1 then 'unrestricted' else 'none' end as condition, case c_nationkey % 3 when 0 then 'true' when 1 then 'false' else '' end as fare, case c_nationkey % 3 when 0 then 'Fare-paid area, valid fare required' when 1 then 'No fare required' else '' end as label, count(*) as n from customer group by all""")
def disclosures(spark, sf_dir):
    condition = F.get(F.array(*map(F.lit, ("fare_paid", "unrestricted", "staff"))), F.col("c_nationkey") % 3)
    told = table(spark, sf_dir, "customer").select(reviews.disclosure(condition).alias("d"))
    return told.groupBy(F.coalesce("d.condition", F.lit("none")).alias("condition"), F.coalesce(F.col("d.requires_fare").cast("string"), F.lit("")).alias("fare"), F.coalesce("d.label", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select l_suppkey, max(case when l_linenumber = 1 and l_returnflag = 'A' then l_quantity end) as stops, min(l_orderkey) as rank from lineitem group by 1) select l_suppkey, rank, stops from c where l_suppkey % 3 = 0 and l_suppkey % 2 = 0 and stops > 20""")
def default_results(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "A"), F.col("l_quantity"))).alias("stops"), F.min("l_orderkey").alias("primary_rank"))
    cell = lambda t, n: F.struct(F.lit(t).alias("time"), F.lit("public").alias("access"), F.lit(400).alias("walk"), (F.col("stops") > 20).alias("active"), n.alias("activeStops"), F.lit(0).alias("events"), F.lit(0).alias("uniqueTrips"))
    told = c.withColumns({"cells": F.array(cell("0030", F.lit(0.0)), cell("2200", F.col("stops"))), "action": F.when(F.col("l_suppkey") % 3 == 0, "extend").otherwise("new"), "audit_status": F.lit("valid"), "material_gain": F.col("l_suppkey") % 2 == 0})
    return reviews.default_results(told, "cells", "extend", "2200", "public", 400).select("l_suppkey", F.col("primary_rank").alias("rank"), "stops")
