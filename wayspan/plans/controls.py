"""Queries on what control states show: customers are places, suppliers proposals, nations the states."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspan.operators import controls
from wayspan.plans.access import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _pick(c, n: int, *values):
    return F.get(F.array(*map(F.lit, values)), (c % n).cast("int"))


def control_tables(spark, sf_dir):
    k = F.col("n_nationkey")
    search = F.when(k % 6 == 0, "buil Cust").when(k % 6 == 3, "supp").when(k % 6 == 4, "  ")
    states = table(spark, sf_dir, "nation").select(k.alias("state_id"), _pick(k, 4, "open", "extend", "verify", "new").alias("action"), _pick(k, 3, "A", "N", "R").alias("time"), _pick(k, 5, "public", "rider", "public", "staff", "rider").alias("access"), (k % 4 + 1).cast("int").alias("walk"), search.alias("search"), F.when(k % 5 < 4, k * 7).alias("selected"))
    c = F.col("c_custkey")
    condition = F.when(F.col("c_mktsegment") == "BUILDING", "unrestricted").when(F.col("c_mktsegment") == "MACHINERY", "fare_paid").otherwise("staff")
    state = lambda open_: F.when(open_, "open").otherwise("closed")
    observed = F.create_map(F.lit("A"), state(F.col("c_acctbal") > 0), F.lit("N"), state(c % 2 == 0), F.lit("R"), F.lit("closed"))
    places = table(spark, sf_dir, "customer").select(c.alias("id"), F.concat("c_mktsegment", F.lit(" "), "c_name").alias("name"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("search_text"), condition.alias("condition"), observed.alias("observed"))
    cell = F.struct(F.col("l_returnflag").alias("time"), F.when(F.col("l_linestatus") == "O", "public").otherwise("rider_conditional").alias("access"), F.when(F.col("l_linenumber") == 5, 4).otherwise(F.col("l_linenumber")).cast("int").alias("walk"), F.col("active"), F.col("stops").alias("activeStops"), F.lit(0).alias("events"), F.lit(None).cast("int").alias("uniqueRoutes"), F.lit(0).alias("uniqueTrips"))
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.bool_or(F.col("l_discount") > 0.07).alias("active"), F.count_if(F.col("l_quantity") > 25).alias("stops"))
    packed = cells.groupBy("l_suppkey").agg(F.collect_list(cell).alias("cells"))
    s = F.col("s_suppkey")
    kind = F.when(s % 3 == 0, F.lit("extend_hours")).when(s % 3 == 2, F.when(s % 7 == 0, "zeta").otherwise("new_facility_zone"))
    proposals = table(spark, sf_dir, "supplier").join(packed.hint("merge"), s == packed["l_suppkey"]).select(s.alias("id"), _pick(s, 3, "extend", "verify", "new").alias("action"), F.when(s % 5 > 0, _pick(s, 2, "hours", "accessibility")).alias("subtype"), kind.alias("action_class"), F.when(s % 11 > 0, s * 13 % 101).alias("rank"), (s % 6 > 0).alias("material_gain"), F.col("s_name").alias("search_text"), "cells")
    return states, places, proposals


CONTROLS = """s as (select n_nationkey as state_id, case n_nationkey % 4 when 0 then 'open' when 1 then 'extend' when 2 then 'verify' else 'new' end as action, case n_nationkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as time, case n_nationkey % 5 when 1 then 'rider' when 3 then 'staff' when 4 then 'rider' else 'public' end as access, n_nationkey % 4 + 1 as walk,
case n_nationkey % 6 when 0 then 'buil' when 3 then 'supp' else '' end as q1, case n_nationkey % 6 when 0 then 'cust' else '' end as q2, case when n_nationkey % 5 < 4 then n_nationkey * 7 end as selected from nation),
o as (select state_id, 'open' as "group", 0 as group_place, row_number() over (partition by state_id order by lower(concat(c_mktsegment, ' ', c_name)), c_custkey) as position, c_custkey as id from s join customer on action = 'open' and ((time = 'A' and c_acctbal > 0) or (time = 'N' and c_custkey % 2 = 0))
  and (c_mktsegment = 'BUILDING' and access in ('public', 'rider') or c_mktsegment = 'MACHINERY' and access = 'rider') and contains(lower(concat(c_name, ' ', c_mktsegment)), q1) and contains(lower(concat(c_name, ' ', c_mktsegment)), q2)),
l as (select l_suppkey, l_returnflag as time, case when l_linestatus = 'O' then 'public' else 'rider' end as access, l_linenumber, bool_or(l_discount > 0.07) as active, count(*) filter (l_quantity > 25) as stops from lineitem group by l_suppkey, l_returnflag, l_linestatus, l_linenumber),
c as (select l_suppkey, time, access, case when l_linenumber = 5 then 4 else l_linenumber end as walk from l group by all having count(*) = 1 and bool_and(active and stops > 0)),
p as (select s_suppkey, s_name, case s_suppkey % 3 when 0 then 'extend' when 1 then 'verify' else 'new' end as action, case s_suppkey % 3 when 0 then 'extend_hours' when 1 then case when s_suppkey % 5 = 0 then 'verify-information' when s_suppkey % 2 = 0 then 'verify-hours' else 'verify-accessibility' end else case when s_suppkey % 7 = 0 then 'zeta' else 'new_facility_zone' end end as g, case when s_suppkey % 11 > 0 then s_suppkey * 13 % 101 end as rank from supplier where s_suppkey % 6 > 0),
r as (select state_id, g as "group", case g when 'extend_hours' then 1 when 'new_facility_zone' then 2 when 'verify-hours' then 3 when 'verify-accessibility' then 4 when 'verify-information' then 5 when 'retrofit_accessibility' then 6 else 7 end as group_place, row_number() over (partition by state_id, g order by rank nulls last, s_suppkey) as position, s_suppkey as id
  from s join c on s.time = c.time and s.access = c.access and s.walk = c.walk join p on p.s_suppkey = c.l_suppkey and p.action = s.action where contains(lower(s_name), q1) and contains(lower(s_name), q2)),
v as materialized (select * from o union all select * from r)"""


@query(f"with {CONTROLS} select * from v")
def control_results(spark, sf_dir):
    return controls.visible_features(*control_tables(spark, sf_dir))


@query(f"with {CONTROLS} select state_id, case when selected in (select id from v where v.state_id = s.state_id) then selected else -1 end as selected_id, selected is not null and not coalesce(selected in (select id from v where v.state_id = s.state_id), false) as invalidated from s")
def control_selections(spark, sf_dir):
    states, places, proposals = control_tables(spark, sf_dir)
    told = controls.selections(states, controls.visible_features(states, places, proposals))
    return told.withColumn("selected_id", F.coalesce("selected_id", F.lit(-1)))


@query("select case s_suppkey % 3 when 0 then 'extend' when 1 then 'verify' else 'new' end as action, count(*) as n from supplier where s_suppkey in (select l_suppkey from lineitem) group by 1")
def action_counts(spark, sf_dir):
    return controls.counts_by_action(control_tables(spark, sf_dir)[2])
