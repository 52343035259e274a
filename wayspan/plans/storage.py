"""Queries that write derived tables to the shared folder, read them back by the readers, and rebuild or stream them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayspan.functions import geo
from wayspan.operators import checks, serve
from wayspan.operators.graph import shared_path
from wayspan.plans.access import table
from wayspan.plans.surfaces import GRID, grid
from wayspan.sources import files
from wayspan.streaming.events import clean_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, cast(null as varchar) as note from customer")
def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "customer"), path, ["c_mktsegment", "c_name", "c_custkey"])
    return files.read_table_csv(spark, path, "c_custkey STRING, c_name STRING, c_mktsegment STRING, note STRING")


@query("select round_even(cast(embedding[1] as double) * 100, 6) + 0.0 as lon, round_even(cast(embedding[2] as double) * 60, 6) + 0.0 as lat, vec_id, label from embeddings")
def features_round_trip(spark, sf_dir):
    path, at = shared_path(spark, "features"), lambda k: F.get("embedding", F.lit(k)).cast("double")
    e = table(spark, sf_dir, "embeddings").select((at(0) * 100).alias("lon"), (at(1) * 60).alias("lat"), "vec_id", "label")
    files.write_features(e, path, "lon", "lat", ["vec_id", "label"], ["vec_id"])
    return files.read_features(spark, path, "vec_id:bigint,label:int", lines=True)


@query("select o_orderpriority, count(*) as records, count(o_comment) as comments, cast(sum(o_custkey) as bigint) as customers from (select o_orderpriority, o_custkey, case when o_orderkey % 5 > 0 then 'x' end as o_comment from orders) group by o_orderpriority")
def grouped_files(spark, sf_dir):
    path = shared_path(spark, "groups")
    own = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_orderkey") % 5 > 0, "x").alias("comment"))
    files.write_by_group(own, path, "o_orderpriority")
    read = spark.read.schema("o_custkey long, comment string, o_orderpriority string").json(path)
    return read.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("records"), F.count("comment").alias("comments"), F.sum("o_custkey").alias("customers"))


@query("select count(*) as records, true as sized from part")
def manifest_totals(spark, sf_dir):
    path = shared_path(spark, "published")
    files.publish(table(spark, sf_dir, "part"), path, [lambda df: df.where("p_partkey is null")])
    told = files.output_manifest(spark.read.parquet(path))
    return told.agg(F.sum("records").alias("records"), F.bool_and(F.col("bytes") > 0).alias("sized"))


@query(f"with {GRID} select s_suppkey as place, row, col, bits from supplier join g on row >= s_nationkey * 4 - 2 and row < s_nationkey * 4 + 5 and col >= s_suppkey % 120 and col < s_suppkey % 120 + 6")
def windowed_pixels(spark, sf_dir):
    path = shared_path(spark, "pixels")
    files.write_pixels(grid(spark, sf_dir).select("row", "col", "bits"), path, 32)
    s, row = table(spark, sf_dir, "supplier"), F.col("s_nationkey") * 4
    windows = s.select(F.col("s_suppkey").alias("place"), (row - 2).alias("low"), (row + 5).alias("high"), (F.col("s_suppkey") % 120).alias("left"), (F.col("s_suppkey") % 120 + 6).alias("right"))
    return files.read_pixels_within(spark, path, windows, "place", 32).select("place", "row", "col", "bits")


@query("""with c as (select c_nationkey as nation, c_acctbal from customer union all select c_nationkey, c_acctbal from customer where c_nationkey in (3, 17))
select nation, count(*) as n, round_even(sum(c_acctbal), 2) as balance, case when nation in (3, 17) then 'second' else 'first' end as built from c group by nation""")
def rebuilt_parts(spark, sf_dir):
    """Sums of nations, built once; two nations get more input, and only their parts are built again."""
    inputs, outputs = shared_path(spark, "inputs"), shared_path(spark, "outputs")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    c.repartition("nation").write.partitionBy("nation").parquet(inputs)

    def build(run: str):
        return lambda df: df.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")).withColumn("built", F.lit(run))

    empty = [lambda df: df.where("n = 0")]
    files.rebuild_stale(spark, inputs, outputs, "nation", build("first"), empty, "v1")
    c.where("nation in (3, 17)").write.mode("append").partitionBy("nation").parquet(inputs)
    files.rebuild_stale(spark, inputs, outputs, "nation", build("second"), empty, "v1")
    return spark.read.parquet(outputs).select("nation", "n", F.bround("balance", 2).alias("balance"), "built")


@query("select event_id, event_type as name, case when event_type = 'click' or (event_type = 'view' and json_extract_string(props, '$.k') in ('1', '2', '3')) then json_extract_string(props, '$.k') end as k from events where event_type in ('click', 'view')")
def streamed_events(spark, sf_dir):
    """The whitelist as a stream that takes what is there and ends: files in, files out, its state in a checkpoint."""
    source, sink, state = (shared_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    told = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.from_json("props", "map<string,string>").alias("props"))
    told.write.parquet(source)
    allowed = {"click": {"k": None}, "view": {"k": ["1", "2", "3"]}}
    clean_stream(spark, source, "event_id long, name string, props map<string,string>", allowed, sink, state).start().awaitTermination()
    return spark.read.schema("event_id long, name string, props map<string,string>").parquet(sink).select("event_id", "name", F.try_element_at("props", F.lit("k")).alias("k"))


@query("select c_custkey from customer where c_custkey % 3 = 0 and (c_custkey % 4 = 0 or c_custkey % 5 = 0 or coalesce(try_cast(case when c_custkey % 7 = 0 then '2024-02-30' else '2024-02-03' end as date) is null, true))")
def unresolved_reviews(spark, sf_dir):
    k = F.col("c_custkey")
    told = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, "resolved").otherwise("open").alias("status"), F.when(k % 4 == 0, " ").otherwise("seen").alias("note"), F.when(k % 5 > 0, "r").alias("reviewer"), F.when(k % 7 == 0, "2024-02-30").otherwise("2024-02-03").alias("date"))
    return checks.unresolved_reviews(told, "status", "note", "reviewer", "date").select("c_custkey")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 10 and l_returnflag <> 'N' and l_discount < 0.08")
def combined_filters(spark, sf_dir):
    kept = serve.combined(F.col("l_quantity") > 10, None, F.col("l_returnflag") != "N", None, F.col("l_discount") < 0.08)
    return table(spark, sf_dir, "lineitem").where(kept).select("l_orderkey", "l_linenumber")


@query("select vec_id, round_even(cast(embedding[1] as double) * 2 - 79.5, 6) as lon, round_even(cast(embedding[2] as double) * 2 + 43.7, 6) as lat, cast(embedding[1] as double) > 0 as east from embeddings")
def projected_places(spark, sf_dir):
    """Places to metres of a zone and back; east of its middle line the metres are more than there."""
    lon, lat = F.get("embedding", F.lit(0)).cast("double") * 2 - 79.5, F.get("embedding", F.lit(1)).cast("double") * 2 + 43.7
    x, y = geo.to_metres(lon, lat, -79.5)
    told = table(spark, sf_dir, "embeddings").withColumns({"x": x, "y": y})
    origin = geo.to_metres(F.lit(-79.5), F.lit(43.7), -79.5)[0]
    back_lon, back_lat = geo.to_degrees(F.col("x"), F.col("y"), -79.5)
    return told.select("vec_id", F.bround(back_lon, 6).alias("lon"), F.bround(back_lat, 6).alias("lat"), (F.col("x") > origin).alias("east"))
