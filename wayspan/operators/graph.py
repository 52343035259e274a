"""Graphs as edge tables: shortest edges, bounded distances, components, coverage."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared checkpoint folder. Where none is set, only a session on one machine gets a folder
    of its own: executors of a cluster would not see it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration: df as a table in the shared folder, computed once."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt and sorted by key: joins on the key read it where it lies."""
    spark = df.sparkSession
    path, n = shared_path(spark, "buckets"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = os.path.basename(path).replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def network_tables(lines: DataFrame, line: str, coords: str, length: str, digits: int = 7) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of polylines with coords (array of lon/x, lat/y structs): nodes are the end points rounded to
    digits (node, x, y), edges (src, dst, length) the shortest of parallel lines; lines that close on themselves go."""
    names = [f.name for f in lines.schema[coords].dataType.elementType.fields]
    end = lambda p: F.struct(*[(F.bround(F.col(f"{p}.{n}"), digits) + 0.0).alias(k) for n, k in zip(names, ("x", "y"), strict=False)])
    told = lines.where(F.size(coords) >= 2).withColumns({"_a": F.element_at(coords, 1), "_z": F.element_at(coords, -1)})
    told = told.select(F.col(line).alias("line"), F.col(length).alias("length"), end("_a").alias("a"), end("_z").alias("z"))
    name = lambda p: F.concat_ws(",", F.col(f"{p}.x").cast("string"), F.col(f"{p}.y").cast("string"))
    nodes = told.select(F.explode(F.array("a", "z")).alias("p")).distinct().select(name("p").alias("node"), "p.x", "p.y")
    return nodes, shortest_edges(told.select(name("a").alias("src"), name("z").alias("dst"), "length"))


def shortest_edges(edges: DataFrame, within: float | None = None) -> DataFrame:
    """Undirected (src, dst, length), src < dst, the shortest of parallel edges; loops go. within: only edges of that
    length at most, left out before they move."""
    ends = edges.where("src <> dst" if within is None else (F.col("src") != F.col("dst")) & (F.col("length") <= within)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "length")
    return ends.groupBy("src", "dst").agg(F.min("length").alias("length"))


def bounded_distances(edges: DataFrame, sources: DataFrame, cutoff: float, delta: float | None = None, every: int = 8) -> DataFrame:
    """(label, node, dist): distance from the nearest source of the label, offsets included, at most cutoff.

    sources: label, node, dist (start offsets). All labels are solved together. Edges that can matter (no longer than
    the cutoff) are dealt by node once; a round's frontier comes to them, so no round moves an edge. Each round only
    rows that got better go on, the nearest first: those within `delta` of the nearest that waits (all, without
    delta), so far rows don't spread distances that nearer ones would mend. What is known is the base plus the rounds
    since; these are folded into the base every few rounds. Rounds go on until nothing waits; lengths must not be
    negative.
    """
    useful = edges.where((F.col("length") <= cutoff) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    ways = F.array(F.struct("src", F.col("dst").alias("to")), F.struct(F.col("dst").alias("src"), F.col("src").alias("to")))
    both = bucketed(useful.select(F.explode(ways).alias("w"), "length").select("w.*", "length"), "src")
    best = lambda df: df.groupBy("label", "node").agg(F.min("dist").alias("dist"))
    base = waiting = checkpointed(best(sources.where(F.col("dist") <= cutoff).select("label", "node", "dist")))
    later: list[DataFrame] = []
    while (least := waiting.agg(F.min("dist")).first()[0]) is not None:
        near = waiting if delta is None else waiting.where(F.col("dist") <= least + delta)
        # tables are written, so their sizes are known: a small frontier is sent to the edges, a large one is dealt as they are
        step = near.join(both, near["node"] == both["src"]).select("label", F.col("to").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).where(F.col("dist") <= cutoff)
        known = best(reduce(DataFrame.union, later, base)).withColumnRenamed("dist", "old")
        better = checkpointed(best(step).join(known, ["label", "node"], "left").where("old is null or dist < old").drop("old"))
        far = None if delta is None else waiting.where(F.col("dist") > least + delta)
        # rows that wait and have been bettered meanwhile go on with the better value only
        waiting = better if far is None else checkpointed(best(far.unionByName(better)))
        later.append(better)
        if len(later) == every:
            base, later = checkpointed(best(reduce(DataFrame.union, later, base))), []
    return best(reduce(DataFrame.union, later, base))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest listed node that is reachable over links (a, b); null ends link nothing.

    Randomised contraction: each round orders nodes by a hash of its own, every node goes over to the first of itself
    and its neighbours, and the links between what is left go on, without repeats. Links shrink by a constant share a
    round in expectation, so rounds grow with the logarithm of the nodes, whatever the shape (a chain, a star); the
    moves of all rounds are then followed from the last to the first.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = checkpointed(links.where("a <> b").select(F.explode(ways).alias("w")).select("w.*").distinct())
    moves: list[DataFrame] = []
    while not links.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = links.groupBy("a").agg(F.min(place("b")).alias("m"))
        moved = checkpointed(first.select(F.col("a").alias("node"), F.least(F.col("m"), place("a"))["n"].alias("to")))
        at = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        links = checkpointed(links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct())
        moves.append(moved)
    roots = None
    for moved in reversed(moves):
        # those who moved on to a node that moved again
        onward = None if roots is None else roots.select(F.col("node").alias("to"), F.col("root"))
        roots = moved.withColumnRenamed("to", "root") if onward is None else checkpointed(moved.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    if roots is None:
        return nodes.select("node", F.col("node").alias("component"))
    told = checkpointed(nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    least = told.groupBy("root").agg(F.min("node").alias("component"))
    return told.join(least, "root").select("node", "component")


def covered(distances: DataFrame, stops: DataFrame, limit: float) -> DataFrame:
    """(label, stop_id, dist): stops (stop_id, node, offset) whose distance and own offset stay within the limit."""
    return distances.join(stops, "node").withColumn("total", F.col("dist") + F.col("offset")).where(F.col("total") <= limit).groupBy("label", "stop_id").agg(F.min("total").alias("dist"))


def edges_inside(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges both of whose ends are reached."""
    keys = reached.select("node").distinct()
    return edges.join(keys.withColumnRenamed("node", "src"), "src", "left_semi").join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi")


def edge_reach(edges: DataFrame, distances: DataFrame, budget: float) -> DataFrame:
    """(label, src, dst, from_share, to_share): the walkable parts of each edge; whole where both ends' shares meet.

    Ends that are not nearer than the budget reach no part, so they meet no edge; an edge's two ends are brought
    together by an aggregation, without a join of the two sides. Edges are unique, as are distances of a label and node.
    """
    near = distances.where(F.col("dist") < budget).select("label", "node", "dist")
    end = lambda at, mine, its: edges.join(near.withColumnRenamed("node", at), at).select("label", "src", "dst", "length", F.col("dist").alias(mine), F.lit(None).cast(near.schema["dist"].dataType).alias(its))
    both = end("src", "da", "db").unionByName(end("dst", "db", "da"))
    met = both.groupBy("label", "src", "dst", "length").agg(F.min("da").alias("da"), F.min("db").alias("db"))
    share = lambda d: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(budget) - F.col(d)) / F.col("length"))), F.lit(0.0))
    told = met.withColumns({"fa": share("da"), "fb": share("db")})
    span = lambda s, e: F.struct(s.cast("double").alias("from_share"), e.cast("double").alias("to_share"))
    parts = F.when(F.col("fa") + F.col("fb") >= 1, F.array(span(F.lit(0), F.lit(1)))).otherwise(F.array(span(F.lit(0), F.col("fa")), span(1 - F.col("fb"), F.lit(1))))
    return told.select("label", "src", "dst", F.explode(parts).alias("p")).select("label", "src", "dst", "p.*").where("to_share > from_share")


def network_summary(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Nodes, edges, components and the largest one's share, as one row."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = components(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return out.join(edges.agg(F.count(F.lit(1)).alias("edges")).hint("broadcast"))  # one row each
