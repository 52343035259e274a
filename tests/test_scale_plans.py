"""Operators whose plans must hold at size: results against plain versions, hot keys, and what the plans move."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.operators import graph, metrics, pixels, serve, spatial, temporal, whatif, zones
from wayspan.plans import access


def plan(df):
    return df._jdf.queryExecution().toString()


def nearest(rows, key, target):
    own = [(abs(t - target), t, v) for k, t, v in rows if k == key and t is not None]
    return min(own)[1:] if own else None


def test_nearest_in_time_spreads_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 60)}", rng.randint(0, 900), rng.randint(0, 5)) for _ in range(4000)]
    rows += [(None, 3, 1), ("none", None, 1), ("hot", 450, -1), ("hot", 450, -2)]
    targets = sorted({(rng.choice(["hot", "hot", "k1", "k2", "k59", "lost"]), rng.randint(-50, 950)) for _ in range(600)}) + [("hot", 450), ("hot", 450), (None, 4)]
    got = temporal.nearest_in_time(spark.createDataFrame(targets, "k string, wish long"), spark.createDataFrame(rows, "k string, t long, v long"), "k", "t", "wish")
    want = {(k, w): nearest(rows, k, w) for k, w in targets if k is not None and nearest(rows, k, w)}
    assert {(r.k, r.wish): (r.t, r.v) for r in got.collect()} == want
    assert got.count() == len(want)


def test_nearest_in_time_of_one_key_in_many_ranges(spark):
    rows = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"))
    wish = spark.createDataFrame([(1, w) for w in (-5, 4, 5, 6, 100003, 199990, 10**7)], "k int, wish long")
    got = {r.wish: r.t for r in temporal.nearest_in_time(wish, rows, "k", "t", "wish").collect()}
    assert got == {-5: 0, 4: 0, 5: 0, 6: 10, 100003: 100000, 199990: 199990, 10**7: 199990}
    assert temporal.nearest_in_time(wish.limit(0), rows, "k", "t", "wish").count() == 0


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1.5, rng.uniform(-9, 9)])) for _ in range(5000)] + [("one", 7.0), ("empty", None)]
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {(r.g, r.share): r.quantile for r in metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    groups = {g: [v for k, v in rows if k == g and v is not None] for g in {g for g, _ in rows}}
    want = {(g, s): np.quantile(own, s) for g, own in groups.items() if own for s in shares}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    wide = {r.g: r for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 2.0).collect()}
    assert wide["empty"].n == 0 and wide["empty"].p50 is None and wide["one"].p99 == 7.0
    assert wide[None].n == len(groups[None]) and wide[None].above == sum(v > 2 for v in groups[None])


def test_neighbourhoods_move_the_grid_once(spark):
    rng = random.Random(8)
    cells = {(i, j): rng.choice([None, rng.randint(-3, 9)]) for i in range(-20, 21) for j in range(-15, 30)}
    frame = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()] + [(None, 1, 5), (1, None, 5)], "row long, col long, v long")
    square = lambda i, j, r: [v for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1) if (v := cells.get((a, b))) is not None]
    for radius, side in ((2, 3), (3, 3), (2, None), (0, 5)):
        got = {(x.row, x.col): (x.total, x.n) for x in pixels.focal_sums(frame, "v", radius, side).collect()}
        assert got == {(i, j): (sum(own) if own else None, len(own)) for i, j in cells for own in [square(i, j, radius)]}
    heights = frame.withColumn("height", F.col("v").cast("double")).withColumn("canopy", F.lit(True))
    for df in (pixels.focal_sums(frame, "v", 2), zones.corrected_heights(heights, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert pixels.focal_sums(frame.limit(0), "v", 2).count() == 0
    with pytest.raises(ValueError, match="block"):
        pixels.focal_sums(frame, "v", 5, 4)


def test_search_by_a_stored_index(spark, tmp_path):
    rng = random.Random(5)
    words = ["elm", "oak", "st", "a", "queen", "queens", "west", "north"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), i % 3) for i in range(300)] + [(900, None, 1), (901, "", 2), (902, "zebra", 2)]
    records = spark.createDataFrame(rows, "id int, name string, rank_of int")
    queries = spark.createDataFrame([(q,) for q in ("", " ", None, "queen", "queen we", "a", "st", "zebra", "zebras", "nowhere", "oak  elm", "elm", "elm")], "query string")
    serve.write_search_index(records, "id", F.col("name"), str(tmp_path / "i"), 8)
    got = serve.search_by_index(str(tmp_path / "i"), records, queries, "id", F.col("name"), "id", 5, 8)
    want = serve.search(records.where("name is not null"), queries.where("query is not null"), F.col("name"), "id", 5)
    told = lambda df: sorted((r.query, r.id, r["rank"]) for r in df.collect())
    assert told(got) == told(want) and ("zebra", 902, 1) in told(got)
    assert {r.query for r in got.collect()} == {"queen", "queen we", "a", "st", "zebra", "oak  elm", "elm"}
    text = plan(got)
    assert "WindowGroupLimit" in text  # only the best of a query's hits move
    one = plan(serve.search_by_index(str(tmp_path / "i"), records, queries.where("query = 'zebra'"), "id", F.col("name"), "id", 5, 8))
    scans = [line for line in one[one.index("== Physical Plan ==") :].splitlines() if "FileScan" in line and "key#" in line]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[[^]]*shard#\d+ = \d", scans[0]), scans  # of eight shards one is read
    assert serve.search_by_index(str(tmp_path / "i"), records, queries.limit(0), "id", F.col("name"), "id", 5, 8).count() == 0


def test_items_of_a_hot_group_are_numbered_in_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.choice([None, 1, 2, 3]), i) for i in range(900)] + [("c", 1, 5), ("c", 1, 5)]
    frame = spark.createDataFrame(rows, "g string, r int, id int")
    got = {(x.group, x.position): (x.place, x.id) for x in serve.ranked_group_rows(frame, F.col("g"), ["c", "hot"], "r", "id").collect()}
    want = {}
    for g in {g for g, _, _ in rows}:
        own = sorted((r is None, r or 0, i) for k, r, i in rows if k == g)
        want |= {(g, n): ({"c": 1, "hot": 2}.get(g, 3), i) for n, (_, _, i) in enumerate(own, 1)}
    assert got == want
    assert serve.ranked_group_rows(frame.limit(0), F.col("g"), ["c"], "r", "id").count() == 0


def ring_edges(name, ring):
    return [(name, *map(float, ring[i]), *map(float, ring[(i + 1) % len(ring)])) for i in range(len(ring))]


EDGES = "name string, ax double, ay double, bx double, by double"


def test_cover_grows_with_the_edge_not_the_area(spark):
    size = {}
    for side in (100, 1000):  # 10^4 and 10^6 cells inside
        ring = [(0.3, 0.2), (side + 0.3, 3.4), (side - 2.5, side + 0.1), (0.5, side - 1.2)]
        rim = spatial.rim_cells(spark.createDataFrame(ring_edges("p", ring), EDGES), "name", 1.0)
        blocks = spatial.inner_runs(rim, "name")
        covered = blocks.agg(F.sum(F.expr("shiftleft(1L, level)"))).first()[0]
        assert 0.9 * side**2 < covered < 1.01 * side**2
        size[side] = rim.count() + blocks.count()
    assert size[1000] < 40 * 1000 and size[1000] < 20 * size[100]


def test_cover_by_blocks_equals_crossing_counts(spark):
    rng = random.Random(8)
    rings = {}
    for k in range(6):
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))
        rings[f"p{k}"] = [(rng.uniform(-20, 20) + 30 * math.cos(t) * rng.uniform(0.4, 1.5), rng.uniform(-20, 20) + 30 * math.sin(t)) for t in turn]
    rings["low"] = [(-40, -40), (-8, -40), (-8, -8), (-40, -8)]  # on cell borders, negative cells
    edges = [e for name, ring in rings.items() for e in ring_edges(name, ring)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(500)]
    want = sorted((i, name) for i, x, y in points for name in rings if sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for n, ax, ay, bx, by in edges if n == name) % 2)
    frame, rows = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(edges, EDGES)
    for size in (1.0, 8.0, 300.0):
        assert sorted(map(tuple, spatial.points_in_polygons(frame, rows, "id", "name", size).collect())) == want


@pytest.mark.parametrize("delta", [None, 2.0])
def test_distances_in_steps_of_the_nearest(spark, delta):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(1, 9))) for _ in range(150)] + [(None, 3, 1.0), (5, 5, 1.0)]
    sources = [("a", 0, 0.0), ("a", 7, 1.5), ("b", 30, 0.0), ("far", 1, 99.0)]
    got = {(r.label, r.node): r.dist for r in graph.bounded_distances(spark.createDataFrame(edges, "src int, dst int, length double"), spark.createDataFrame(sources, "label string, node int, dist double"), 15.0, delta=delta, every=2).collect()}
    want = {}
    for label in "ab":
        dist = {n: d for lab, n, d in sources if lab == label}
        for _ in range(70):
            for s, t, w in edges:
                for u, v in ((s, t), (t, s)):
                    if u in dist and v is not None and dist[u] + w < dist.get(v, 15.0001):
                        dist[v] = dist[u] + w
        want |= {(label, n): d for n, d in dist.items()}
    assert got == want


def test_a_round_moves_no_edge(spark):
    dealt = graph.bucketed(spark.range(1000).selectExpr("id as src", "id + 1 as to"), "src")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = graph.checkpointed(spark.range(10).selectExpr("id as node"))
        text = near.join(dealt, near["node"] == dealt["src"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(node" in text and "Bucketed: true" in text


def test_components_of_a_chain_in_few_rounds(spark, monkeypatch):
    n, rounds, plain = 4000, [], graph.checkpointed
    ids = list(range(n))
    random.Random(6).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids[:-1], ids[1:])) + [(10**6, 10**6 + 1), (None, 3), (7, None)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (*ids, 10**6, 10**6 + 1, 10**7)], "node long")
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or plain(df))
    got = {r.node: r.component for r in graph.components(nodes, links).collect()}
    assert got == {i: 0 for i in ids} | {10**6: 10**6, 10**6 + 1: 10**6, 10**7: 10**7}
    assert len(rounds) < 3 * 1.6 * math.log2(n)  # three tables a round
    numbers = metrics.cluster_numbers(spark.createDataFrame(sorted(got.items()), "node long, component long"))
    assert {r.component: r.cluster for r in numbers.collect()} == {0: 0, 10**6: 1, 10**7: 2}


def test_greedy_selection_meets_copies_once(spark, monkeypatch):
    rng = random.Random(3)
    sets = [frozenset(rng.sample(range(60), rng.choice([1, 1, 2, 3, 5, 9, 20, 33, 40, 50]))) for _ in range(60)]
    sets += [frozenset([*rng.sample(sorted(s), -(-4 * len(s) // 5)), rng.randint(0, 60)]) for s in sets]  # near the share
    sets += [sets[0]] * 300 + [sets[5]] * 300
    rows = [(i, e) for i, s in enumerate(sets) for e in s] + [(9000, None), (9001, None)]
    order = sorted(range(len(sets)), key=lambda i: (-len(sets[i]), i))
    kept = []
    for i in order:
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i]) for k in kept):
            kept.append(i)
    sizes, plain = [], whatif.checkpointed
    monkeypatch.setattr(whatif, "checkpointed", lambda df: sizes.append((out := plain(df)).count()) or out)
    ranks = spark.createDataFrame([(c, r) for r, c in enumerate([*order, 9000, 9001, 9002])], "candidate_id int, rank int")
    got = whatif.greedy_distinct(spark.createDataFrame(rows, "candidate_id int, effect int"), ranks)
    assert sorted(r.candidate_id for r in got.where("kept").collect()) == sorted([*kept, 9000, 9001, 9002])
    assert got.count() == len(sets) + 3
    assert max(sizes) <= len(rows)  # 600 copies are no 180,000 pairs


def test_greedy_selection_drops_chance_rivals_in_the_join(spark, monkeypatch):
    rng = random.Random(8)
    sets = [frozenset(rng.sample(range(200), rng.choice([9, 10, 11, 12]))) for _ in range(800)]
    sets += [frozenset([*rng.sample(sorted(s), len(s) - 2), 300]) for s in sets[:40]]
    order = sorted(range(len(sets)), key=lambda i: (-len(sets[i]), i))
    kept = []
    for i in order:
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i]) for k in kept):
            kept.append(i)
    made, plain = [], whatif.checkpointed
    monkeypatch.setattr(whatif, "checkpointed", lambda df: made.append((df.columns, (out := plain(df)).count())) or out)
    rows = [(i, e) for i, s in enumerate(sets) for e in s]
    got = whatif.greedy_distinct(spark.createDataFrame(rows, "candidate_id int, effect int"), spark.createDataFrame([(c, r) for r, c in enumerate(order)], "candidate_id int, rank int"))
    assert sorted(r.candidate_id for r in got.where("kept").collect()) == sorted(kept)
    found = next(n for columns, n in made if columns == ["candidate_id", "rival"])
    assert found < len(sets)  # several thousand share two rare effects


def test_crossings_of_a_dense_cell_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 3, *(float(rng.randint(-9, 9)) for _ in range(4))) for i in range(150)] + [(200, 1, -90.0, -70.5, 80.0, 90.0), (201, 2, 50.0, 50.0, 40.0, 61.0)]
    side = lambda p, q, x, y: (p[4] - p[2]) * (y - p[3]) - (p[5] - p[3]) * (x - p[2])
    cross = lambda p, q: side(p, q, q[2], q[3]) * side(p, q, q[4], q[5]) < 0
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] != q[1] and cross(p, q) and cross(q, p))
    frame = spark.createDataFrame(rows, "s int, f int, ax double, ay double, bx double, by double")
    assert len(want) > 500
    for size, block in ((7.0, 20), (100.0, 20), (100.0, 2000)):
        monkeypatch.setattr(spatial, "BLOCK", block)
        found = spatial.segment_crossings(frame, "s", "f", size)
        assert sorted((r.a, r.b) for r in found.collect()) == want
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in text  # pairs are found once, none is taken out afterwards


def test_nearest_nodes_of_a_dense_place(spark, monkeypatch):
    rng = random.Random(6)
    nodes = [(i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(1500)] + [(2000 + i, 1.0, 1.0) for i in range(300)] + [(5000, 400.0, 0.0)]
    points = [(i, rng.gauss(0, 4), rng.gauss(0, 4)) for i in range(120)] + [(900, 1.0, 1.0), (901, 390.0, 3.0), (902, None, 1.0)]
    want = {p: min((math.dist((x, y), (a, b)), n) for n, a, b in nodes)[1] for p, x, y in points if x is not None}
    met, plain = [], spatial.with_neighbour_cells
    monkeypatch.setattr(spatial, "with_neighbour_cells", lambda df, x, y, size, ring=1: met.append((df, size)) or plain(df, x, y, size, ring))
    got = spatial.nearest_node(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(nodes, "n int, x double, y double"), "p", "n", "x", "y", 20.0)
    assert {r.p: r.n for r in got.collect()} == want
    cells = spark.createDataFrame(nodes, "n int, nx double, ny double").dropDuplicates(["nx", "ny"])
    tested = sum(plain(df, "px", "py", size).join(spatial.with_cell(cells, "nx", "ny", size).hint("merge"), ["_cx", "_cy"]).count() for df, size in met)
    assert tested < 120 * 100  # all points with all nodes are 220,000


def test_reached_ends_meet_without_a_full_join(spark):
    edges = [(1, 2, 4.0), (2, 3, 2.0), (3, 4, 1.0), (4, 5, 8.0), (1, 5, 20.0)]
    near = [("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, 5.0), ("b", 5, 3.0), ("b", 4, 4.5)]
    frame = spark.createDataFrame(edges, "src int, dst int, length double")
    got = graph.edge_reach(frame, spark.createDataFrame(near, "label string, node int, dist double"), 5.0)
    told = sorted(tuple(r) for r in got.collect())
    assert told == [("a", 1, 2, 0.0, 1.0), ("a", 1, 5, 0.0, 0.25), ("a", 2, 3, 0.0, 0.5), ("b", 1, 5, 0.9, 1.0), ("b", 3, 4, 0.5, 1.0), ("b", 4, 5, 0.0, 0.0625), ("b", 4, 5, 0.75, 1.0)]
    assert "FullOuter" not in plan(got)
    parallel = spark.createDataFrame([(1, 2, 7.0), (2, 1, 3.0), (2, 3, 9.0), (4, 4, 1.0)], "src int, dst int, length double")
    assert [tuple(r) for r in graph.shortest_edges(parallel, 5.0).collect()] == [(1, 2, 3.0)]


def test_reachable_edges_start_at_suppliers_of_all_nations(spark, sf):
    own = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/lineitem.parquet"), F.expr("s_suppkey = l_suppkey"))
    want = {r[0] for r in own.select("s_nationkey").distinct().collect()}
    assert max(want) >= 5
    assert {r.label for r in access.QUERIES["reachable_edges"](spark, sf).collect()} == want
