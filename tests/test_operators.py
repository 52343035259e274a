"""Operators on small literal tables: the cases that the tables of the queries don't hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayspan.functions import bits, geo, text, ways
from wayspan.operators import checks, feeds, graph, metrics, pixels, reviews, serve, sizes, spatial, temporal, whatif, zones
from wayspan.sources import files
from wayspan.streaming.events import clean_stream


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_service_seconds_pass_midnight(spark):
    assert one(spark, t="24:30:00").select(temporal.service_seconds(F.col("t"))).first()[0] == 88200


def test_windows_overlap_and_wrap(spark):
    events = spark.createDataFrame([(1, 705), (2, 704), (3, 735), (4, 736), (5, 1435), (6, 10)], "id int, minute int")
    windows = spark.createDataFrame([(0, 720), (1, 730), (2, 5)], "window_id int, centre int")
    got = {tuple(r) for r in temporal.events_in_windows(events, windows, "minute", 15, 1440).select("id", "window_id").collect()}
    assert got == {(1, 0), (3, 0), (3, 1), (4, 1), (5, 2), (6, 2)}


WEEK = range(7)


@pytest.mark.parametrize(
    ("hours", "known", "rows"),
    [
        ("Mon-Wed: 9am until 5:30pm", True, {(d, 540, 1050) for d in (0, 1, 2)}), ("sat-mon 10pm-2am", True, {(d, 1320, 1560) for d in (5, 6, 0)}), ("weekends & holidays 12am to 12pm", True, {(5, 0, 720), (6, 0, 720)}),
        ("mon-fri 9am-5pm, sat 10am-4pm", True, {(d, 540, 1020) for d in range(5)} | {(5, 600, 960)}), ("weekend 10am-4pm", True, {(5, 600, 960), (6, 600, 960)}), ("Tuesday closed; Wed 9am-10am & 3pm-4pm", True, {(2, 540, 600), (2, 900, 960)}),
        ("6 a.m. to 2 a.m.", True, {(d, 360, 1560) for d in WEEK}), ("Closed", True, set()), ("mon 9am-5pm; ask staff", False, set()), ("daily 9am-5pm", False, set()), ("weekdays 9am-5pm", False, set()), ("9AM-5PM", False, set()), ("mon-friday 9am-5pm", False, set()),
        ("mon & wed 9am-5pm", False, set()), ("weekend-mon 9am-5pm", False, set()), ("9amto 5pm", False, set()), ("View hours", False, set()), ("mon\n 9am-5pm", True, {(0, 540, 1020)}), ("Mon 9am-5pm;\nTue closed", False, set()), ("Mon 9am-5pm, , Tue closed", False, set()), ("Sat and holidays: 9 a.m-5 p.m.", True, {(5, 540, 1020)}), ("monday - wed & holiday 09:05am - 5pm", True, {(d, 545, 1020) for d in range(3)}), ("Centre hours", False, set()), ("", False, set()), (None, False, set()),
    ],
)
def test_weekly_hours(spark, hours, known, rows):
    got = temporal.weekly_hours(spark.createDataFrame([(hours,)], "h string"), "h").collect()
    assert {r.hours_known for r in got} == {known}
    assert {(r.weekday, r.start_min, r.end_min) for r in got if r.weekday is not None} == rows


def test_availability_carries_over_midnight(spark):
    places = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True)], "place_id int, hours_known boolean, temporarily_closed boolean")
    hours = spark.createDataFrame([(1, 6, 1320, 1560), (3, 0, 0, 1440)], "place_id int, weekday int, start_min int, end_min int")
    moments = spark.createDataFrame([(0, 0, 119), (1, 0, 120), (2, 6, 1320)], "moment_id int, weekday int, minute int")
    got = {(r.place_id, r.moment_id): r.state for r in temporal.availability(places, hours, moments).collect()}
    assert [got[1, m] for m in range(3)] == ["open", "closed", "open"]
    assert got[2, 0] == "unknown" and got[3, 0] == "temporarily closed"


def told(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text_columns(spark):
    lit = F.lit
    assert told(spark, *[text.species_key(lit(x)) for x in ("Acer rubrum 'Red'", "Acer \u00d7 freemanii", "Acer Brandywine", " ", "Ulmus")]) == ("Acer rubrum", "Acer x", "Acer", "?", "Ulmus")
    assert told(spark, *[text.genus_category(lit(x)) for x in ("Acer", "Cupressus", "Maackia", "Fraxinus", "Celtis")]) == (0, 4, 7, 9, 10)
    assert told(spark, text.canonical_address(lit("12 Main Street North, rear")), text.canonical_address(lit("5 Oak Lane")), text.text_key(lit("\u216b  Stra\u00dfe"))) == ("12 main st n", "5 oak lane", "xii strasse")
    assert told(spark, *[text.closure_category(lit(x)) for x in ("Closed for the season", "repair of roof", "open as usual", "", "Under Construction", "planned work")]) == ("seasonal", "temporary", "none", "none", "construction", "temporary")
    assert told(spark, *[text.title_address(lit(n), lit(x)) for n, x in (("67", "TORRANCE RD"), ("0", "THE MCCAUL ST OF MC"), ("7.0", "x"), (None, "the and"))]) == ("67 Torrance Rd", "the McCaul St of Mc", "X", "the And")
    assert told(spark, *[text.display_name(lit(x)) for x in ("Maple, Norway", "Maple,", "Ginkgo", "Oak, red, x")]) == ("Norway maple", "Maple", "Ginkgo", "Red oak")
    links = ("https://u:p@x.org/a", "https://x.org/a", "data/a.json", "/data/a?b#c%20", "/data/../a", "http://x.org", "//x.org", "")
    assert told(spark, *[text.safe_link(lit(x)) for x in links]) == (False, True, False, True, False, False, False, False)
    assert told(spark, text.slug(lit("Caf\u00e9  St. Clair")), text.search_key(lit(" \u00c9glise-du N\u00b0 5 ")), text.first_nonblank(lit(" "), lit(None), lit(" x "))) == ("cafe-st-clair", "eglise du n 5", "x")
    assert told(spark, text.slug(lit("!!")))[0].startswith("street-")
    ids = told(spark, *[text.public_id(lit(x)) for x in ("parks:7", "parks:a b", "a b", "no good:x y")])
    assert ids[0] == "parks:7" and [x.split(":")[0] for x in ids[1:]] == ["parks", "place", "place"] and len(ids[1]) == 70
    assert told(spark, text.source_label(lit(None), lit(None), lit("ttc:9"), lit(None)), text.source_label(lit(None), lit(None), lit(None), lit("https://www.ttc.ca/x")), text.action_label(lit("verify"), lit("hours")), text.action_label(lit(None), lit(None))) == ("TTC station washrooms", "TTC station washrooms", "Verify hours", "Open at selected time")


def test_states_of_places(spark):
    lit = F.lit
    assert told(spark, *[temporal.state_name(lit("temporarily closed"), lit(x)) for x in ("seasonal", "construction", "temporary", "none")]) == ("seasonal_closed", "construction_closed", "temporary_closed", "temporary_closed")
    state = lambda *x: temporal.effective_state(*map(lit, x))
    assert told(spark, state("temporary_closed", "closed", "normal_operations", "x"), state("seasonal_closed", "open", "normal_operations", "x"), state("temporary_closed", "unknown", "normal_operations", "optimistic_information"), state("unknown_hours", "open", "observed", "optimistic_information")) == ("scheduled_closed", "seasonal_closed", "potential_open", "potential_open")
    pairs = {"Mon": (lit("9am to 12pm and"), lit("1pm to 5pm")), "Tue": (lit("Closed"), lit("x")), "Wed": (lit("9am"), lit("9am")), "Thu": (lit("permits"), lit("only")), "Fri": (lit(None), lit("5pm"))}
    assert told(spark, temporal.hours_text(pairs)) == ("Mon 9am to 12pm & 1pm to 5pm; Tue Closed; Wed 9am to 9am; Thu Closed; Fri Closed",)


def test_stability_needs_the_primary_rank(spark):
    rows = [(c, i, r, i == 0) for c, ranks in {"a": [20, 1, 2, 3, 20], "b": [21, 1, 1, 1, 1], "c": [1, 2, 3, 30, None], "d": [1, 30, 30, 30, 2], "e": [None, 1, 1, 1, 1]}.items() for i, r in enumerate(ranks)]
    got = metrics.stability(spark.createDataFrame(rows, "c string, s int, r int, first boolean"), ["c"], "r", "first").collect()
    assert {x.c: x.stability for x in got} == {"a": "robust", "b": "not prioritized", "c": "mostly robust", "d": "sensitive", "e": "not prioritized"}


def test_gap_flags(spark):
    def flags(**near):
        row = {f"{c}_distance": float(near.get(c, 999)) for c in reviews.EVIDENCE}
        out = reviews.gap_flags(spark.createDataFrame([tuple(row.values())], list(row)), 400).first()
        return {g for g in reviews.GAPS if out[g]}

    assert flags() == {"geographic_gap"}
    assert flags(documented=400, scheduled_closed=400) == {"scheduled_time_gap"}
    assert flags(documented=1, construction_closed=1, seasonal_closed=1, unknown_hours=1) == {"temporary_service_gap", "seasonal_gap", "information_gap"}
    assert flags(documented=1, open=1, open_inaccessible=1, open_unknown_accessibility=1) == {"accessibility_gap", "information_gap"}
    assert flags(documented=1, open=1, open_inaccessible=1, open_accessible=1, scheduled_closed=1) == set()


def test_street_ids_come_before_lengths(spark):
    parts = spark.createDataFrame([("A b", 50.0), ("a-b", 150.0), ("\ufb01n Way", 90.0), ("FIN way", 60.0), ("\ufb01n Way", 10.0), ("  ", 500.0), (None, 500.0)], "name string, length double")
    got = {r.key: (r.street_id, r.name, r.parts) for r in zones.named_streets(parts, "name", "length").collect()}
    assert set(got) == {"a-b", "fin way"}
    assert got["a-b"][0].startswith("a-b-") and len(got["a-b"][0]) == 12  # the short street holds the plain id
    assert got["fin way"] == ("fin-way", "fin Way", 3)


def test_sides_beyond_the_broadcast_bound_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(sizes.small, "__defaults__", (2,))
    queries = spark.createDataFrame([(q,) for q in ("ab", "b c", "", "zz", "c")], "query string")
    records = spark.createDataFrame([(1, "ab c"), (2, "b"), (3, "c ab"), (4, "")], "id int, t string")
    got = {(r.query, r.id) for r in serve.search(records, queries, F.col("t"), "id", 9).collect()}
    assert got == {("ab", 1), ("ab", 3), ("b c", 1), ("b c", 3), ("c", 1), ("c", 3)}  # an empty query finds nothing
    moments = spark.createDataFrame([(i, i % 7, 60 * i) for i in range(20)], "moment_id int, weekday int, minute int")
    places = spark.createDataFrame([(1, True, False)], "place_id int, hours_known boolean, temporarily_closed boolean")
    hours = spark.createDataFrame([(1, d, 0, 1440) for d in range(7)], "place_id int, weekday int, start_min int, end_min int")
    assert temporal.availability(places, hours, moments).where("state = 'open'").count() == 20
    windows = spark.createDataFrame([(i, i * 10) for i in range(9)], "window_id int, centre int")
    events = spark.createDataFrame([(i, i) for i in range(0, 90, 5)], "id int, minute int")
    assert temporal.events_in_windows(events, windows, "minute", 5).count() == 26


def test_projection_round_trip(spark):
    rnd = random.Random(1)
    frame = spark.createDataFrame([(rnd.uniform(-84, -78), rnd.uniform(-60, 70)) for _ in range(200)], "lon double, lat double")
    x, y = geo.to_metres(F.col("lon"), F.col("lat"), -81.0)
    there = frame.withColumns({"x": x, "y": y})
    lon, lat = geo.to_degrees(F.col("x"), F.col("y"), -81.0)
    off = there.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(off) < 1e-7
    # on the central meridian the northing is the scaled meridian arc; 45 degrees lie 4984944.378 m from the equator
    mid = one(spark, lon=-81.0, lat=45.0).select(*geo.to_metres(F.col("lon"), F.col("lat"), -81.0)).first()
    assert mid[0] == pytest.approx(500000) and mid[1] == pytest.approx(4984944.378 * 0.9996, abs=0.01)


def test_mask_overview_votes(spark):
    rows = [(0, 0, 0b11, True), (0, 1, 0b01, True), (1, 0, 0b01, False), (1, 1, 0b10, True), (2, 0, 1, True), (2, 1, 1, False)]
    got = {(r.row, r.col): (r.bits, r.ground) for r in pixels.overview_mask(spark.createDataFrame(rows, "row long, col long, bits int, ground boolean"), "bits", "ground").collect()}
    assert got == {(0, 0): (0b11, True), (1, 0): (0, False)}
    with pytest.raises(ValueError, match="frames"):
        bits.all_hours(16)


def test_bounded_distances_equal_dijkstra(spark):
    import heapq

    rnd = random.Random(6)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(1, 9))) for _ in range(90)]
    sources = [("a", 0, 0.0), ("a", 1, 2.0), ("b", 5, 1.0)]
    frame = graph.shortest_edges(spark.createDataFrame(edges, "src long, dst long, length double"))
    got = {(r.label, r.node): r.dist for r in graph.bounded_distances(frame, spark.createDataFrame(sources, "label string, node long, dist double"), 12.0).collect()}
    want = {}
    for label in "ab":
        heap = [(d, n) for k, n, d in sources if k == label]
        while heap:
            d, n = heapq.heappop(heap)
            if d > 12 or want.get((label, n), 99) <= d:
                continue
            want[label, n] = d
            for s, e, w in edges:
                for p, q in ((s, e), (e, s)):
                    if p == n and s != e:
                        heapq.heappush(heap, (d + w, q))
    assert got == want


def test_greedy_rounds_equal_the_sequential_loop(spark):
    rnd = random.Random(9)
    effects = {c: {rnd.randrange(12) for _ in range(rnd.randrange(1, 6))} for c in range(40)}
    kept = []
    for c in range(40):
        if not any(len(effects[c] & effects[k]) >= 0.8 * len(effects[c]) for k in kept):
            kept.append(c)
    rows = spark.createDataFrame([(c, e) for c, own in effects.items() for e in own], "candidate_id int, effect int")
    ranks = spark.createDataFrame([(c, c) for c in effects], "candidate_id int, rank int")
    got = sorted(r.candidate_id for r in whatif.greedy_distinct(rows, ranks).where("kept").collect())
    assert got == kept


def test_polygon_boundary_counts(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    edges = spark.createDataFrame([("s", *map(float, square[i]), *map(float, square[(i + 1) % 4])) for i in range(4)], "name string, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 11.0, 5.0), (4, 0.0, 0.0), (5, 5.0, 10.0)], "id int, x double, y double")
    assert sorted(r.id for r in spatial.points_in_polygons(points, edges, "id", "name", 4.0).collect()) == [1, 2, 4, 5]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, (i * 37) % 100 / 3.0, (i * 53) % 100 / 3.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, x double, y double")
    seen = []
    for n in (1, 7, 40):
        seen.append((sorted(map(tuple, spatial.pairs_within(frame.repartition(n), "id", "x", "y", 4.0).collect())), sorted(map(tuple, metrics.numbered(frame.repartition(n), ["x", "y", "id"]).collect()))))
    assert seen[0] == seen[1] == seen[2]
    assert [r[3] for r in sorted(seen[0][1], key=lambda r: (r[1], r[2], r[0]))] == list(range(100))


def test_nearest_node_finds_far_nodes_and_ties(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e7, -1e7), (3, None, 0.0)], "p int, x double, y double")
    nodes = spark.createDataFrame([(7, 3.0, 4.0), (5, -3.0, 4.0), (9, 1e6, 1e6)], "n int, x double, y double")
    got = {r.p: (r.n, r.metres) for r in spatial.nearest_node(points, nodes, "p", "n", "x", "y", 1.0).collect()}
    assert got[1] == (5, 5.0) and got[2][0] == 7 and set(got) == {1, 2}
    assert spatial.nearest_node(points, nodes.limit(0), "p", "n", "x", "y", 1.0).count() == 0


def test_polygons_of_many_cells(spark):
    rnd = random.Random(3)
    ring = [(0.0, 0.0), (50.0, 5.0), (45.0, 60.0), (20.0, 20.0), (-10.0, 40.0)]
    hole = [(25.0, 8.0), (35.0, 8.0), (35.0, 15.0), (25.0, 15.0)]
    edges = [("a", *r[i], *r[(i + 1) % len(r)]) for r in (ring, hole) for i in range(len(r))]
    points = [(i, rnd.uniform(-15, 55), rnd.uniform(-5, 65)) for i in range(400)]
    want = sorted(i for i, x, y in points if sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for _, ax, ay, bx, by in edges) % 2)
    frame = spark.createDataFrame(points, "id int, x double, y double")
    rows = spark.createDataFrame(edges, "name string, ax double, ay double, bx double, by double")
    for size in (3.0, 17.0, 200.0):
        assert sorted(r.id for r in spatial.points_in_polygons(frame, rows, "id", "name", size).collect()) == want


def test_corrected_heights_equal_a_padded_box(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    height, canopy, r = rng.integers(0, 12, (9, 11)).astype(float), rng.random((9, 11)) < 0.4, 3
    canopy[:, 6:] = False
    canopy[8, 10] = True
    height[8, 10] = 0
    crown = canopy & (height >= 3)
    pad = lambda x: np.pad(x.astype(float), r, mode="edge")
    box = lambda x: np.array([[pad(x)[i : i + 2 * r + 1, j : j + 2 * r + 1].sum() for j in range(11)] for i in range(9)])
    s, n = box(np.where(crown, height, 0)), box(crown)
    low = canopy & (height < 3)
    want = np.where(low, np.where(n > 0.5, s / np.maximum(n, 1), 8.0), height)
    frame = spark.createDataFrame([(i, j, float(height[i, j]), bool(canopy[i, j])) for i in range(9) for j in range(11)], "row int, col int, height double, canopy boolean")
    for side in (None, 4, 3):
        got = zones.corrected_heights(frame, r, side=side).collect()
        assert len(got) == 99 and all(abs(x.corrected - want[x.row, x.col]) < 1e-9 for x in got) and {x.source for x in got} == {"measured", "default", "kept"}


def test_zones_that_cannot_be(spark):
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0), ("b", 10.0, 0.0, 20.0, 10.0), ("c", 9.0, 9.0, 12.0, 12.0)], "tile string, x0 double, y0 double, x1 double, y1 double")
    pixels_ = spark.createDataFrame([("a", 1, 1, 5)], "tile string, row int, col int, value int")
    with pytest.raises(ValueError, match="overlap"):
        zones.mosaic(tiles, pixels_, "tile", 8.0)
    assert zones.mosaic(tiles.where("tile <> 'c'"), pixels_, "tile", 8.0).count() == 1
    edges = spark.createDataFrame([("n", 0.0, 0.0, 1.0, 1.0)], "name string, ax double, ay double, bx double, by double")
    with pytest.raises(ValueError, match="elsewhere"):
        zones.lines_touching(edges.withColumn("s", F.lit(1)), edges, "s", "name", ["n", "elsewhere"], 1.0)
    with pytest.raises(ValueError, match="band"):
        zones.band_labels(pixels_, edges, "name", 3.0, 2.0, 0.0, 0.0, 1.0)
    with pytest.raises(ValueError, match="hours"):
        temporal.chosen_frames(spark.createDataFrame([(9, 1.0)], "hour int, altitude double"), [9, 10])


def test_rays_meet_what_looks_highest(spark):
    heights = spark.createDataFrame([(5, 6, 10.0), (5, 8, 40.0), (5, 9, 50.0), (4, 5, 3.0), (5, 5, 0.0)], "row int, col int, height double")
    points = [(1, 5, 5, 0.0, 30.0, 90.0), (2, 5, 5, 0.0, 0.5, 90.0), (3, 5, 5, 0.0, 60.0, 90.0), (4, 5, 5, 0.0, 30.0, 0.0), (5, 5, 5, 0.0, 30.0, 270.0), (6, 5, 5, None, 30.0, 90.0)]
    frame = spark.createDataFrame(points, "point_id int, row int, col int, height double, altitude double, azimuth double")
    got = {r.point_id: (r.row, r.col, r.distance) for r in spatial.ray_obstruction(frame, heights, 2.0, 10.0).collect()}
    assert got == {1: (5, 8, 6.0), 2: (None,) * 3, 3: (5, 8, 6.0), 4: (4, 5, 2.0), 5: (None,) * 3, 6: (None,) * 3}


def test_orders(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, "\u00c4", 3), (3, "A", 1), (4, "a", None), (5, "B", 1)], "id int, name string, rank int")
    assert [r.id for r in serve.in_name_order(rows, "name", "id").collect()] == [3, 4, 1, 5, 2]
    assert [r.id for r in serve.in_rank_order(rows, "rank", "id").collect()] == [3, 5, 2, 1, 4]


def test_vertices_on_segments(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0)], "s int, ax double, ay double, bx double, by double")
    vertices = spark.createDataFrame([(1, 5.0, 0.01), (2, 5.0, 0.03), (3, 0.0, 0.0), (4, 10.0, 0.01)], "v int, x double, y double")
    assert [(r.v, r.s) for r in spatial.vertices_on_segments(vertices, segments, "v", "s", 0.02, 4.0).collect()] == [(1, 1)]


def test_network_summary(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src long, dst long")
    out = graph.network_summary(spark, edges).first()
    assert (out.nodes, out.edges, out.components) == (5, 3, 2) and out.largest_share == 0.6


def test_reviews_and_runs(spark):
    rows = [(1, "resolved", "n", "r", "2026-07-21"), (2, "resolved", " ", "r", "2026-07-21"), (3, "resolved", "n", "r", "soon"), (4, "open", None, None, None)]
    frame = spark.createDataFrame(rows, "id int, status string, note string, reviewer string, day string")
    assert [r.id for r in checks.unresolved_reviews(frame, "status", "note", "reviewer", "day").collect()] == [2, 3]
    masks = spark.createDataFrame([(1, 1, 1, True, 0), (2, 2, 1, True, 0), (3, 1, 1, True, 7), (4, 1 << 15, 1, False, 0), (5, 3, 1, True, 0), (6, 2, 1, False, 0)], "id int, bits int, n int, ground boolean, reserved int")
    assert sorted(r.id for r in checks.bad_masks(masks, "bits", "n", F.col("ground"), "reserved").collect()) == [2, 3, 4, 5]
    assert told(spark, serve.combined(None, F.lit(1) == 1, F.lit(True)), serve.combined(None), bits.is_ground(F.lit(True), F.lit(1.9)), bits.is_ground(F.lit(True), F.lit(2.0))) == (True, True, True, False)
    assert told(spark, bits.packed({0: F.lit(True), 3: F.lit(None).cast("boolean"), 5: F.lit(True)}), F.array_join(bits.profile(F.lit(5), 4).cast("array<string>"), "")) == (33, "1010")


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,name\n1,x\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_table_csv(spark, str(tmp_path / "a.csv"), "id STRING, name STRING, more STRING").collect()] == [("1", "x", None), ("2", None, None)]
    (tmp_path / "b.csv").write_text('name,id\n"y, z",3\n', encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_table_csv(spark, str(tmp_path / "*.csv"), "id STRING, name STRING").collect()) == [("1", "x"), ("2", None), ("3", "y, z")]
    feature = lambda c, k="Point": {"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"name": "n", "n": 3}}
    (tmp_path / "f.json").write_text(json.dumps({"features": [feature([1.5, -2]), feature([[3, 4], [5, 6]], "MultiPoint"), feature([])]}))
    assert [tuple(r) for r in files.read_features(spark, str(tmp_path / "f.json"), "name:string,n:int").collect()] == [(1.5, -2.0, "n", 3), (3.0, 4.0, "n", 3)]
    way = {"type": "way", "id": 7, "tags": {"highway": "path", "x": "y"}, "geometry": [{"lon": 1, "lat": 2}, {"lon": 3, "lat": 4}]}
    (tmp_path / "w.json").write_text(json.dumps({"elements": [way, {"type": "node", "id": 8}, {"type": "way", "id": 9, "geometry": [{"lon": 1, "lat": 2}]}]}))
    (tmp_path / "w.ndjson").write_text(json.dumps(way) + "\n")
    for name, lines in (("w.json", False), ("w.ndjson", True)):
        got = files.read_ways(spark, str(tmp_path / name), ["highway"], {"tier": ways.street_tier, "walkable": ways.walkable}, lines).collect()
        assert [(r.way_id, r.tags, r.tier, r.walkable) for r in got] == [(7, {"highway": "path"}, "major", False)]
    (tmp_path / "k.json").write_text(json.dumps({"a": {"open": "9"}, "b": {"open": "10"}}))
    assert {tuple(r) for r in files.read_keyed_json(spark, str(tmp_path / "k.json"), "open:string").collect()} == {("a", "9"), ("b", "10")}
    grid = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col", "id as v")
    files.write_pixels(grid, str(tmp_path / "px"), 4)
    assert files.read_pixels(spark, str(tmp_path / "px"), (2, 5, 3, 9), 4).count() == 18
    nan = spark.createDataFrame([(1.0, 2.0, float("nan"), 4)], "lon double, lat double, b double, a int")
    files.write_features(nan, str(tmp_path / "nan"), "lon", "lat", ["b", "a"], ["a"])
    assert '"properties":{"a":4}' in spark.read.text(str(tmp_path / "nan")).first()[0]
    places = spark.createDataFrame([(1.0, 2.0, None, 4)], "lon double, lat double, b string, a int")
    files.write_features(places, str(tmp_path / "out"), "lon", "lat", ["b", "a"], ["a"])
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"geometry":{"coordinates":[1.0,2.0],"type":"Point"},"properties":{"a":4},"type":"Feature"}'
    files.write_ndjson(places, str(tmp_path / "nd"))
    assert spark.read.text(str(tmp_path / "nd")).first()[0] == '{"lon":1.0,"lat":2.0,"a":4}'
    files.write_csv(places, str(tmp_path / "csv"), ["a", "lon"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("4", "1.0")]
    files.write_by_group(grid.withColumn("class", F.col("v") % 2), str(tmp_path / "by"), "class")
    assert sorted(p.name for p in (tmp_path / "by").glob("class=*")) == ["class=0", "class=1"]
    assert files.source_manifest(spark.range(2)).where("retrieved_at is not null").count() == 2


def test_feeds_by_header_and_member(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="calendar"):
        files.read_feed(spark, str(tmp_path / "nothing"))
    rows = {"calendar": "service_id,monday\nS,1\n", "calendar_dates": "service_id,date,exception_type\n", "trips": "trip_id,route_id,service_id\nt,r,S\n", "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\na,A,1,2,0,P\nP,Station,1,2,1,\nb,B,1,2,0,Q\n", "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,24:10:00,,a,1\nt,24:40:00,24:44:00,b,2\nt,,,a,3\nu,24:30:00,24:30:00,a,1\nt,24:30:00,24:30:00,z,4\n"}
    for feed in ("one", "two"):
        (tmp_path / feed).mkdir()
        for name, body in rows.items():
            (tmp_path / feed / f"{name}.txt").write_text(body)
    (tmp_path / "two" / "trips.txt").write_text("service_id,trip_id,route_id\nS,t,other\n")
    feed = files.read_feed(spark, str(tmp_path / "*"))
    assert {tuple(r) for r in feed["trips"].collect()} == {("one", "r", "S", "t"), ("two", "other", "S", "t")}
    services = spark.createDataFrame([("2026-07-21", "S")], "date string, service_id string")
    windows = spark.createDataFrame([("late", 1470), ("later", 1485)], "window_id string, minute int")
    got = {tuple(r) for r in feeds.stop_events(feed, services, windows, 15).where("feed_id = 'two'").select("window_id", "stop_id", "route_id", "event_minute", "parent_station_name").collect()}
    assert got == {("late", "b", "other", 1484, ""), ("later", "b", "other", 1484, "")}
    wide = feeds.stop_events(feed, services, windows, 30).where("feed_id = 'one' and window_id = 'late'")
    assert {(r.stop_id, r.parent_station_name) for r in wide.collect()} == {("a", "Station"), ("b", "")}
    assert {(r.stop_id, r.name) for r in feeds.collapsed_stops(wide, feed["stops"], ["window_id"]).collect()} == {("P", "Station"), ("Q", "B")}
    (tmp_path / "two" / "stops.txt").unlink()
    with pytest.raises(FileNotFoundError, match="stops.txt.*two"):
        files.read_feed(spark, str(tmp_path / "*"))


def test_stale_partitions(spark, tmp_path):
    import os

    for name, t in (("in/p=1/a", 100), ("in/p=2/a", 300), ("in/p=3/a", 100), ("out/p=1/b", 200), ("out/p=2/b", 200)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (t, t))
    stale = lambda **k: sorted(r.part for r in files.stale_partitions(spark, str(tmp_path / "in"), str(tmp_path / "out"), **k).collect())
    assert stale() == ["p=2", "p=3"]
    tags = spark.createDataFrame([("p=1", "v1"), ("p=2", "v2")], "part string, tag string")
    assert stale(tags=tags, tag="v2") == ["p=1", "p=2", "p=3"]


def test_publish_keeps_the_old_table_on_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    files.publish(spark.range(3), path, [lambda d: d.where("id > 5")])
    with pytest.raises(ValueError, match="not published"):
        files.publish(spark.range(9), path, [lambda d: d.where("id > 5")])
    assert spark.read.parquet(path).count() == 3
    files.publish(spark.range(4), path, [])
    assert files.output_manifest(spark.read.parquet(path)).agg(F.sum("records")).first()[0] == 4


def test_a_failed_swap_puts_the_old_folder_back():
    class Folders(set):
        def exists(self, p):
            return p in self

        def delete(self, p, deep):
            self.discard(p)

        def rename(self, a, b):
            if a == "staging":
                return False
            self.discard(a)
            self.add(b)
            return True

    fs = Folders({"staging", "path"})
    with pytest.raises(OSError, match="could not be put in place"):
        files.swap_folders(fs, "staging", "path", "old")
    assert "path" in fs and "old" not in fs


def test_event_stream_cleans_like_the_batch(spark, tmp_path):
    rows = [("open", {"k": "1", "z": "2"}), ("open", {"k": "9"}), ("other", {"k": "1"})]
    schema = "name string, props map<string,string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    job = clean_stream(spark, str(tmp_path / "in"), schema, {"open": {"k": ["1"]}}, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    job.awaitTermination(120)
    got = sorted(((r.name, r.props) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == [("open", {"k": "1"}), ("open", {})]
