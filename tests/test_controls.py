from pyspark.sql import functions as F

from wayspan.operators import controls

STATES = "state_id int, action string, time string, access string, walk int, search string, selected string"
PLACES = "id string, name string, search_text string, condition string, observed map<string,string>"
PROPOSALS = "id string, action string, subtype string, action_class string, rank int, material_gain boolean, search_text string, cells array<struct<time:string,access:string,walk:int,active:boolean,activeStops:int,events:int,uniqueRoutes:int,uniqueTrips:int>>"


def test_lists_groups_and_selection(spark):
    states = spark.createDataFrame([(1, "open", "t", "public", 400, None, "b"), (2, "open", "t", "rider", 400, "TWO  elm", "b"), (3, "verify", "t", "public", 400, "", "p3"), (4, "verify", "t", "staff", 400, "", None), (5, "new", "t", "rider", 400, None, "gone")], STATES)
    places = spark.createDataFrame([("b", "Zed", "one", "unrestricted", {"t": "open"}), ("a", "zed", "two Elm", "fare_paid", {"t": "open"}), ("c", None, "x", "unrestricted", {"t": "open", "u": "closed"}), ("d", "d", "d", "unrestricted", {"u": "open"}), ("e", "e", None, None, None)], PLACES)
    good, idle = ("t", "public", 400, True, 0, 0, 1, None), ("t", "public", 400, True, 0, None, 0, 0)
    proposals = spark.createDataFrame(
        [("p1", "verify", "hours", None, None, True, "x", [good]), ("p2", "verify", "hours", None, 5, True, "x", [good]), ("p0", "verify", "hours", None, None, True, "x", [good]), ("p3", "verify", None, "zz", 1, True, "x", [good, good]), ("p4", "verify", "odd", None, 1, True, None, [good]), ("p5", "verify", "hours", None, 1, True, "x", [idle]), ("p6", "verify", "hours", None, 1, False, "x", [good]), ("p7", "verify", "hours", None, 1, None, "x", None)]
        + [("n1", "new", None, "zeta", 1, True, "x", [("t", "rider_conditional", 400, True, 1, 0, 0, 0)]), ("n2", "new", None, None, 1, True, "x", [("t", "rider_conditional", 400, None, 1, 0, 0, 0)]), ("n3", "new", None, "retrofit_accessibility", 9, True, "x", [("t", "rider_conditional", 400, True, 1, 0, 0, 0)])],
        PROPOSALS,
    )
    visible = controls.visible_features(states, places, proposals)
    got = [(r.state_id, r.group, r.id) for r in visible.orderBy("state_id", "group_place", "group", "position").collect()]
    assert got == [(1, "open", "c"), (1, "open", "b"), (2, "open", "a"), (3, "verify-hours", "p2"), (3, "verify-hours", "p0"), (3, "verify-hours", "p1"), (3, "verify-information", "p4"), (5, "retrofit_accessibility", "n3"), (5, "zeta", "n1")]
    told = {r.state_id: (r.selected_id, r.invalidated) for r in controls.selections(states, visible).collect()}
    assert told == {1: ("b", False), 2: (None, True), 3: (None, True), 4: (None, False), 5: (None, True)}
    assert {r.action: r.n for r in controls.counts_by_action(proposals).collect()} == {"verify": 8, "new": 3}
    assert controls.visible_features(states.where(F.lit(False)), places, proposals).count() == 0
