from wayspan.operators import checks


def test_leaks_at_any_depth(spark):
    docs = [
        (1, '{"a":[{"b":{"c":["x","7"]}}],"tripless":1}'),
        (2, '"TRIP.Identifiers = \\"9\\", tripid:8;"'),
        (3, '{"my-Trip_ID":{"Trip Keys":[null,7]},"n":7}'),
        (4, "not json"), (5, None), (6, "[]"), (7, '"strip_id=7"'), (8, "7"), (9, '["7",["7","trip-key=7"]]'), (10, '{"":"","é_tripIds":""}'),
    ]
    raw = spark.createDataFrame([("7",), ("9",), ("9",), (None,)], "id string")
    got = checks.nested_leaks(spark.createDataFrame(docs, "doc int, j string"), "doc", "j", raw, "id").collect()
    want = {(1, "value", "7"), (2, "marker", "9"), (3, "key", "my-Trip_ID"), (3, "key", "Trip Keys"), (4, "unreadable", None), (9, "value", "7"), (9, "marker", "7"), (10, "key", "é_tripIds")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], "doc int, j string")
    assert checks.nested_leaks(empty, "doc", "j", raw, "id").collect() == []
