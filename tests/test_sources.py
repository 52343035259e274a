import pytest

from wayspan.functions import ways
from wayspan.operators import sources


def table(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns.split(",")))


def point(x, y):
    return f'{{"coordinates": [{x}, {y}], "type": "Point"}}'


MULTI = '{"type": "MultiPoint", "coordinates": [[-79.25, 43.5], [0, 0]]}'


def by_id(df):
    assert df.columns == list(ways.PLACE)
    return {r.place_id: r for r in df.collect()}


def test_parks(spark):
    rows = table(spark, [
        ("1", "", "Old Mill", None, " 3 Elm St ", "See Centre hours", "Entrance", MULTI, "Closed for the season", "None", "All-Gender washroom", "0", None),
        ("2", "77", "", "The Hub", "x", "centre hours", "none", point(-79, 43), "None", None, "W", "2", "https://a.example/b"),
        ("3", " ", None, "", None, None, None, point(1, 2), None, None, None, "1", ""),
    ], "id,asset_id,location,alternative_name,address,hours,accessible,geometry,Reason,Comments,type,Status,url")
    days = "id," + ",".join(f"oh{c}{e}" for c, _ in sources.DAY_CODES for e in "oc")
    hours = table(spark, [("1", "9 a.m.", "5 p.m.", *["Closed", "Closed"] * 6)], days)
    got = by_id(sources.park_places(rows, hours, "https://p.example/"))
    one, two, three = got["parks:1"], got["parks:77"], got["parks:3"]
    assert (one.name, one.address, one.lon, one.lat, one.accessible, one.all_gender) == ("Old Mill", "3 Elm St", -79.25, 43.5, True, True)
    assert one.hours_raw.startswith("Mon 9 a.m. to 5 p.m.; Tue Closed") and one.temporarily_closed and one.notes == "Closed for the season" and one.closure_category == "seasonal" and one.source_url == "https://p.example/"
    assert (two.name, two.hours_raw, two.accessible, two.partial_service, two.notes, two.source_url, two.closure_category) == ("The Hub", "centre hours", None, True, "", "https://a.example/b", "none")
    assert (three.name, three.address, three.hours_raw, three.accessible, three.temporarily_closed) == ("Park washroom", "", "", None, False)


def test_libraries_and_museums(spark):
    libraries = table(spark, [("1", "AB", "Annette", "1 A St", point(1, 2), "9-5", "w"), ("0", "CD", "Closed", "", point(1, 2), "", "")], "PublicWashroom,BranchCode,BranchName,Address,geometry,Hours,Website")
    got = by_id(sources.library_places(libraries))
    assert set(got) == {"library:AB"} and got["library:AB"].name == "Annette library" and got["library:AB"].accessible is None
    museums = table(spark, [("1", "No", "Fort", "a", "h", "yes", "yes", "n"), ("2", "Yes", "House", "b", "h", "No", None, "under construction"), ("3", "Yes", "Hall", "c", None, "ramp", "Yes", None)], "number,Washroom?,Museums and Cultural Centres,Address,Hours,Accessible?,Gender Inclusive?,Notes")
    points = table(spark, [("House", point(5, 6)), ("Hall", point(7, 8))], "name,geometry")
    got = by_id(sources.museum_places(museums, points, "u"))
    assert set(got) == {"museum:2", "museum:3"}
    assert (got["museum:2"].accessible, got["museum:2"].all_gender, got["museum:2"].closure_category, got["museum:2"].lon) == (False, False, "construction", 5.0)
    assert (got["museum:3"].accessible, got["museum:3"].all_gender) == (None, True)
    with pytest.raises(Exception, match="no address point: Hall"):
        sources.museum_places(museums, points.where("name = 'House'"), "u").collect()


def test_automated_buildings_and_stations(spark):
    rows = table(spark, [("4", "12", "Bay St", "Existing", point(1, 2)), ("5", None, "King St", "Planned", point(1, 2))], "ID,ADDRESSNUMBERTEXT,ADDRESSSTREET,STATUS,geometry")
    got = by_id(sources.automated_places(rows, "u"))
    assert got["automated:4"].name == "Automated public washroom at 12 Bay St" and not got["automated:4"].temporarily_closed
    assert got["automated:5"].address == "King St" and got["automated:5"].temporarily_closed and got["automated:5"].accessible
    open_ = "Open - Public Access"
    rows = table(spark, [("1", open_, "F1", "Hall", "1 A", "9-5", "No", "no", point(1, 2)), ("2", open_, " F1 ", "Annex", "2 B", "9-5 ", "YES", "no", point(3, 4)), ("3", open_, "N/A", "Barn", "3 C", "8-4", "no", "yes", point(5, 6)), ("4", open_, None, "Barn", "3 C", "8-5", None, None, point(5, 6)), ("5", "Closed", "F1", "x", "x", "x", "x", "x", point(0, 0))], "number,Washroom Status,FLOC_ID,Building Description,Address,Hours Available,Accessible Washroom,Gender Inclusive,geometry")
    got = by_id(sources.building_places(rows, "u"))
    assert set(got) == {"crem:F1", "crem:Barn|3 C"}
    assert (got["crem:F1"].name, got["crem:F1"].hours_raw, got["crem:F1"].accessible, got["crem:F1"].record_count, got["crem:F1"].lon) == ("Hall", "9-5", True, 2, 1.0)
    assert (got["crem:Barn|3 C"].hours_raw, got["crem:Barn|3 C"].all_gender, got["crem:Barn|3 C"].accessible) == ("", True, False)
    rows = table(spark, [("1", "High Park", "u1"), ("2", "High Park", "u2")], "number,station,source_url")
    stops = table(spark, [("9", "High Park", "43.6", "-79.4", "1"), ("8", "High Park", "0", "0", "0")], "stop_id,stop_name,stop_lat,stop_lon,location_type")
    one = by_id(sources.station_places(rows, stops))["ttc:high-park"]
    assert (one.name, one.lon, one.lat, one.record_count, one.source_url, one.access_condition) == ("High Park station", -79.4, 43.6, 2, "u1", "fare_paid")
    with pytest.raises(Exception, match="station missing from the feed: High Park"):
        sources.station_places(rows, stops.where("location_type = '0'")).collect()
