"""Calendars, weekly hours, states at a moment, and events in time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.operators.graph import checkpointed
from wayspan.operators.sizes import small

DAY = 1440
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_seconds(text: Column) -> Column:
    """HH:MM:SS to seconds of the service day; hours past 24 stay as they are. The text is named once, so a plan that
    uses the seconds several times doesn't hold copies of it for each part."""
    parts = F.slice(F.concat(F.split(F.trim(text), ":"), F.array(F.lit(None), F.lit(None)).cast("array<string>")), 1, 3)
    return F.aggregate(parts, F.lit(0), lambda sum_, part: sum_ * 60 + part.cast("int"))


def active_services(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, service_id) active: weekday flag within the date range or added, and not removed.

    calendar: service_id, monday to sunday ('1' is on), start_date, end_date (dates); exceptions: service_id,
    date, exception_type ('1' added, '2' removed); dates: date. Dates are a small table of asked days.
    """
    days = F.array(*[F.struct(F.lit(i).alias("weekday"), F.col(d).alias("on")) for i, d in enumerate(WEEKDAYS)])
    flags = calendar.select("service_id", "start_date", "end_date", F.explode(days).alias("d")).where("d.on = '1'")
    asked = dates.select("date", F.weekday("date").alias("weekday")).distinct()
    regular = flags.withColumn("weekday", F.col("d.weekday")).join(asked.hint("merge"), "weekday").where(F.col("date").between(F.col("start_date"), F.col("end_date")))
    told = exceptions.join(dates.distinct(), "date", "left_semi")
    added = told.where("exception_type = '1'").select("date", "service_id")
    removed = told.where("exception_type = '2'").select("date", "service_id")
    return regular.select("date", "service_id").union(added).distinct().join(removed.hint("merge"), ["date", "service_id"], "left_anti")


def events_in_windows(events: DataFrame, windows: DataFrame, at: str, half_width: int, circle: int | None = None) -> DataFrame:
    """events joined to every window (window_id, centre) with |at - centre| <= half_width, both ends in.

    A range join as an equi join: windows are cut into buckets as wide as they are, so an event meets only the
    windows of its bucket. Few windows are broadcast, so events don't move; many are merged, where Spark splits
    full buckets. circle (e.g. DAY) lets windows wrap around.
    """
    width = 2 * half_width + 1
    starts = windows.select("window_id", "centre", F.explode(F.sequence(F.floor((F.col("centre") - half_width) / width), F.floor((F.col("centre") + half_width) / width))).alias("_bucket"))
    # the explode also binds the time: what computes it is not repeated in the bucket, the tests and the join
    turns = (0,) if circle is None else (0, -circle, circle)
    spread = events.withColumn("_at", F.explode(F.array(F.col(at).cast("long")))).withColumn("_at", F.explode(F.array(*[F.col("_at") + t for t in turns])))
    keyed = spread.withColumn("_bucket", F.floor(F.col("_at") / width))
    met = keyed.join(small(starts), "_bucket").where(F.abs(F.col("_at") - F.col("centre")) <= half_width)
    return met.drop("_bucket", "_at", "centre")


def nearest_in_time(targets: DataFrame, rows: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """For each target (key, target) the row of the same key whose time is closest; ties go to the earlier one, and
    of rows of one time to the smallest. Targets whose key has no row, and null keys and times, give nothing.

    An as-of merge in both directions: rows and targets are dealt into ranges of key and time together, and in a range
    each target looks at the last row up to it and the first one from it on. A target never meets the rows of its
    key, and a key of any size spreads over ranges; the keys that go on in another range (two a range at most) get
    the nearest rows from there.
    """
    other = [c for c in rows.columns if c not in (key, at)]
    kind = dict(rows.dtypes)[key]
    own = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(F.col(at).alias("_t"), *other).alias("_row"), F.lit(None).cast(dict(targets.dtypes)[target]).alias("_target"))
    asked = targets.select(F.col(key).cast(kind).alias("_key"), F.col(target).cast(dict(rows.dtypes)[at]).alias("_at"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(target).alias("_target")).distinct()
    both = own.unionByName(asked).where("_key is not null and _at is not null")
    placed = checkpointed(both.repartitionByRange("_key", "_at").withColumn("_part", F.spark_partition_id()))
    placed = placed.withColumn("_row", F.min("_row").over(Window.partitionBy("_part", "_key", "_at")))  # rows of one time are in one range
    run = Window.partitionBy("_part", "_key")
    until = lambda order: F.last("_row", ignorenulls=True).over(run.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    told = placed.withColumn("_before", until(F.col("_at"))).withColumn("_after", until(F.col("_at").desc())).where("_target is not null")

    ends = placed.groupBy("_part").agg(F.array(F.min("_key"), F.max("_key")).alias("k")).select(F.explode("k").alias("_key")).distinct()
    pieces = placed.join(F.broadcast(ends), "_key", "left_semi").groupBy("_key", "_part").agg(F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("f"), F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).alias("l"))
    beyond = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("_key", "_part", beyond("l", F.col("_part")).alias("_earlier"), beyond("f", F.col("_part").desc()).alias("_later"))
    told = told.join(F.broadcast(pieces), ["_key", "_part"], "left")  # a row for each range that such a key is in
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    nearer = F.when(after.isNull() | (F.col("_target") - before["_t"] <= after["_t"] - F.col("_target")), before).otherwise(after)
    return told.withColumn("_r", nearer).where("_r is not null").select(F.col("_key").alias(key), F.col("_target").alias(target), F.col("_r._t").alias(at), *[F.col("_r")[c].alias(c) for c in other])


# --- weekly hours -------------------------------------------------------------------------------

# Texts that say that the hours are not published, and the words of weekly hours (longer ones first).
UNPUBLISHED = ("", "none", "non-branch row", "centre hours")
_SHORT = tuple(name[:3] for name in WEEKDAYS)
DAY_WORDS = (*WEEKDAYS, "weekends", "weekend", *_SHORT)
JOINERS, HOLIDAYS = ("&", "and"), ("holidays", "holiday")
#: "am", "a.m", "am.", "a.m." and the same of "pm".
MARKS = tuple(f"{half}{inner}m{end}" for half in "ap" for inner in ("", ".") for end in ("", "."))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def _word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words that the text begins with, in any case; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.startswith(F.lower(text), w)), F.lit(0)), F.lit(""))


def _behind(text: Column, word: Column) -> Column:
    return F.substr(text, F.length(word) + 1)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value bound to a variable, so that what computes it stands in the plan once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _day_clause(text: Column) -> Column:
    """(first, last, times) of a rule "day [- day] [& holidays] [:] times"; last is empty without a range, times is null
    where the text doesn't begin with a day clause and a blank. Words are taken off the front one by one."""
    state = lambda first, last, rest: F.struct(first.alias("first"), last.alias("last"), rest.alias("rest"))
    none = F.lit("")

    def opened(rest: Column, word: str) -> Column:
        return F.when(F.startswith(_left(rest), F.lit(word)), _left(_behind(_left(rest), F.lit(word))))

    def ranged(s: Column) -> Column:
        return _bound(opened(s["rest"], "-"), lambda t: _bound(_word(t, _SHORT), lambda d: F.when(d != "", state(s["first"], d, _behind(t, d))).otherwise(s)))

    def without_holidays(s: Column) -> Column:
        joined = F.coalesce(*[opened(s["rest"], w) for w in JOINERS], none)
        return _bound(joined, lambda t: _bound(_word(t, HOLIDAYS), lambda h: F.when(h != "", state(s["first"], s["last"], _behind(t, h))).otherwise(s)))

    def timed(s: Column) -> Column:
        colon = F.startswith(_left(s["rest"]), F.lit(":"))
        told = lambda t, sound: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.when((s["first"] != "") & sound & ~F.contains(_left(t), F.lit("\n")), _stripped(t)).alias("times"))
        plain = lambda t: F.contains(F.substring_index(F.left(t, F.length(t) - F.length(_left(t))), "\n", -1), F.lit(" "))
        behind = _behind(_left(s["rest"]), F.lit(":"))
        return F.when(colon, told(behind, F.startswith(behind, F.lit(" ")) & ~F.contains(behind, F.lit("\n")))).otherwise(told(s["rest"], plain(s["rest"])))

    first = _bound(_word(text, DAY_WORDS), lambda d: state(d, none, _behind(text, d)))
    return _bound(_bound(_bound(first, ranged), without_holidays), timed)


def _days(first: Column, last: Column) -> Column:
    """Weekday numbers (Monday is 0) from first to last; ranges wrap around the week. Null if they make no sense."""
    number = lambda c: F.array_position(F.array(*map(F.lit, _SHORT)), F.left(c, F.lit(3))).cast("int") - 1
    weekend, span = F.startswith(first, F.lit("weekend")), F.pmod(F.when(last == "", 0).otherwise(number(last) - number(first)), F.lit(7))
    week = F.transform(F.sequence(F.lit(0), span), lambda k: F.pmod(number(first) + k, F.lit(7)))
    return F.when(weekend, F.when(last == "", F.array(F.lit(5), F.lit(6)))).when(first != "", week)


def _clock(text: Column) -> Column:
    """Minute of the day of "9am", "9:30 p.m."; null for anything else."""

    def minute_of(mark: Column, figures: Column) -> Column:
        hour, minute = F.get(figures, F.lit(0)), F.coalesce(F.get(figures, F.lit(1)), F.lit("00"))
        sound = (F.size(figures) <= 2) & hour.rlike("^[0-9]{1,2}$") & minute.rlike("^[0-9]{2}$")
        return F.when(sound, F.pmod(hour.cast("int"), F.lit(12)) * 60 + minute.cast("int") + F.when(F.startswith(mark, F.lit("p")), 720).otherwise(0))

    marks = F.filter(F.array(*map(F.lit, MARKS)), lambda m: F.endswith(text, m))
    figures = lambda m: F.split(F.regexp_replace(F.left(text, F.length(text) - F.length(m)), r"\s+$", ""), ":")
    return F.get(F.transform(marks, lambda m: _bound(figures(m), lambda f: minute_of(m, f))), F.lit(0))


def _interval(text: Column) -> Column:
    """(start_min, end_min) of two clocks with a dash, "to" or "until" between them; null for anything else."""

    def interval_of(clocks: Column) -> Column:
        start, end = F.get(clocks, F.lit(0)), F.get(clocks, F.lit(1))
        told = F.struct(start.alias("start_min"), F.when(end <= start, end + DAY).otherwise(end).alias("end_min"))
        return F.when((F.size(clocks) == 2) & start.isNotNull() & end.isNotNull(), told)

    halves = F.split(F.regexp_replace(text, r"\s(to|until)\s", "-"), "-")
    return _bound(F.transform(halves, lambda t: _bound(_stripped(t), _clock)), interval_of)


def weekly_hours(texts: DataFrame, text: str) -> DataFrame:
    """(text, hours_known, weekday, start_min, end_min) for each distinct text, one row an interval.

    "Mon-Fri 9 a.m. to 5 p.m.; Sat & holidays 10am-4pm & 6pm-8pm": rules begin with a day, a range of days or
    "weekend(s)" and stand between semicolons or commas; a text without a day in front holds for all days.
    Intervals are joined by "&", with "to", "until" or "-" between the ends; an end at or before the start belongs
    to the next day (plus 1440); "closed" gives no interval. A text of which any part can't be read is unknown as
    a whole: one row with hours_known false and no interval. Known texts without any interval are one row of nulls.
    """
    cut = texts.select(F.col(text).alias("_text")).distinct().withColumn("_value", _stripped(F.coalesce("_text", F.lit(""))))
    low = F.lower("_value")
    published = ~(low.isin(*UNPUBLISHED) | F.startswith(low, F.lit("view ")))
    none = F.array().cast("array<struct<start_min:int,end_min:int>>")
    spans = lambda times: F.when(F.lower(times) == "closed", none).otherwise(F.transform(F.split(times, "&"), _interval))
    rule = lambda days, times: F.struct(days.alias("days"), spans(times).alias("spans"))
    daily = F.array(rule(F.sequence(F.lit(0), F.lit(6)), F.col("_value")))
    dated = F.transform(F.split("_value", "[;,]"), lambda piece: _bound(_bound(_stripped(piece), _day_clause), lambda c: rule(_days(c["first"], c["last"]), c["times"])))
    # the explode binds the rules: what reads them is not repeated in the tests and the join
    rules = cut.select("_text", published.alias("_published"), F.explode(F.when(_day_clause(F.col("_value"))["times"].isNotNull(), dated).otherwise(daily)).alias("_rule"))
    days, told = F.col("_rule.days"), F.col("_rule.spans")
    good = F.coalesce(F.col("_published") & days.isNotNull() & told.isNotNull() & ~F.exists(told, lambda s: s.isNull()), F.lit(False))
    known = rules.groupBy("_text").agg(F.bool_and(good).alias("hours_known"))
    rows = rules.where(good).select(F.col("_text").alias("_own"), F.explode(days).alias("weekday"), told.alias("spans")).select("_own", "weekday", F.explode("spans").alias("s"))
    rows = rows.select("_own", "weekday", F.col("s.start_min").alias("start_min"), F.col("s.end_min").alias("end_min"))
    same = F.col("_text").eqNullSafe(F.col("_own")) & F.col("hours_known")
    return known.join(rows.hint("merge"), same, "left").select(F.col("_text").alias(text), "hours_known", "weekday", "start_min", "end_min")


def hours_text(days: dict[str, tuple[Column, Column]]) -> Column:
    """Hours per weekday (label to opening and closing text) as one weekly text. Missing ends, "closed" and the
    placeholder pairs are closed; an opening text that ends in "and" goes on in the closing one."""
    parts = []
    for day, (opens, closes) in days.items():
        a, z = (_stripped(F.coalesce(c, F.lit(""))) for c in (opens, closes))
        low = F.lower(a)
        shut = (a == "") | (z == "") | (low == "closed") | (F.lower(z) == "closed") | ((low == "permits") & (F.lower(z) == "only"))
        joined = F.concat(F.lit(f"{day} "), F.regexp_replace(a, r"(?i)\s* and$", ""), F.lit(" & "), z)
        parts.append(F.when(shut, F.lit(f"{day} Closed")).when(low.endswith(" and"), joined).otherwise(F.concat(F.lit(f"{day} "), a, F.lit(" to "), z)))
    return F.concat_ws("; ", *parts)


def availability(places: DataFrame, hours: DataFrame, moments: DataFrame, place: str = "place_id") -> DataFrame:
    """(place, moment_id, state): open, closed, temporarily closed or unknown.

    places: place, hours_known, temporarily_closed; hours: place, weekday, start_min, end_min; moments:
    moment_id, weekday, minute (broadcast if few). Intervals that pass midnight carry into the next day.
    """
    asked = small(moments)
    own = hours.select(place, F.explode(F.array(F.struct(F.col("weekday").alias("weekday"), F.col("start_min").alias("a"), F.col("end_min").alias("b")), F.struct(F.pmod(F.col("weekday") + 1, F.lit(7)).alias("weekday"), (F.col("start_min") - DAY).alias("a"), (F.col("end_min") - DAY).alias("b")))).alias("i")).select(place, "i.*")
    inside = own.join(asked, "weekday").where("minute >= a and minute < b and minute < 1440").select(place, "moment_id").distinct().withColumn("_open", F.lit(True))
    grid = places.select(place, "hours_known", "temporarily_closed").crossJoin(asked.select("moment_id"))
    state = F.when(F.col("temporarily_closed"), "temporarily closed").when(~F.col("hours_known"), "unknown").when(F.col("_open"), "open").otherwise("closed")
    return grid.join(inside.hint("merge"), [place, "moment_id"], "left").select(place, "moment_id", state.alias("state"))


# States of a place by its raw state and closure category, and by its schedule alone.
CLOSED_STATES = {"seasonal": "seasonal_closed", "construction": "construction_closed", "temporary": "temporary_closed", "none": "temporary_closed"}


def state_name(raw: Column, closure: Column) -> Column:
    """Published state: open, scheduled_closed, unknown_hours, or one of the three kinds of closures. Null for raw
    states or categories that don't exist."""
    shut = F.try_element_at(F.create_map(*[F.lit(x) for kv in CLOSED_STATES.items() for x in kv]), closure)
    return F.when(raw == "open", "open").when(raw == "closed", "scheduled_closed").when(raw == "unknown", "unknown_hours").when(raw == "temporarily closed", shut)


def effective_state(observed: Column, scheduled: Column, closure_mode: Column, information_mode: Column) -> Column:
    """Under a scenario: normal operations put the schedule's state (open, closed, unknown) in place of temporary
    closures only; optimistic information makes unknown hours potentially open."""
    planned = F.when(scheduled == "open", "open").when(scheduled == "closed", "scheduled_closed").when(scheduled == "unknown", "unknown_hours")
    now = F.when((closure_mode == "normal_operations") & (observed == "temporary_closed"), planned).otherwise(observed)
    return F.when((information_mode == "optimistic_information") & (now == "unknown_hours"), "potential_open").otherwise(now)


def eligible(places: DataFrame, mode: Column, condition: str = "access_condition") -> DataFrame:
    """Places that an access mode permits: unrestricted ones to the public, all to riders. Other modes permit none."""
    return places.where(((mode == "public") & (F.col(condition) == "unrestricted")) | (mode == "rider_conditional"))


def facility_states(places: DataFrame, snapshots: DataFrame, observed: DataFrame, place: str = "place_id") -> DataFrame:
    """(place, snapshot_id, scheduled, observed) for every place and snapshot (few: broadcast): the raw scheduled
    state from the schedule alone, the named state from the observed row where there is one, else from the schedule.

    places: place, closure_category; snapshots: snapshot_id; observed: place, snapshot_id, scheduled, raw (null
    raw: derived, as weekend snapshots are).
    """
    grid = places.select(place, "closure_category").crossJoin(small(snapshots.select("snapshot_id").distinct()))
    told = grid.join(observed.select(place, "snapshot_id", "scheduled", "raw").hint("merge"), [place, "snapshot_id"], "left")
    raw = F.coalesce("raw", "scheduled", F.lit("unknown"))
    return told.select(place, "snapshot_id", F.coalesce("scheduled", F.lit("unknown")).alias("scheduled"), state_name(raw, F.col("closure_category")).alias("observed"))


def chosen_frames(frames: DataFrame, hours: list[int], hour: str = "hour", altitude: str = "altitude", least: float = 0.5) -> DataFrame:
    """Frames of the asked clock hours in their order, with position (the bit) and casting (the sun is above the
    least altitude). An hour without a frame is an error that names it."""
    have = {r[0] for r in frames.where(F.col(hour).isin(*hours)).select(hour).distinct().collect()}  # hours of a day
    if missing := [h for h in hours if h not in have]:
        raise ValueError(f"no frame for the hours {missing}")
    at = F.array_position(F.array(*map(F.lit, hours)), F.col(hour)).cast("int") - 1
    return frames.where(F.col(hour).isin(*hours)).withColumns({"position": at, "casting": F.col(altitude) > least})
