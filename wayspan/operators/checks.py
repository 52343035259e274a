"""Data-quality checks: each returns the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.operators.graph import checkpointed


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def unexpected_dates(df: DataFrame, column: str, expected: str) -> DataFrame:
    """Rows of another date than the expected one (ISO), or without a readable one."""
    return df.where(~F.coalesce(F.try_to_date(F.col(column).cast("string"), "yyyy-MM-dd") == F.lit(expected).cast("date"), F.lit(False)))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collisions(df: DataFrame, public: str, private: str) -> DataFrame:
    return df.groupBy(public).agg(F.countDistinct(private).alias("n")).where("n > 1")


def outside_domain(df: DataFrame, column: str, domain: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def length_mismatch(df: DataFrame, published: str, computed: Column, share: float = 0.25, reviewed: DataFrame | None = None, key: str | None = None) -> DataFrame:
    off = df.withColumn("computed", computed).where(F.abs(F.col("computed") - F.col(published)) > F.col(published) * share)
    return off if reviewed is None else off.join(reviewed.select(key), key, "left_anti")


def above_limit(df: DataFrame, value: str, kind: str, limits: dict[str, float]) -> DataFrame:
    allowed = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return df.where(F.col(value) > F.try_element_at(allowed, F.col(kind)))


def bad_masks(df: DataFrame, bits: str, count: str, dawn: Column | None = None, reserved: str | None = None) -> DataFrame:
    """Bits beyond the hours, or a count that isn't the number of set bits; with dawn (a condition for ground pixels)
    also those of them without the first bit, with reserved a channel that isn't zero."""
    bad = (F.shiftright(F.col(bits), 15) != 0) | (F.bit_count(F.col(bits)) != F.col(count))
    if dawn is not None:
        bad = bad | (dawn & (F.getbit(F.col(bits), F.lit(0)) == 0))
    if reserved is not None:
        bad = bad | (F.coalesce(F.col(reserved), F.lit(0)) != 0)
    return df.where(bad)


def leaks(df: DataFrame, text: str, pattern: str, raw: DataFrame, raw_id: str) -> DataFrame:
    """Raw ids that appear in a text, as the whole of it or by the pattern's first group: text and id."""
    found = F.array_union(F.array(F.col(text)), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    spread = df.where(F.col(text).isNotNull()).select("*", F.explode(found).alias("leaked"))
    return spread.join(raw.select(F.col(raw_id).cast("string").alias("leaked")).distinct().hint("merge"), "leaked", "left_semi")


# How an id is written into a text, and the ends of key names (letters and digits only) that are forbidden.
MARKER = r"""(?i)\btrip[_.-]?(?:id|key|identifier)s?\s*[:=]\s*["']?([^"'\s,;&?#}\])]+)"""
FORBIDDEN_KEYS = ("tripid", "tripids", "tripkey", "tripkeys", "tripidentifier", "tripidentifiers")


def nested_leaks(df: DataFrame, key: str, text: str, raw: DataFrame, raw_id: str) -> DataFrame:
    """(key, kind, leaked), each once, of JSON texts: raw ids that are a whole string anywhere in the value (value) or
    stand behind a marker in one (marker), forbidden key names at any depth (key), and texts that aren't JSON (unreadable,
    leaked null). Null texts leak nothing.

    Values are opened a level at a time, all rows together; what a level holds is written, and rounds end with the
    deepest value.
    """
    told = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.lit(None).cast("string").alias("name"), F.try_parse_json(text).alias("v"))
    out = [told.where("v is null").select("_id", F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("leaked"))]
    strings, level = [], told.where("v is not null")
    spark = df.sparkSession
    while True:
        shape = F.schema_of_variant("v")
        kind = F.when(shape == "STRING", "string").when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), "box").otherwise("other")
        level = checkpointed(level.select("_id", "name", kind.alias("kind"), F.when(kind == "string", F.try_variant_get("v", "$", "string")).when(kind == "box", F.to_json("v")).alias("j")))
        strings.append(level.where("kind = 'string'").select("_id", F.col("j").alias("leaf")))
        bare = F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", "")
        out.append(level.where(bare.rlike(f"({'|'.join(FORBIDDEN_KEYS)})$")).select("_id", F.lit("key").alias("kind"), F.col("name").alias("leaked")))
        boxes = level.where("kind = 'box'")
        if boxes.isEmpty():
            break
        opened = boxes.select("_id", F.parse_json("j").alias("box")).lateralJoin(spark.tvf.variant_explode(F.col("box").outer()))
        level = opened.select("_id", F.col("key").alias("name"), F.col("value").alias("v"))
    leaves = reduce(DataFrame.unionByName, strings)
    whole = leaves.select("_id", F.lit("value").alias("kind"), F.col("leaf").alias("leaked"))
    marked = leaves.select("_id", F.lit("marker").alias("kind"), F.explode(F.regexp_extract_all("leaf", F.lit(MARKER), F.lit(1))).alias("leaked"))
    ids = raw.select(F.col(raw_id).cast("string").alias("leaked")).distinct()
    out.append(whole.unionByName(marked).distinct().join(ids.hint("merge"), "leaked", "left_semi").select("_id", "kind", "leaked"))
    return reduce(DataFrame.unionByName, out).distinct().withColumnRenamed("_id", key)


def unresolved_reviews(df: DataFrame, status: str, note: str, reviewer: str, date: str) -> DataFrame:
    """Resolved rows without a note, a reviewer or an ISO date."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return df.where((F.col(status) == "resolved") & (blank(note) | blank(reviewer) | F.try_to_date(F.col(date), "yyyy-MM-dd").isNull()))


def missed_anchors(df: DataFrame, key: str, value: str, anchors: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Anchors (key, expected) that are missing or off by more than the tolerance."""
    met = anchors.join(df.select(key, value), key, "left")
    return met.where(F.coalesce(F.abs(F.col(value) - F.col("expected")) > tolerance, F.lit(True)))


def bad_profiles(df: DataFrame, key: str, name: str, profiles: list[str], length: str, pixels: str, lon: str, lat: str, box: tuple[float, float, float, float], hours: int = 15, least: float = 100) -> DataFrame:
    """Street profiles that break their contract: id pattern, a trimmed name of 1 to 200 characters, a centre in the box
    (west, south, east, north), length, ground pixels, hourly shares from 0 to 1 in every profile, or a repeated id."""
    text = F.col(name)
    good = F.col(key).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.trim(text) == text) & F.length(text).between(1, 200) & F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3]) & (F.col(length) >= least) & (F.col(pixels) >= 1)
    for p in profiles:
        good = good & (F.size(p) == hours) & F.forall(p, lambda v: F.coalesce(v.between(0, 1), F.lit(False)))
    return _with_repeated(df.where(~F.coalesce(good, F.lit(False))), df, key)


def _with_repeated(bad: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The bad rows, and those of df whose key several rows have."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return bad.unionByName(df.join(often.hint("merge"), key, "left_semi")).dropDuplicates()


def bad_stop_list(stops: DataFrame, key: str, name: str, lon: str, lat: str, box: tuple[float, float, float, float], pattern: str = r"^[A-Za-z0-9_-]{1,64}$") -> DataFrame:
    """Stops of a published list with an unusable or repeated id, no name, or a place outside the box."""
    good = F.col(key).cast("string").rlike(pattern) & (F.trim(name) != "") & F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])
    return _with_repeated(stops.where(~F.coalesce(good, F.lit(False))), stops, key)


def bad_list_counts(heads: DataFrame, stops: DataFrame, key: str) -> DataFrame:
    """Published lists (key, count, of_total, order) whose count isn't that of their stops, exceeds the total, or which
    claim another order than by name."""
    have = stops.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    told = heads.join(have.hint("merge"), key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return told.where(~F.coalesce((F.col("count") == F.col("have")) & (F.col("of_total") >= F.col("count")) & (F.col("order") == "name"), F.lit(False)))


def incomplete_reach(reach: DataFrame, places: DataFrame, place: str, walks: list[int], expected_id: Column) -> DataFrame:
    """(place, walk, problem) of reach features (id, place, walk): missing, unexpected or repeated pairs of place and
    walk, and ids that aren't derived from them."""
    wanted = places.select(place).distinct().withColumn("walk", F.explode(F.array(*map(F.lit, walks))))
    pairs = reach.groupBy(place, "walk").agg(F.count(F.lit(1)).alias("_n"))
    gone = wanted.join(pairs.hint("merge"), [place, "walk"], "left_anti").withColumn("problem", F.lit("missing"))
    extra = pairs.join(wanted.hint("merge"), [place, "walk"], "left_anti").select(place, "walk", F.lit("unexpected").alias("problem"))
    often = pairs.where("_n > 1").select(place, "walk", F.lit("repeated").alias("problem"))
    named = reach.where(~F.coalesce(F.col("id") == expected_id, F.lit(False))).select(place, "walk", F.lit("wrong id").alias("problem"))
    return gone.select(place, "walk", "problem").unionByName(extra).unionByName(often).unionByName(named)


def empty_dimensions(dims: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Members of a dimension (snapshots, scenarios, zone names) that have no fact."""
    return dims.select(*key).distinct().join(facts.select(*key).distinct().hint("merge"), key, "left_anti")


def bad_records(df: DataFrame, required: list[str], longest: dict[str, int] | None = None, domains: dict[str, list] | None = None, dates: list[str] | None = None) -> DataFrame:
    """Records of guides or locations that lack a required field, hold too long a text, a value outside its domain
    (null is fine) or an unreadable date."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()
    for c, n in (longest or {}).items():
        good = good & F.coalesce(F.length(c) <= n, F.lit(True))
    for c, values in (domains or {}).items():
        good = good & F.coalesce(F.col(c).isin(*values), F.lit(True))
    for c in dates or []:
        good = good & (F.col(c).isNull() | F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd").isNotNull())
    return df.where(~good)
