"""CSV, JSON and feature readers and writers, staged publishing, manifests and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.operators.sizes import small

FEED = {
    "calendar": "service_id STRING, monday STRING, tuesday STRING, wednesday STRING, thursday STRING, friday STRING, saturday STRING, sunday STRING, start_date STRING, end_date STRING",
    "calendar_dates": "service_id STRING, date STRING, exception_type STRING",
    "trips": "route_id STRING, service_id STRING, trip_id STRING",
    "stops": "stop_id STRING, stop_name STRING, stop_lat STRING, stop_lon STRING, location_type STRING, parent_station STRING",
    "stop_times": "trip_id STRING, arrival_time STRING, departure_time STRING, stop_id STRING, stop_sequence STRING",
}


def _by_header(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The CSV files of one or more paths (globs) as the text columns of the schema, matched by name in each file:
    files with different headers are read apart. A byte-order mark before the first name is ignored, columns that a
    file lacks are null, others are left out. file is the file's path."""
    wanted = [x.strip().split()[0] for x in schema.split(",")]
    # the first line of each file, of which Spark reads no more; one short text a file
    first = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b")).where("_b = 0").withColumn("_n", F.monotonically_increasing_id())
    heads = first.groupBy("file").agg(F.min_by("value", "_n").alias("head"))
    kinds = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    out = None
    for head, files in sorted((r.head, sorted(r.files)) for r in kinds):
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        named = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
        part = named.select(*[(F.col(c).cast("string") if c in named.columns else F.lit(None).cast("string")).alias(c) for c in wanted], F.col("_metadata.file_path").alias("file"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*wanted, "file"))) if out is None else out


def read_table_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Header CSV as the text columns of a schema (see _by_header)."""
    return _by_header(spark, [path] if isinstance(path, str) else path, schema).drop("file")


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found) if found is not None else []


def read_feed(spark: SparkSession, folders: str) -> dict[str, DataFrame]:
    """The tables of unpacked feeds (a glob of folders), each with feed_id, the folder's name. A table that a
    folder lacks is an error that names both."""
    every = _listed(spark, folders)
    if not every:
        raise FileNotFoundError(f"no feed under {folders}: no calendar.txt and so on")
    out = {}
    for name, schema in FEED.items():
        files = _listed(spark, f"{folders}/{name}.txt")
        lacking = {x.rsplit("/", 1)[-1] for x in every} - {x.rsplit("/", 2)[-2] for x in files}
        if lacking:
            raise FileNotFoundError(f"no {name}.txt in the feeds {sorted(lacking)}")
        told = _by_header(spark, files, schema)
        out[name] = told.select(F.element_at(F.split("file", "/"), -2).alias("feed_id"), *[c for c in told.columns if c != "file"])
    return out


def source_manifest(sources: DataFrame) -> DataFrame:
    """A list of sources with the time at which it was recorded."""
    return sources.withColumn("retrieved_at", F.current_timestamp())


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """(lon, lat, properties...) of point features: the first position of multi-points; features without two
    numbers are dropped. lines: one feature a line, which splits large files; else a whole collection."""
    feature = f"struct<type:string,geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    numbers = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    out = rows.withColumn("_n", numbers).where(F.size("_n") >= 2)
    return out.select(F.get("_n", F.lit(0)).cast("double").alias("lon"), F.get("_n", F.lit(1)).cast("double").alias("lat"), "f.properties.*")


def read_ways(spark: SparkSession, path: str, keep: list[str], derived: dict | None = None, lines: bool = False) -> DataFrame:
    """(way_id, tags, geometry, derived...) of ways with two vertices or more in exported elements, with the kept
    tags. derived maps names to functions of all the tags (a tier, a flag). lines: one element a line, which splits
    large exports; else whole exports, one a file."""
    element = "struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>"
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", element).alias("e"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<elements:array<{element}>>")["elements"]).alias("e"))
    ways = rows.where("e.type = 'way' and size(e.geometry) >= 2")
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    return ways.select(F.col("e.id").alias("way_id"), F.map_filter(tags, lambda k, v: k.isin(*keep)).alias("tags"), F.col("e.geometry").alias("geometry"), *[f(tags).alias(n) for n, f in (derived or {}).items()])


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value columns) of a JSON object that is a lookup map."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "v"))
    return rows.select("key", "v.*")


def read_pixels(spark: SparkSession, path: str, bounds: tuple[int, int, int, int], block: int) -> DataFrame:
    """Pixels with low <= row < high and left <= col < right; only the partitions (block_row, block_col) that
    the bounds touch are read."""
    low, high, left, right = bounds
    parts = F.col("block_row").between(low // block, (high - 1) // block) & F.col("block_col").between(left // block, (right - 1) // block)
    return spark.read.parquet(path).where(parts & (F.col("row") >= low) & (F.col("row") < high) & (F.col("col") >= left) & (F.col("col") < right))


def write_pixels(df: DataFrame, path: str, block: int) -> None:
    keyed = df.withColumns({"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")})
    keyed.repartition("block_row", "block_col").write.partitionBy("block_row", "block_col").parquet(path)


def read_pixels_within(spark: SparkSession, path: str, windows: DataFrame, window: str, block: int) -> DataFrame:
    """(window, row, col, ...) of the pixels of each window (low <= row < high, left <= col < right). The windows' blocks
    are sent to the scan, which skips all other partitions while it runs: no bound is known to the driver."""
    asked = windows.where("low < high and left < right").select(F.col(window).alias("_w"), "low", "high", F.col("left").alias("_left"), F.col("right").alias("_right"))
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block).cast("int"), F.floor((F.col(b) - 1) / block).cast("int")))
    blocks = asked.withColumn("block_row", steps("low", "high")).withColumn("block_col", steps("_left", "_right"))
    met = spark.read.parquet(path).join(small(blocks), ["block_row", "block_col"])
    inside = (F.col("row") >= F.col("low")) & (F.col("row") < F.col("high")) & (F.col("col") >= F.col("_left")) & (F.col("col") < F.col("_right"))
    return met.where(inside).drop("low", "high", "_left", "_right", "block_row", "block_col").withColumnRenamed("_w", window)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fields in a fixed order with a header; other columns are left out."""
    df.select(*fields).write.option("header", True).csv(path)


def feature_json(lon: Column, lat: Column, properties: list[str], digits: int = 6, numbers: tuple[str, ...] = ()) -> Column:
    """A point feature as JSON, property keys sorted, null properties and NaN in the named number columns left out."""
    plain = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c) if c in numbers else F.col(c)
    clean = F.struct(*[plain(c) for c in sorted(properties)])
    geometry = F.struct(F.array(F.bround(lon, digits), F.bround(lat, digits)).alias("coordinates"), F.lit("Point").alias("type"))
    return F.to_json(F.struct(geometry.alias("geometry"), clean.alias("properties"), F.lit("Feature").alias("type")), {"ignoreNullFields": "true"})


def write_features(df: DataFrame, path: str, lon: str, lat: str, properties: list[str], order: list[str]) -> None:
    """One feature a line, sorted within each file of a range-sorted set."""
    numbers = tuple(n for n, kind in df.dtypes if kind in ("double", "float"))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.select(feature_json(F.col(lon), F.col(lat), properties, numbers=numbers).alias("value")).write.text(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def write_by_group(df: DataFrame, path: str, group: str) -> None:
    df.write.partitionBy(group).json(path)


def publish(df: DataFrame, path: str, checks: list) -> None:
    """Writes to a staging folder, runs checks (functions from the staged table to violation rows) and puts the
    folder in place only if all are empty; else it raises and the published folder stays as it was. If the new
    folder can't be put in place the old one is put back."""
    spark = df.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    for check in checks:
        bad = check(staged).limit(3).collect()
        if bad:
            raise ValueError(f"not published: {bad}")
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    swap_folders(hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop(staging), hadoop(path), hadoop(old))


def swap_folders(fs, staging, path, old) -> None:
    """Puts staging in the place of path, which may exist; on failure path is as it was."""
    had = fs.exists(path)
    if had:
        fs.delete(old, True)
        if not fs.rename(path, old):
            raise OSError(f"{path} could not be set aside")
    try:
        done = fs.rename(staging, path)
    except Exception:
        done = False
    if not done:
        if had and not fs.rename(old, path):
            raise OSError(f"{staging} could not be put in place; the former table is {old}")
        raise OSError(f"{staging} could not be put in place")
    fs.delete(old, True)


def output_manifest(df: DataFrame) -> DataFrame:
    """(file, bytes, records) of a table read from files."""
    told = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return told.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("records"))


def stale_partitions(spark: SparkSession, inputs: str, outputs: str, depth: int = -2, tags: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """Partition folders (the path part at depth) whose newest input is later than their oldest output, that have no
    output, or (with tags: part, tag as recorded with the output) that another version of the algorithm made. Files
    are listed, not read."""

    def times(path: str, agg) -> DataFrame:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
        return listed.groupBy(F.element_at(F.split("path", "/"), depth).alias("part")).agg(agg("modificationTime").alias("t"))

    made = times(outputs, F.min).withColumnRenamed("t", "made")
    told = times(inputs, F.max).join(made.hint("merge"), "part", "left")
    late = F.col("made").isNull() | (F.col("t") > F.col("made"))
    if tags is not None:
        told = told.join(tags.select("part", F.col("tag").alias("_tag")).hint("merge"), "part", "left")
        late = late | ~F.col("_tag").eqNullSafe(F.lit(tag))
    return told.where(late).select("part")


def rebuild_stale(spark: SparkSession, inputs: str, outputs: str, part: str, build, checks: list, tag: str) -> list[str]:
    """Builds the parts (folders part=...) of inputs whose output is missing, older than its input, or made under another
    tag, and puts each in place on its own; all other folders stay as they are. Returns the parts that were built.

    build maps the stale parts' input rows to output rows with the part column; the result goes to a staging folder, where
    checks (functions from the staged table to violation rows) must find nothing. A part that loses all its rows
    loses its folder. The tag is kept beside the parts in a table of its own.
    """
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(outputs).getFileSystem(spark._jsc.hadoopConfiguration())
    made, tags = fs.exists(hadoop(outputs)), f"{outputs}.tags"
    known = spark.read.parquet(tags) if fs.exists(hadoop(tags)) else spark.createDataFrame([], "part string, tag string")
    if made:
        stale = stale_partitions(spark, inputs, outputs, tags=known, tag=tag)
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path")
        stale = listed.select(F.element_at(F.split("path", "/"), -2).alias("part")).distinct()
    names = sorted(r[0] for r in stale.collect())  # names of folders, no rows of theirs
    if not names:
        return []
    staging = f"{outputs}.staging"
    fresh = spark.read.parquet(inputs).where(F.concat(F.lit(f"{part}="), F.col(part).cast("string")).isin(names))
    build(fresh).repartition(part).write.mode("overwrite").partitionBy(part).parquet(staging)
    staged = spark.read.parquet(staging) if any(fs.exists(hadoop(f"{staging}/{n}")) for n in names) else None
    for check in checks if staged is not None else []:
        if bad := check(staged).limit(3).collect():
            raise ValueError(f"not published: {bad}")
    fs.mkdirs(hadoop(outputs))
    for name in names:
        if fs.exists(hadoop(f"{staging}/{name}")):
            swap_folders(fs, hadoop(f"{staging}/{name}"), hadoop(f"{outputs}/{name}"), hadoop(f"{outputs}.old-{name}"))
        else:
            fs.delete(hadoop(f"{outputs}/{name}"), True)
    fs.delete(hadoop(staging), True)
    kept = [(r["part"], r["tag"]) for r in known.where(~F.col("part").isin(names)).collect()] + [(n, tag) for n in names]
    spark.createDataFrame(kept, "part string, tag string").coalesce(1).write.mode("overwrite").parquet(f"{tags}.new")
    swap_folders(fs, hadoop(f"{tags}.new"), hadoop(tags), hadoop(f"{tags}.old"))
    return names
