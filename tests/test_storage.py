import os
import time

import pytest
from pyspark.sql import functions as F

from wayspan.sources import files


def test_windows_prune_partitions_while_running(spark, tmp_path):
    path = f"{tmp_path}/pixels"
    pixels = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.col("id").alias("v"))
    files.write_pixels(pixels, path, 8)
    windows = spark.createDataFrame([("a", 3, 9, 60, 64), ("b", 3, 4, 61, 62), ("none", 5, 5, 0, 9), ("out", 90, 99, 0, 9), ("neg", -5, 1, -1, 2)], "w string, low int, high int, left int, right int")
    got = files.read_pixels_within(spark, path, windows, "w", 8)
    rows = sorted((r.w, r.row, r.col, r.v) for r in got.collect())
    box = {"a": (3, 9, 60, 64), "b": (3, 4, 61, 62), "neg": (-5, 1, -1, 2)}
    assert rows == sorted((w, r, c, r * 64 + c) for w, (a, b, x, y) in box.items() for r in range(max(a, 0), b) for c in range(max(x, 0), y))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text
    scan = spark.read.parquet(path)
    assert scan.inputFiles() and got.select(F.input_file_name().alias("f")).distinct().count() <= 3  # of 64 blocks


def folders(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith("parquet")) for d in os.listdir(path) if d.startswith("p=")}


def test_only_stale_parts_are_built(spark, tmp_path):
    inputs, outputs = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([(p, v) for p in "abcd" for v in range(3)], "p string, v int")
    rows.write.partitionBy("p").parquet(inputs)
    total = lambda df: df.groupBy("p").agg(F.sum("v").alias("v")).where("v > 0")
    none = [lambda df: df.where("v > 50")]
    run = lambda tag, build=total: files.rebuild_stale(spark, inputs, outputs, "p", build, none, tag)
    assert run("1") == ["p=a", "p=b", "p=c", "p=d"]
    assert run("1") == []
    before = folders(outputs)
    time.sleep(0.05)
    spark.createDataFrame([("b", 10), ("e", 1)], "p string, v int").write.mode("append").partitionBy("p").parquet(inputs)
    assert run("1") == ["p=b", "p=e"]
    after = folders(outputs)
    assert {d for d in before if before[d] == after[d]} == {"p=a", "p=c", "p=d"} and "p=e" in after
    assert {r.p: r.v for r in spark.read.parquet(outputs).collect()} == {"a": 3, "b": 13, "c": 3, "d": 3, "e": 1}
    time.sleep(0.05)
    spark.createDataFrame([("c", 60)], "p string, v int").write.mode("append").partitionBy("p").parquet(inputs)
    with pytest.raises(ValueError, match="not published"):
        run("1")
    assert folders(outputs) == after  # what was published stays
    assert run("2", lambda df: total(df.where("v < 50 and p <> 'a'"))) == ["p=a", "p=b", "p=c", "p=d", "p=e"]  # another tag
    assert {r.p: r.v for r in spark.read.parquet(outputs).collect()} == {"b": 13, "c": 3, "d": 3, "e": 1}
