"""Event cleaning by whitelist: the same function for batch and stream, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def clean_events(events: DataFrame, allowed: dict[str, dict[str, list[str] | None]], name: str = "name", props: str = "props") -> DataFrame:
    """Known events only, each with the properties that its whitelist has (key, and value where values are
    listed). Any other property is dropped on its own; props is map<string,string>."""
    def keep(k, v):
        out = F.lit(False)
        for event, keys in allowed.items():
            for key, values in keys.items():
                out = out | ((F.col(name) == event) & (k == key) & (F.lit(True) if values is None else v.isin(*values)))
        return F.coalesce(out, F.lit(False))

    return events.where(F.col(name).isin(*allowed)).withColumn(props, F.map_filter(F.col(props), keep))


def clean_stream(spark: SparkSession, source: str, schema: str, allowed: dict, sink: str, checkpoint: str) -> DataStreamWriter:
    """A stream from parquet files to parquet files; start() runs it."""
    read = spark.readStream.schema(schema).parquet(source)
    return clean_events(read, allowed).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
