"""Filters, searches and grouped results over published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayspan.functions.text import text_key
from wayspan.operators.graph import checkpointed
from wayspan.operators.metrics import numbered
from wayspan.operators.sizes import small


def contains_all(text: Column, query: Column) -> Column:
    """Every space-separated token of the query is in the text; both are keys already. An empty query matches."""
    return F.forall(F.filter(F.split(query, r"\s+"), lambda t: t != ""), lambda t: F.contains(text, t))


def _grams(text: Column, length: int) -> Column:
    """Distinct substrings of a length; the empty one for length 0."""
    if not length:
        return F.array(F.lit(""))
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substr(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def search(records: DataFrame, queries: DataFrame, text: Column, order: str, limit: int) -> DataFrame:
    """(query, record columns, rank): the first `limit` records for each row of a table of queries (text keys);
    records that begin with the query come first, then by text and the order column. A query without a token finds
    nothing.

    A query's longest token stands for it by its first three characters (fewer if it is shorter): records meet
    only the queries whose characters they hold, and all tokens are tested after that.
    """
    tokens = F.filter(F.split("query", r"\s+"), lambda t: t != "")
    longest = F.coalesce(F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"], F.lit(""))
    asked = queries.select("query").where(longest != "").distinct().withColumn("_gram", F.substring(longest, 1, 3))
    lengths = [r[0] for r in asked.select(F.length("_gram")).distinct().collect()]  # 1 to 3
    spread = records.withColumn("_text", text).withColumn("_gram", F.explode(F.flatten(F.array(*[_grams(F.col("_text"), n) for n in lengths] or [F.array(F.lit(""))]))))
    met = spread.join(small(asked), "_gram").where(contains_all(F.col("_text"), F.col("query"))).drop("_gram")
    best = Window.partitionBy("query").orderBy(F.startswith("_text", "query").desc(), "_text", order)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("_text")


def write_search_index(records: DataFrame, key: str, text: Column, path: str, shards: int = 64) -> None:
    """Stores an inverted index of a search key (text) under a path: postings (shard, gram, key) of all substrings of
    one to three characters, and how many records hold each. Keys are unique; records without key or text are left out.

    Postings are dealt into ranges of gram and key together, so a gram that every record holds spreads over many
    files; a search reads only the shards of the grams it asks for.
    """
    own = records.select(F.col(key).alias("key"), text.alias("_text")).where("key is not null and _text is not null")
    spread = own.select("key", F.explode(F.flatten(F.array(*[_grams(F.col("_text"), n) for n in (1, 2, 3)]))).alias("gram"))
    postings = spread.withColumn("shard", F.pmod(F.hash("gram"), F.lit(shards)))
    postings.repartitionByRange("shard", "gram", "key").sortWithinPartitions("shard", "gram", "key").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    stored = records.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    stored.groupBy("shard", "gram").agg(F.count(F.lit(1)).alias("records")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/frequencies")


def search_by_index(path: str, records: DataFrame, queries: DataFrame, key: str, text: Column, order: str, limit: int, shards: int = 64) -> DataFrame:
    """The rows of `search` from a stored index of the same records, text and number of shards: no record's characters
    are spread again.

    The rarest substring of a query stands for it; a query with one that no record holds, or without a token, finds
    nothing. Only the postings of the substrings chosen meet queries, and all tokens are tested on the records found.
    """
    spark = records.sparkSession
    stored = lambda name, columns: spark.read.schema(f"{columns}, shard int").parquet(f"{path}/{name}")
    tokens = F.filter(F.split("query", r"\s+"), lambda t: t != "")
    own = F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(_grams(t, 3)))))
    asked = checkpointed(queries.select("query").where("query is not null").distinct().select("query", F.size(own).alias("_all"), F.explode(own).alias("gram")).withColumn("shard", F.pmod(F.hash("gram"), F.lit(shards))))
    known = stored("frequencies", "gram string, records long").join(small(asked), ["shard", "gram"])
    rarest = known.groupBy("query", "_all").agg(F.count(F.lit(1)).alias("_known"), F.min(F.struct("records", "gram", "shard")).alias("r"))
    chosen = checkpointed(rarest.where("_known = _all").select("query", "r.gram", "r.shard"))
    kind = next(f.dataType.simpleString() for f in records.schema if f.name == key)
    read = [r[0] for r in chosen.select("shard").distinct().collect()]  # at most as many numbers as there are shards
    found = stored("postings", f"key {kind}, gram string").where(F.col("shard").isin(read)).join(small(chosen), ["shard", "gram"]).select("query", F.col("key").alias(key))
    met = found.join(records.withColumn("_text", text).hint("merge"), key).where(contains_all(F.col("_text"), F.col("query")))
    best = Window.partitionBy("query").orderBy(F.startswith("_text", "query").desc(), "_text", order)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query", *records.columns, "rank")


def kept_stops(records: DataFrame, query: Column, name: Column) -> DataFrame:
    """Records whose search key holds every token of the query; their order column stays, so the published order
    does. An empty query keeps all. Both texts are search keys."""
    keyed = records.withColumns({"_name": name, "_query": query})
    return keyed.where(contains_all(F.col("_name"), F.col("_query"))).drop("_name", "_query")


def open_at(places: DataFrame, states: str, moment: Column, condition: Column, mode: Column) -> DataFrame:
    """Places observed open at the moment, by access condition under an access mode (public, rider)."""
    allowed = (condition == "unrestricted") | ((mode == "rider") & (condition == "fare_paid"))
    return places.where((F.try_element_at(F.col(states), moment)["observed"] == "open") & mode.isin("public", "rider") & allowed)


def one_matching_cell(candidates: DataFrame, cells: str, action: str, moment: str, access: str, walk: int, gains: tuple[str, ...] = ("gain",)) -> DataFrame:
    """Material candidates of an action with exactly one query cell for the control state, which is active with a
    positive gain in one of its numbers. candidates: action, material_gain, cells (time, access, walk, active, ...)."""
    same = lambda c: (c["time"] == moment) & (c["access"] == access) & (c["walk"] == walk)
    told = candidates.where((F.col("action") == action) & F.col("material_gain")).withColumn("_m", F.filter(cells, same)).where("size(_m) = 1").withColumn("cell", F.get("_m", F.lit(0)))
    some = reduce(Column.__or__, [F.coalesce(F.col(f"cell.{g}") > 0, F.lit(False)) for g in gains])
    return told.where(F.col("cell.active") & some).drop("_m")


def combined(*predicates: Column | None) -> Column:
    """All predicates that are given; none at all is true."""
    return reduce(Column.__and__, [p for p in predicates if p is not None], F.lit(True))


def ranked_groups(df: DataFrame, group: Column, order: list[str], rank: str, key: str) -> DataFrame:
    """(group, place, items): groups in a fixed order, unknown ones last, with their keys by rank, nulls last."""
    names = F.array(*[F.lit(x) for x in order])
    told = df.withColumn("_g", group).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(rank), F.lit(2**31 - 1)).alias("r"), F.col(key).alias("k")))).alias("_i"))
    place = F.coalesce(F.nullif(F.array_position(names, F.col("_g")), F.lit(0)), F.lit(len(order) + 1))
    return told.select(F.col("_g").alias("group"), place.alias("place"), F.transform("_i", lambda s: s["k"]).alias("items"))


def ranked_group_rows(df: DataFrame, group: Column, order: list[str], rank: str, key: str) -> DataFrame:
    """(group, place, position, key): what `ranked_groups` lists, a row an item with its position from 1 in the group, for
    groups of any size: all items are numbered in sorted ranges, and a group's first number is taken off."""
    names = F.array(*[F.lit(x) for x in order])
    place = F.coalesce(F.nullif(F.array_position(names, F.col("group")), F.lit(0)), F.lit(len(order) + 1)).cast("int")
    own = df.select(group.alias("group"), F.col(rank).alias("_r"), F.col(key).alias("key")).select("group", place.alias("place"), F.col("_r").isNull().alias("_last"), "_r", "key")
    told = numbered(own, ["place", "group", "_last", "_r", "key"], "_n")
    first = checkpointed(told.groupBy("group").agg(F.min("_n").alias("_first")).withColumnRenamed("group", "_g"))
    met = told.join(small(first), told["group"].eqNullSafe(first["_g"]))
    return met.select("group", "place", (F.col("_n") - F.col("_first") + 1).alias("position"), F.col("key").alias(key))


def in_name_order(places: DataFrame, name: str, key: str) -> DataFrame:
    """Places by folded name, then id, sorted in ranges."""
    return places.withColumn("_k", text_key(F.col(name))).orderBy("_k", key).drop("_k")


def in_rank_order(candidates: DataFrame, rank: str, key: str) -> DataFrame:
    """Candidates by rank, those without one last, then id."""
    return candidates.orderBy(F.col(rank).asc_nulls_last(), key)


def with_street_ids(points: DataFrame, streets: DataFrame, street: str, street_id: str) -> DataFrame:
    """points with the id of their street, null where it is unknown; few streets are broadcast."""
    return points.join(small(streets.select(street, street_id)), street, "left")
