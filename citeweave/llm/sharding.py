"""Operator 5, sharding by fixed virtual slots (DataFrame functions only).

Each record is hashed into one of a few thousand virtual slots, for good. Bytes and rows are summed per slot, which
gives a table of fixed size whatever the input. A map from slots to shards is built from it, largest slot first onto
the lightest shard, and kept as a table with a version. Rebalancing writes the next version: it moves slots, never
single records, and leaves all other slots where they were.

Places within a shard are counted in small groups, a virtual slot's rows of some input partitions, so no task sees a
whole shard and a record that is repeated very often is spread too. These groups are a stored column, so they stay the
same when a task is run again.

Nulls: a null text has size 8 (no bytes); a null doc_id is a value like any other. Repeated rows stay repeated and get
positions of their own. An empty table gives no rows. Columns of the input beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed for the life of a data set; the map has so many rows at most, so it may be broadcast and folded.
SLOTS = 4096
#: Groups that a slot's rows are counted in, by input partition.
GROUPS = 16


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and counting group of each record. To be stored before it is assigned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), slot_of(slots).alias("virtual_slot"), F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; summed before the shuffle, so a task sends one row a slot."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _folded(totals: DataFrame, load: Column, extra: str | None = None) -> DataFrame:
    """Give the slots of `totals`, largest first, to the shard with the least load so far. One row of SLOTS elements at most.

    load: the shards' loads before, made of constants or of the column `extra`, which is the same in all rows.
    """
    listed = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("virtual_slot").alias("v")))).alias("todo"), *([F.first(extra).alias(extra)] if extra else []))
    start = F.struct(load.alias("load"), F.expr("cast(array() as array<int>)").alias("to"))

    def give(acc: Column, x: Column) -> Column:
        # the position of the least load; ties go to the lowest shard
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        # a slot weighs one byte at least, so that empty slots are spread as well
        return F.struct(F.transform(acc["load"], lambda v, i: F.when(i == at - 1, v + F.greatest(-x["b"], F.lit(1))).otherwise(v)).alias("load"), F.concat(acc["to"], F.array(at - 1)).alias("to"))

    given = listed.select("todo", F.aggregate("todo", start, give, lambda acc: acc["to"]).alias("to"))
    return given.select(F.explode(F.arrays_zip("todo", "to")).alias("x")).select(F.col("x.todo.v").alias("virtual_slot"), F.col("x.to").alias("shard"))


def first_map(totals: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the slot map: version, virtual_slot, shard, bytes, n; all slots, those without rows too."""
    every = totals.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(totals, "virtual_slot", "left")
    every = every.select("virtual_slot", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "n")))
    given = _folded(every, F.array_repeat(F.lit(0).cast("long"), shards))
    return every.join(F.broadcast(given), "virtual_slot").select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "n")


def rebalanced(old: DataFrame, totals: DataFrame, shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map for new totals or another number of shards.

    Within each shard, slots stay, largest first, as long as they fit under the mean load and `slack`. Those beyond it
    and slots of shards that are gone go to the lightest shards. No other slot moves.
    """
    everything, run = Window.partitionBy(F.lit(0)), Window.partitionBy("was").orderBy(F.desc("bytes"), "virtual_slot")  # SLOTS rows at most
    now = old.select("virtual_slot", F.when(F.col("shard") < shards, F.col("shard")).alias("was"), "version").join(totals, "virtual_slot", "left")
    now = now.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("bytes", "n")})
    now = now.withColumns({"limit": F.sum("bytes").over(everything) / shards * (1 + slack), "version": F.max("version").over(everything) + 1})
    now = now.withColumn("stays", F.col("was").isNotNull() & (F.sum("bytes").over(run) <= F.col("limit")))
    kept = now.filter("stays")
    loads = kept.groupBy("was").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("was", "b"))).alias("m")).withColumn("one", F.lit(1))
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("long"))
    moved = now.filter("not stays").withColumn("one", F.lit(1)).join(F.broadcast(loads), "one")
    both = kept.select("virtual_slot", F.col("was").cast("int").alias("shard")).unionByName(_folded(moved, load, "m"))
    return now.select("version", "virtual_slot", "bytes", "n").join(F.broadcast(both), "virtual_slot").select("version", "virtual_slot", "shard", "bytes", "n")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot of each record. slot: its place within its shard, gapless from 0.

    records: as `sized` gives them, stored. They needn't be those that the map was made from: it has all slots, and
    places come from the records' own counts. At most SLOTS * GROUPS counts go to all tasks.
    """
    counts = records.groupBy("virtual_slot", "part").agg(F.count("*").alias("here")).join(F.broadcast(slot_map.select("virtual_slot", "version", "shard")), "virtual_slot", "left")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    small = counts.select("virtual_slot", "part", "version", "shard", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    out = records.withColumn("place", F.row_number().over(place) - 1).join(F.broadcast(small), ["virtual_slot", "part"])
    known = F.when(F.col("shard").isNull(), F.raise_error(F.lit("the map lacks a slot"))).otherwise(F.col("shard"))
    return out.withColumn("shard", known.cast("int")).withColumn("slot", (F.col("base") + F.col("place")).cast("long"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored map; earlier versions stay readable, and one that is there already is an error."""
    slot_map = slot_map.cache()  # SLOTS rows; they name the version and are written
    for (version,) in slot_map.select("version").distinct().collect():
        slot_map.filter(F.col("version") == version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    slot_map.unpersist()


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    found = spark.read.option("basePath", path).parquet(path)
    return found.filter(F.col("version") == (version if version is not None else found.agg(F.max("version")).first()[0]))
