"""Change logs: rows that were added, changed or deleted between two states of the same worlds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.world import World

COLUMNS = "world_id bigint, ob string, part_id bigint, change string"


def table_changes(before: DataFrame, after: DataFrame, ob: str) -> DataFrame:
    """(world_id, ob, part_id, change): `add`, `delete` or `update`; one full join on the row's id."""
    values = [c for c in after.columns if c not in ("world_id", "part_id")]
    a = before.select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"), F.struct(F.lit(1), *values).alias("_old"))
    b = after.select("world_id", "part_id", F.struct(F.lit(1), *values).alias("_new"))
    both = b.join(a, (F.col("world_id") == F.col("_w")) & (F.col("part_id") == F.col("_p")), "full")
    kind = F.when(F.col("_p").isNull(), "add").when(F.col("part_id").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    found = both.select(F.coalesce("world_id", "_w").alias("world_id"), F.lit(ob).alias("ob"), F.coalesce("part_id", "_p").alias("part_id"), kind.alias("change"))
    return found.where("change is not null")


def between(before: World, after: World) -> DataFrame:
    """Changes of all tables; tables that are the same DataFrame in both states are passed over."""
    parts = [table_changes(before.tables[o], after.tables[o], o) for o in after.schema.obs if before.tables[o] is not after.tables[o]]
    return reduce(DataFrame.unionByName, parts) if parts else after.spark.createDataFrame([], COLUMNS)


def events(log: DataFrame) -> DataFrame:
    """(world_id, step, ob, part_id, added): an update is a deletion and an addition."""
    added = F.explode(F.when(F.col("change") == "update", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("change") == "add")))
    return log.select("world_id", "step", "ob", "part_id", added.alias("added"))


def replayed(before: DataFrame, log: DataFrame, after_values: DataFrame, ob: str) -> DataFrame:
    """A table after the changes of a log: deleted rows go, added and updated ones come from after_values."""
    own = log.where(F.col("ob") == ob).select("world_id", "part_id", "change")
    kept = before.join(own, ["world_id", "part_id"], "left_anti")
    new = after_values.join(own.where("change <> 'delete'").select("world_id", "part_id"), ["world_id", "part_id"], "left_semi")
    return kept.unionByName(new)
