"""Numbers of rows and draws that follow from values, not from how a table is dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.world import shared

LOTS = 1024


def numbered(df: DataFrame, by: list[str], name: str = "n", lots: int = LOTS) -> DataFrame:
    """df with 0, 1, ... within each world, in the order of (lot of the key, key).

    A world's rows are counted by lot and numbered within lots, so that one world's rows are many tasks.
    """
    keys = [F.col(f"`{c}`") for c in by]
    lot = F.pmod(F.xxhash64(*keys), F.lit(lots)).cast("int") if keys else F.lit(0)
    placed = df.withColumn("_lot", lot)
    sums = placed.groupBy("world_id", "_lot").agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy("world_id").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    # at most `lots` rows a world
    sums = sums.select("world_id", "_lot", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("world_id", "_lot").orderBy(*(keys or [F.lit(0)]))
    ranked = placed.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(sums, ["world_id", "_lot"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_lot", "_in", "_base")


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with 1, 2, ... under `name` in the order of `by`, which tells rows apart.

    Rows are dealt by ranges of the order; what is ranked in one task is the number of rows of each range. Ranges are
    drawn anew for each run, so they are written down before they are counted.
    """
    shared(df.sparkSession)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_held")).select("_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_base"))
    found = dealt.withColumn("_part", part).join(sizes, "_part")
    return found.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, name)


def chosen_of(value: Column, table: dict, default: Column | None = None) -> Column:
    """The value that a small mapping gives; the default, or null, for others."""
    if not table:
        return default if default is not None else F.lit(None)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return found if default is None else F.coalesce(found, default)


def clamped(value: Column, low=None, high=None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def softmax(df: DataFrame, score: str, by: list[str], name: str = "p", logarithm: bool = False) -> DataFrame:
    """A column of each row's share of exp(score) within `by`, or its logarithm; sums are aggregated, not windowed."""
    top = df.groupBy(*by).agg(F.max(score).alias("_top"))
    near = df.join(top, by)
    total = near.groupBy(*by).agg(F.sum(F.exp(F.col(score) - F.col("_top"))).alias("_total"))
    log_p = F.col(score) - F.col("_top") - F.log("_total")
    return near.join(total, by).withColumn(name, log_p if logarithm else F.exp(log_p)).drop("_top", "_total")


def reinforce_loss(df: DataFrame, log_p: str, reward: str, by: list[str]) -> DataFrame:
    """by and loss: minus the mean of reward times the logarithm of the chosen action's probability."""
    return df.groupBy(*by).agg((-F.avg(F.col(reward) * F.col(log_p))).alias("loss"))
