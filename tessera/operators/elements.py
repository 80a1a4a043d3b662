"""Worlds as graphs: a node for each row, an edge for each foreign key that is set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.world import World


def nodes(world: World, features: list[str] | None = None, one_hot: bool = False) -> DataFrame:
    """(world_id, ob, part_id, feat): numeric attrs in the order of `features`, 0 where a table has no such attr or
    the value is unset; behind the one-hot place of the table, if asked for. attrs that aren't numbers go through
    tessera.functions.encoding first."""
    features = features or []
    parts = []
    for o, t in world.tables.items():
        own = world.schema.attrs_of(o)
        hot = [F.lit(float(o == x)).cast("float") for x in world.schema.obs] if one_hot else []
        feat = hot + [F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) if n in own else F.lit(0.0).cast("float") for n in features]
        parts.append(t.select("world_id", F.lit(o).alias("ob"), "part_id", (F.array(*feat) if feat else F.array().cast("array<float>")).alias("feat")))
    return reduce(DataFrame.unionByName, parts)


def edges(world: World, both_ways: tuple[str, ...] = ()) -> DataFrame:
    """(world_id, src_ob, src_id, dst_ob, dst_id, hom); homs in both_ways have a reversed edge as well."""
    parts = []
    for h, (a, b) in world.schema.homs.items():
        t = world.table(a).where(F.col(h).isNotNull())
        parts.append(t.select("world_id", F.lit(a).alias("src_ob"), F.col("part_id").alias("src_id"), F.lit(b).alias("dst_ob"), F.col(h).alias("dst_id"), F.lit(h).alias("hom")))
        if h in both_ways:
            parts.append(t.select("world_id", F.lit(b).alias("src_ob"), F.col(h).alias("src_id"), F.lit(a).alias("dst_ob"), F.col("part_id").alias("dst_id"), F.lit(h).alias("hom")))
    if not parts:
        return world.spark.createDataFrame([], "world_id bigint, src_ob string, src_id bigint, dst_ob string, dst_id bigint, hom string")
    return reduce(DataFrame.unionByName, parts)


def live(found: DataFrame, world: World) -> DataFrame:
    """Edges both ends of which are rows: two semi-joins."""
    there = nodes(world).select(F.col("world_id").alias("_w"), F.col("ob").alias("_o"), F.col("part_id").alias("_p"))
    for side in ("src", "dst"):
        found = found.join(there, (F.col("world_id") == F.col("_w")) & (F.col(f"{side}_ob") == F.col("_o")) & (F.col(f"{side}_id") == F.col("_p")), "left_semi")
    return found


def positions(world: World, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with a dense index in each world, and edges as pairs of indexes: coordinate form for graph networks."""
    from tessera.functions.numbering import numbered

    n = numbered(nodes(world, features), ["ob", "part_id"], "index")
    at = n.select(F.col("world_id").alias("_w"), F.col("ob").alias("_o"), F.col("part_id").alias("_p"), F.col("index").alias("_i"))
    e = edges(world)
    for side in ("src", "dst"):
        e = e.join(at, (F.col("world_id") == F.col("_w")) & (F.col(f"{side}_ob") == F.col("_o")) & (F.col(f"{side}_id") == F.col("_p"))).withColumn(side, F.col("_i")).drop("_w", "_o", "_p", "_i")
    return n, e.select("world_id", "src", "dst", "hom")
