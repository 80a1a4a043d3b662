"""Are two worlds the same but for their ids? Colours of rows, refined by what rows refer to and what refers to them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import match
from tessera.pattern import Pattern
from tessera.world import World, shared

#: Worlds with equal colours of at most so many rows are compared by a search as well.
SMALL = 24


def _mix(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def colours(world: World, rounds: int | None = None) -> DataFrame:
    """(world_id, ob, part_id, colour): rows that differ in values or in their surroundings get different colours.

    A round adds the colours of the rows that a row refers to, and the sum over those that refer to it, by foreign
    key. It ends when the number of colours grows no more, or after `rounds`.
    """
    shared(world.spark)
    nodes = reduce(DataFrame.unionByName, [t.select("world_id", F.lit(o).alias("ob"), "part_id", _mix(F.lit(o), *[F.col(n) for n in sorted(world.schema.attrs_of(o))]).alias("colour")) for o, t in world.tables.items()]).checkpoint()
    edges = [t.where(F.col(h).isNotNull()).select("world_id", F.lit(h).alias("hom"), F.lit(a).alias("a"), F.col("part_id").alias("x"), F.lit(b).alias("b"), F.col(h).alias("y")) for h, (a, b) in world.schema.homs.items() for t in [world.tables[a]]]
    if not edges:
        return nodes
    links = reduce(DataFrame.unionByName, edges).checkpoint()
    links = links.select("world_id", "hom", F.lit(1).alias("way"), F.col("a").alias("ob"), F.col("x").alias("part_id"), F.col("b").alias("_ob"), F.col("y").alias("_p")).unionByName(
        links.select("world_id", "hom", F.lit(2).alias("way"), F.col("b").alias("ob"), F.col("y").alias("part_id"), F.col("a").alias("_ob"), F.col("x").alias("_p"))
    )
    seen = nodes.select("world_id", "colour").distinct().count()
    while rounds is None or rounds > 0:
        far = nodes.select(F.col("world_id").alias("_w"), F.col("ob").alias("_o"), F.col("part_id").alias("_q"), F.col("colour").alias("_c"))
        # a sum of hashes doesn't depend on an order
        given = links.join(far, (F.col("world_id") == F.col("_w")) & (F.col("_ob") == F.col("_o")) & (F.col("_p") == F.col("_q")))
        given = given.groupBy("world_id", "ob", "part_id").agg(F.sum(_mix("hom", "way", "_c").cast("decimal(38,0)")).alias("around"))
        nodes = nodes.join(given, ["world_id", "ob", "part_id"], "left").withColumn("colour", _mix("colour", F.col("around").cast("string"))).drop("around").checkpoint()
        now = nodes.select("world_id", "colour").distinct().count()
        if now == seen:
            break
        seen = now
        rounds = None if rounds is None else rounds - 1
    return nodes


def as_pattern(world: World, world_id: int) -> Pattern:
    """A small world as a pattern: an element for each row; unset values are left open."""
    rows = {o: [r.asDict() for r in t.where(F.col("world_id") == world_id).collect()] for o, t in world.tables.items()}
    name = lambda o, i: f"{o}_{i}"
    return Pattern(
        world.schema, {name(o, r["part_id"]): o for o, rs in rows.items() for r in rs}, {(name(o, r["part_id"]), h): name(b, r[h]) for o, rs in rows.items() for r in rs for h, b in world.schema.homs_of(o).items() if r[h] is not None},
        {(name(o, r["part_id"]), n): r[n] for o, rs in rows.items() for r in rs for n in world.schema.attrs_of(o) if r[n] is not None},
    )


def isomorphic(a: World, b: World) -> DataFrame:
    """(world_id, same): worlds of both batches by their ids, compared up to the ids of their rows.

    Different numbers of a colour prove a difference. Equal numbers prove sameness where no two rows have one colour;
    of worlds with repeated colours, those of at most SMALL rows are searched, and larger ones count as the same.
    """
    if a.schema != b.schema:
        return a.ids.select("world_id", F.lit(False).alias("same"))
    # one batch, so that both sides are refined equally often
    twin = lambda df, side: df.withColumn("world_id", 2 * F.col("world_id") + side)
    joint = replace(a, tables={o: twin(a.tables[o], 0).unionByName(twin(b.tables[o], 1)) for o in a.schema.obs}, ids=twin(a.ids, 0).unionByName(twin(b.ids, 1)), one_world=False, counters=None)
    both = colours(joint).withColumn("side", 1 - 2 * F.pmod("world_id", F.lit(2))).withColumn("world_id", F.floor(F.col("world_id") / 2))
    kinds = both.groupBy("world_id", "colour").agg(F.sum("side").alias("over"), F.count(F.lit(1)).alias("n"))
    found = kinds.groupBy("world_id").agg(F.max(F.abs("over")).alias("over"), F.max("n").alias("n"), F.sum("n").alias("rows")).checkpoint()
    ids = a.ids.select("world_id").unionByName(b.ids.select("world_id")).groupBy("world_id").agg(F.count(F.lit(1)).alias("there"))
    by_colour = ids.join(found, "world_id", "left").select("world_id", ((F.col("there") == 2) & (F.coalesce("over", F.lit(0)) == 0)).alias("same"))
    unsure = found.where((F.col("over") == 0) & (F.col("n") > 2) & (F.col("rows") <= 2 * SMALL)).select("world_id").collect()
    no = []
    for r in unsure:
        w = r["world_id"]
        here = b.only(b.ids.where(F.col("world_id") == w))
        if match(as_pattern(a, w), here, monic=True).isEmpty():
            no.append(w)
    return by_colour.withColumn("same", F.col("same") & ~F.col("world_id").isin(no)) if no else by_colour
