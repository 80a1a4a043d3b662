"""Rewriting: matches of a rule, and their deletions, insertions and updates, for all worlds at once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbering import clamped, numbered
from tessera.operators.matching import match, tick
from tessera.pattern import Var
from tessera.rule import Rule
from tessera.world import World, shared


def legal(rule: Rule, world: World, pins: dict[str, Any] | DataFrame | None = None, take: int | None = None, seed: int = 0, limit: int | None = None, view=None) -> DataFrame:
    """The matches that a rule may be applied at: conditions, identification and dangling checks first, then limits.

    Conditions see the whole world even where a view restricts the matches. Pins come before all of it, and the
    search for extensions starts from the pinned matches as well.
    """
    from tessera.operators import matching

    found = match(rule.left, world, rule.monic, pins, rule.thresholds, view=view)
    found = rule.guard.applied(found, rule.left, world, anchored=pins is not None)
    if take is not None:
        found = matching.sample(found, rule.left, take, seed)
    if limit is not None:
        found = matching.first(found, limit, matching.order(rule.left), world.one_world)
    return found


@dataclass(frozen=True)
class Change:
    """What a rewrite did: rows (world_id, part_id) by table, and the new ids of added elements by match."""

    world: World
    deleted: dict[str, DataFrame]
    inserted: dict[str, DataFrame]
    updated: dict[str, DataFrame]
    images: DataFrame


def _next_ids(world: World, ob: str) -> DataFrame:
    """(world_id, next): above every id that the table has or, by the counters, ever had."""
    high = world.table(ob).groupBy("world_id").agg((F.max("part_id") + 1).alias("next"))
    if world.counters is not None:
        high = high.unionByName(world.counters.where(F.col("ob") == ob).select("world_id", "next")).groupBy("world_id").agg(F.max("next").alias("next"))
    return world.ids.select("world_id").join(high, "world_id", "left").withColumn("next", F.coalesce("next", F.lit(1).cast("long")))


def _value(rule: Rule, element: str, attr: str, v: Any) -> Column:
    """A right-hand value over the columns of a match with its attrs."""

    def of(name: str) -> Column:
        return tick(name if "." in name else f"?{name}")

    if isinstance(v, Var):
        return tick(f"?{v.name}")
    return v(of) if callable(v) else F.lit(v)


def _carried(rule: Rule, chosen: DataFrame, world: World) -> DataFrame:
    """The chosen matches with the attrs that new values are made of; rows they came with are kept."""
    for e, names in rule.needed().items():
        t = world.table(rule.left.elements[e]).select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"), *[F.col(n).alias(f"{e}.{n}") for n in names])
        chosen = chosen.join(t, (F.col("world_id") == F.col("_w")) & (tick(e) == F.col("_p"))).drop("_w", "_p")
    return chosen


def apply(rule: Rule, chosen: DataFrame, world: World) -> Change:
    """Apply the rule at every chosen match, set at a time: delete, then insert, then update.

    Chosen matches of one world must not undo each other; independent() sees to that. New ids are counted upwards
    from the highest that a table ever had.
    """
    ids = list(rule.left.elements)
    chosen = numbered(_carried(rule, chosen, world), ids, "_n")
    tables = dict(world.tables)
    counters: list[DataFrame] = []
    deleted: dict[str, DataFrame] = {}
    for o in world.schema.obs:
        if own := [e for e in rule.deleted if rule.left.elements[e] == o]:
            gone = reduce(DataFrame.unionByName, [chosen.select("world_id", tick(e).alias("part_id")) for e in own]).distinct()
            deleted[o] = gone
            # what was deleted may have had the highest id; insertions show in the table
            counters.append(_next_ids(world, o).select("world_id", F.lit(o).alias("ob"), "next"))
            tables[o] = tables[o].join(gone, ["world_id", "part_id"], "left_anti")

    # ids of new rows: as many for each match as the rule adds to a table
    places: dict[str, str] = {b: a for a, b in reversed(rule.keep.items())}
    for o in world.schema.obs:
        own = [e for e in rule.added if rule.right.elements[e] == o]
        if own:
            chosen = chosen.join(_next_ids(world, o).withColumnRenamed("next", f"_next_{o}"), "world_id")
            for i, e in enumerate(own):
                chosen = chosen.withColumn(f"+{e}", F.col(f"_next_{o}") + F.col("_n") * len(own) + i)
                places[e] = f"+{e}"

    inserted: dict[str, DataFrame] = {}
    for o in world.schema.obs:
        struct = world.schema.struct(o)
        rows = []
        for e in (e for e in rule.added if rule.right.elements[e] == o):
            cols = [F.col("world_id"), tick(places[e]).alias("part_id")]
            for f in struct.fields[2:]:
                if f.name in world.schema.homs:
                    to = rule.right.homs.get((e, f.name))
                    cols.append((tick(places[to]) if to else F.lit(None)).cast("long").alias(f.name))
                else:
                    v = rule.expressions.get((e, f.name), rule.right.attrs.get((e, f.name)))
                    free = v is None or (isinstance(v, Var) and v.name not in rule.left.variables())
                    cols.append((F.lit(None) if free else _value(rule, e, f.name, v)).cast(f.dataType).alias(f.name))
            rows.append(chosen.select(*cols))
        if rows:
            inserted[o] = reduce(DataFrame.unionByName, rows)
            tables[o] = tables[o].unionByName(inserted[o])

    updated: dict[str, DataFrame] = {}
    attrs, homs = rule.changed_attrs(), rule.changed_homs()
    for o in world.schema.obs:
        parts = []
        names = sorted({n for e in rule.keep if rule.left.elements[e] == o for n in [*attrs.get(e, {}), *homs.get(e, {}), *[d.attr for d in rule.deltas if d.element == e]]})
        for e in (e for e in rule.keep if rule.left.elements[e] == o):
            own: dict[str, Column] = {n: _value(rule, e, n, v) for n, v in attrs.get(e, {}).items()}
            own |= {h: tick(places[to]) for h, to in homs.get(e, {}).items()}
            for d in rule.deltas:
                if d.element == e:
                    own[d.attr] = clamped(own.get(d.attr, tick(f"{e}.{d.attr}")) + F.lit(d.by), d.low, d.high)
            if own:
                kind = {f.name: f.dataType for f in world.schema.struct(o)}
                # a struct tells "set to NULL" from "not set"
                parts.append(chosen.select(F.col("world_id"), tick(e).alias("part_id"), *[(F.struct(own[n].cast(kind[n]).alias("v")) if n in own else F.lit(None).cast(f"struct<v:{kind[n].simpleString()}>")).alias(f"_{n}") for n in names]))
        if parts:
            new = reduce(DataFrame.unionByName, parts).groupBy("world_id", "part_id").agg(*[F.max(f"_{n}").alias(f"_{n}") for n in names])
            updated[o] = new.select("world_id", "part_id")
            joined = tables[o].join(new, ["world_id", "part_id"], "left")
            tables[o] = joined.select(*[F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in world.schema.struct(o).names])

    for o in dict.fromkeys(rule.left.elements[a] for a, _ in rule.merged):
        pairs = [chosen.select("world_id", tick(a).alias("gone"), tick(b).alias("stays")) for a, b in rule.merged if rule.left.elements[a] == o]
        one = _representatives(reduce(DataFrame.unionByName, pairs).where("gone <> stays").distinct())
        counters.append(_next_ids(world, o).select("world_id", F.lit(o).alias("ob"), "next"))
        gone = one.select("world_id", F.col("part_id").alias("part_id"))
        deleted[o] = deleted[o].unionByName(gone) if o in deleted else gone
        tables[o] = tables[o].join(gone, ["world_id", "part_id"], "left_anti")
        to = one.select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"), F.col("root").alias("_root"))
        for h, (a, b) in world.schema.homs.items():
            if b == o:
                moved = tables[a].join(to, (F.col("world_id") == F.col("_w")) & (F.col(h) == F.col("_p")), "left")
                hit = moved.where("_p is not null").select("world_id", "part_id")
                updated[a] = updated[a].unionByName(hit).distinct() if a in updated else hit
                tables[a] = moved.withColumn(h, F.coalesce("_root", h)).drop("_w", "_p", "_root").select(*world.schema.struct(a).names)

    kept = world.counters
    if counters:
        fresh = reduce(DataFrame.unionByName, counters)
        kept = fresh if kept is None else kept.unionByName(fresh).groupBy("world_id", "ob").agg(F.max("next").alias("next"))
    after = replace(world, tables=tables, counters=kept)
    images = chosen.select("world_id", *[tick(places[e]).alias(e) for e in rule.right.elements])
    return Change(after, deleted, inserted, updated, images)


def _representatives(pairs: DataFrame) -> DataFrame:
    """(world_id, part_id, root) of rows that become another: pairs (gone, stays) of all matches, followed to the end.

    A row that stays for one match and goes for another takes its rows along; of several that a row becomes, and in
    circles, the least id stays.
    """
    shared(pairs.sparkSession)
    both = pairs.select("world_id", F.col("gone").alias("a"), F.col("stays").alias("b")).unionByName(pairs.select("world_id", F.col("stays").alias("a"), F.col("gone").alias("b"))).distinct().checkpoint()
    # rows that only stay are preferred as roots of what becomes one
    only = pairs.select("world_id", F.col("stays").alias("part_id")).distinct().join(pairs.select("world_id", F.col("gone").alias("part_id")).distinct(), ["world_id", "part_id"], "left_anti").withColumn("top", F.lit(0))
    roots = both.select("world_id", F.col("a").alias("part_id")).distinct().join(only, ["world_id", "part_id"], "left")
    roots = roots.select("world_id", "part_id", F.struct(F.coalesce("top", F.lit(1)).alias("late"), F.col("part_id").alias("id")).alias("root")).checkpoint()
    while True:
        near = both.join(roots, (both["world_id"] == roots["world_id"]) & (both["b"] == roots["part_id"])).groupBy(both["world_id"], both["a"].alias("part_id")).agg(F.min("root").alias("near"))
        step = roots.join(near, ["world_id", "part_id"]).select("world_id", "part_id", F.col("root").alias("was"), F.least("root", "near").alias("root")).checkpoint()
        roots = step.drop("was")
        if step.where("root <> was").isEmpty():
            return roots.select("world_id", "part_id", F.col("root.id").alias("root")).where("part_id <> root")


def independent(rule: Rule, chosen: DataFrame, rank: list[Column]) -> DataFrame:
    """Of matches that contend for a row, the first by rank.

    Rows that a match deletes or changes may be used by no other match of the world; a match stays if it is the first
    at every row that it shares with such a use.
    """
    changing = [*rule.deleted, *[e for pair in rule.merged for e in pair], *[e for e in rule.keep if e in rule.changed_attrs() or e in rule.changed_homs() or any(d.element == e for d in rule.deltas)]]
    if not changing or not rule.left.elements:
        return chosen
    placed = numbered_rank(chosen, rank)
    uses = [placed.select("world_id", "_rank", F.lit(rule.left.elements[e]).alias("ob"), tick(e).alias("part_id"), F.lit(e in changing).alias("changes")) for e in rule.left.elements]
    used = reduce(DataFrame.unionByName, uses)
    lead = used.groupBy("world_id", "ob", "part_id").agg(F.min("_rank").alias("_lead"), F.max("changes").alias("_contended")).where("_contended")
    late = used.join(lead, ["world_id", "ob", "part_id"]).where(F.col("_rank") > F.col("_lead")).select("world_id", "_rank").distinct()
    return placed.join(late, ["world_id", "_rank"], "left_anti").drop("_rank")


def numbered_rank(df: DataFrame, rank: list[Column]) -> DataFrame:
    """df with _rank: a struct that sorts as `rank` does."""
    return df.withColumn("_rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]))


def cascade(world: World, seeds: dict[str, DataFrame]) -> World:
    """Delete rows (world_id, part_id) by table, and all rows that refer to deleted ones, to the end.

    The rounds end when nothing new goes: without cycles after the longest chain of foreign keys among the tables.
    What goes is checkpointed in each round, so that a round reads no earlier one.
    """
    shared(world.spark)
    tables, front = dict(world.tables), dict(seeds)
    while front:
        for o, gone in front.items():
            tables[o] = tables[o].join(gone.select("world_id", "part_id"), ["world_id", "part_id"], "left_anti")
        after: dict[str, list[DataFrame]] = {}
        for h, (a, b) in world.schema.homs.items():
            if b in front:
                gone = front[b].select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"))
                t = tables[a]
                after.setdefault(a, []).append(t.join(gone, (t["world_id"] == F.col("_w")) & (t[h] == F.col("_p")), "left_semi").select("world_id", "part_id"))
        front = {o: reduce(DataFrame.unionByName, dfs).distinct().checkpoint() for o, dfs in after.items()}
        front = {o: df for o, df in front.items() if not df.isEmpty()}
    return replace(world, tables=tables)
