"""Zones: matches whose zoned rows lie in one zone. Rows without a zone are in every zone."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.matching import match, tick
from tessera.pattern import Pattern, Var
from tessera.world import World


def _zone_of(ob: str) -> str:
    return f"zone@{ob}"


def assigned(world: World, zones: Mapping[str, DataFrame]) -> World:
    """The world with an attr for the zone in the tables of zones: name -> DataFrame(world_id, part_id, zone)."""
    tables = {}
    for o, t in world.tables.items():
        if o in zones:
            z = zones[o].select("world_id", "part_id", F.when(F.col("zone") != 0, F.col("zone")).cast("long").alias(_zone_of(o)))
            t = t.join(z, ["world_id", "part_id"], "left")
        tables[o] = t
    schema = world.schema.extend(attrs={_zone_of(o): (o, T.LongType()) for o in zones})
    return replace(world, schema=schema, tables=tables)


def zoned(pattern: Pattern, world: World, tables: Iterable[str], **options) -> DataFrame:
    """Matches with `zone`: the one zone of all their zoned rows, or NULL where none has one.

    Which elements have a zone splits the matches; within each part the zones are one shared variable, so that they
    are an equi-join and no loop over zones. Only rows without a zone meet all others.
    """
    tables = set(tables)
    own = [e for e, o in pattern.elements.items() if o in tables]
    name = next(f"zone{'_' * i}" for i in range(len(pattern.variables()) + 1) if f"zone{'_' * i}" not in pattern.variables())
    found = []
    for flags in product((True, False), repeat=len(own)):
        inside = [e for e, f in zip(own, flags) if f]
        outside = [e for e, f in zip(own, flags) if not f]
        p = Pattern(world.schema, pattern.elements, pattern.homs, pattern.attrs | {(e, _zone_of(pattern.elements[e])): Var(name) for e in inside})
        part = match(p, world, extra={e: [_zone_of(pattern.elements[e])] for e in outside}, **options)
        at = [f"{e}.{_zone_of(pattern.elements[e])}" for e in outside]
        if inside:
            # of one element alone the variable joins nothing, and may be unset
            part = part.where(tick(f"?{name}").isNotNull()).withColumnRenamed(f"?{name}", "zone")
        else:
            part = part.withColumn("zone", F.lit(None).cast("long"))
        found.append(part.where(reduce(lambda a, b: a & b, [tick(c).isNull() for c in at], F.lit(True))).drop(*at))
    return reduce(DataFrame.unionByName, found)
