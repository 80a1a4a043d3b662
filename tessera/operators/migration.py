"""Migration of worlds, rules and schedules along functors between schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.pattern import Pattern
from tessera.plans.schedule import mapped
from tessera.rule import Rule
from tessera.schema import Schema
from tessera.world import World


@dataclass(frozen=True)
class Renaming:
    """New names of tables, homs and attrs; what isn't named keeps its name. It moves patterns, rules and worlds."""

    source: Schema
    obs: Mapping[str, str] = field(default_factory=dict)
    homs: Mapping[str, str] = field(default_factory=dict)
    attrs: Mapping[str, str] = field(default_factory=dict)

    @property
    def target(self) -> Schema:
        return self.source.rename(dict(self.obs), dict(self.homs), dict(self.attrs))

    def world(self, w: World) -> World:
        names = {**self.homs, **self.attrs}
        tables = {self.obs.get(o, o): t.withColumnsRenamed({a: b for a, b in names.items() if a in t.columns}) for o, t in w.tables.items()}
        counters = None if w.counters is None else w.counters.replace({a: b for a, b in self.obs.items()}, subset=["ob"]) if self.obs else w.counters
        return replace(w, schema=self.target, tables={o: tables[o] for o in self.target.obs}, counters=counters)

    def pattern(self, p: Pattern) -> Pattern:
        return p.renamed(self.target, dict(self.obs), dict(self.homs), dict(self.attrs))

    def rule(self, r: Rule) -> Rule:
        return r.renamed(self.target, dict(self.obs), dict(self.homs), dict(self.attrs))

    def schedule(self, x: Any, players: Callable[[str], str] | Mapping[str, str] = lambda p: p, names: Callable[[str], str] = lambda n: n) -> Any:
        """The schedule with moved rules; all options of its boxes stay."""
        player = players if callable(players) else lambda p: players.get(p, p)
        return mapped(x, self.rule, self.pattern, player, names, lambda o: self.obs.get(o, o))


def included(w: World, target: Schema) -> World:
    """A world as one of a larger schema: new tables are empty, new attrs and homs NULL."""
    tables = {}
    for o in target.obs:
        struct = target.struct(o)
        if o not in w.tables:
            tables[o] = w.spark.createDataFrame([], struct)
            continue
        t = w.tables[o]
        tables[o] = t.select(*[F.col(f.name) if f.name in t.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct])
    return replace(w, schema=target, tables=tables, checked=w.checked and set(target.homs) == set(w.schema.homs))


def pulled_back(w: World, target: Schema, obs: Mapping[str, str], homs: Mapping[str, list[str]], attrs: Mapping[str, tuple[list[str], str]]) -> World:
    """A world of `target` from a functor target -> w.schema.

    obs: table of target -> table of w. homs: hom of target -> path of homs of w (empty: the row itself). attrs: attr
    of target -> (path of homs, attr at its end). Paths are followed by joins.
    """
    tables = {}
    for o in target.obs:
        start = obs[o]
        base = w.tables[start].select("world_id", "part_id")

        def along(path: list[str], want: str | None, name: str, df: DataFrame, at=start) -> DataFrame:
            here, ob = df.withColumn(name, F.col("part_id")), at
            for h in path:
                step = w.tables[ob].select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"), F.col(h).alias("_to"))
                here = here.join(step, (F.col("world_id") == F.col("_w")) & (F.col(name) == F.col("_p")), "left").withColumn(name, F.col("_to")).drop("_w", "_p", "_to")
                ob = w.schema.homs[h][1]
            if want is not None:
                end = w.tables[ob].select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"), F.col(want).alias("_v"))
                here = here.join(end, (F.col("world_id") == F.col("_w")) & (F.col(name) == F.col("_p")), "left").withColumn(name, F.col("_v")).drop("_w", "_p", "_v")
            return here

        for h in target.homs_of(o):
            base = along(list(homs[h]), None, h, base)
        for n in target.attrs_of(o):
            base = along(list(attrs[n][0]), attrs[n][1], n, base)
        tables[o] = base.select(*target.struct(o).names)
    return World(target, tables, w.ids, one_world=w.one_world, checked=w.checked)
