"""Match tables that follow changes: survivors of the old matches and new ones around what changed."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import Plan, columns, match, tick
from tessera.rule import Rule
from tessera.world import World


def forward(matches: DataFrame, elements: dict[str, str], gone: dict[str, DataFrame]) -> DataFrame:
    """Matches none of whose rows is in gone: (world_id, part_id) by table."""
    for e, o in elements.items():
        if o in gone:
            rows = gone[o].select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"))
            matches = matches.join(rows, (F.col("world_id") == F.col("_w")) & (tick(e) == F.col("_p")), "left_anti")
    return matches


def touching(rule: Rule, world: World, fresh: dict[str, DataFrame]) -> DataFrame:
    """Matches of the rule's left side with a row in fresh: for each element that may be one, the pattern with that
    element held to the fresh rows, and all of them united."""
    found = []
    for e, o in rule.left.elements.items():
        if o in fresh:
            rows = world.table(o).join(fresh[o].select("world_id", "part_id"), ["world_id", "part_id"], "left_semi")
            found.append(_with_element(rule, world, e, rows))
    if not found:
        return match(rule.left, world, rule.monic, thresholds=rule.thresholds).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def _with_element(rule: Rule, world: World, element: str, rows: DataFrame) -> DataFrame:
    """Matches whose element is one of rows; the search starts there."""

    class Held(Plan):
        def scan(self, e):
            return self._held(e) if e == element else super().scan(e)

        def _held(self, e):
            keep = self.world
            self.world = keep.with_tables(**{self.pattern.elements[e]: rows})
            try:
                return super().scan(e)
            finally:
                self.world = keep

        def weight(self, e):
            return (e != element, *super().weight(e))

        def _only_followed(self):
            return super()._only_followed() - {element}

    return Held(rule.left, world, rule.monic, {}, rule.thresholds).build()


@dataclass(frozen=True)
class MatchCache:
    """Matches of a rule's left side, before its conditions; conditions are asked of the world as it is."""

    rule: Rule
    matches: DataFrame

    @classmethod
    def fresh(cls, rule: Rule, world: World) -> MatchCache:
        return cls(rule, match(rule.left, world, rule.monic, thresholds=rule.thresholds).checkpoint())

    def updated(self, before: World, change) -> MatchCache:
        """The matches after a Change.

        Rows that were changed in place count as gone and as fresh, since their keys and values may match otherwise.
        """
        gone = {o: df for o, df in change.deleted.items()}
        fresh = {o: df.select("world_id", "part_id") for o, df in change.inserted.items()}
        for o, df in change.updated.items():
            gone[o] = gone[o].unionByName(df) if o in gone else df
            fresh[o] = fresh[o].unionByName(df) if o in fresh else df
        kept = forward(self.matches, self.rule.left.elements, gone)
        new = touching(self.rule, change.world, fresh)
        return replace(self, matches=kept.unionByName(new.select(*kept.columns)).distinct())

    def legal(self, world: World) -> DataFrame:
        return self.rule.guard.applied(self.matches, self.rule.left, world)

    def cut(self) -> MatchCache:
        return replace(self, matches=self.matches.checkpoint())


def same(a: DataFrame, b: DataFrame, rule: Rule) -> bool:
    """Do two match tables hold the same matches?"""
    cols = ["world_id", *[f"`{c}`" for c in columns(rule.left)]]
    return a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a.select(*cols)).isEmpty()
