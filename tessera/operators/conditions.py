"""Application conditions of matches: extensions that must or must not exist, and what deletion must not leave."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import Monic, match, quoted
from tessera.pattern import Pattern, Threshold, Var
from tessera.world import World


@dataclass(frozen=True)
class Condition:
    """extension: a pattern that repeats some elements of the matched pattern, by name, and adds others.

    must: an extension has to exist; else none may. monic: whether new elements must differ from others; by default
    they need not.
    """

    extension: Pattern
    must: bool = False
    monic: Monic = False
    thresholds: tuple[Threshold, ...] = ()


def forbid(extension: Pattern, **more) -> Condition:
    return Condition(extension, must=False, **more)


def require(extension: Pattern, **more) -> Condition:
    return Condition(extension, must=True, **more)


def _reduced(n: Pattern, known: Iterable[str]) -> Pattern:
    """The new elements of n, and those matched ones that a key or a variable ties to them.

    A condition without new elements says more of the matched ones, and stays whole.
    """
    new = {e for e in n.elements if e not in set(known)}
    if not new:
        return n
    variables = {v for v, places in n.variables().items() if any(e in new for e, _ in places)}
    homs = {(x, h): to for (x, h), to in n.homs.items() if x in new or to in new}
    attrs = {(e, a): v for (e, a), v in n.attrs.items() if e in new or (isinstance(v, Var) and v.name in variables)}
    kept = new | {x for x, _ in homs} | set(homs.values()) | {e for e, _ in attrs}
    return Pattern(n.schema, {e: o for e, o in n.elements.items() if e in kept}, homs, attrs)


def satisfied(matches: DataFrame, pattern: Pattern, world: World, conditions: Iterable[Condition], anchored: bool = False) -> DataFrame:
    """The matches that meet all conditions, each by one semi- or anti-join on the elements that they share.

    anchored: the matches are few, so that the search for extensions starts from them.
    """
    for c in conditions:
        small = _reduced(c.extension, pattern.elements)
        thresholds = [t for t in c.thresholds if t.element in small.elements]
        keys = [e for e in small.elements if e in pattern.elements]
        found = match(small, world, monic=c.monic, thresholds=thresholds, pins=matches.selectExpr("world_id", *map(quoted, keys)) if anchored and keys else None)
        keys += [f"?{v}" for v in small.variables() if v in pattern.variables()]
        new = [e for e in small.elements if e not in pattern.elements]
        injective = set(world.schema.obs) if c.monic is True else set() if c.monic is False else set(c.monic)
        apart = [(x, e) for e in new for x in c.extension.elements if x in pattern.elements and x not in keys and small.elements[e] == pattern.elements[x] and small.elements[e] in injective]
        needed = [*keys, *dict.fromkeys(e for _, e in apart)]
        right = found.selectExpr("world_id AS _w", *[f"{quoted(k)} AS _{i}" for i, k in enumerate(needed)])
        same = ["world_id = _w", *[f"{quoted(k)} = _{i}" for i, k in enumerate(keys)], *[f"{quoted(x)} <> _{needed.index(e)}" for x, e in apart]]
        matches = matches.join(right, F.expr(" AND ".join(same)), "left_semi" if c.must else "left_anti")
    return matches


def undangling(matches: DataFrame, pattern: Pattern, world: World, deleted: Iterable[str]) -> DataFrame:
    """Matches whose deletion leaves no row that refers to a deleted one, unless that row is deleted as well."""
    deleted = list(deleted)
    for e in deleted:
        for h, (a, b) in world.schema.homs.items():
            if b != pattern.elements[e]:
                continue
            rows = world.table(a).where(f"{quoted(h)} IS NOT NULL").selectExpr("world_id AS _w", "part_id AS _p", f"{quoted(h)} AS _h")
            bad = ["world_id = _w", f"{quoted(e)} = _h", *[f"_p <> {quoted(x)}" for x in deleted if pattern.elements[x] == a]]
            matches = matches.join(rows, F.expr(" AND ".join(bad)), "left_anti")
    return matches


def identified(matches: DataFrame, pattern: Pattern, deleted: Iterable[str]) -> DataFrame:
    """Matches in which a deleted element is no other element's row."""
    for e in deleted:
        for x, o in pattern.elements.items():
            if x != e and o == pattern.elements[e]:
                matches = matches.where(f"{quoted(x)} <> {quoted(e)}")
    return matches


@dataclass(frozen=True)
class Guard:
    """All that a match of a rule has to meet beside its pattern."""

    conditions: tuple[Condition, ...] = ()
    deleted: tuple[str, ...] = field(default=())

    def applied(self, matches: DataFrame, pattern: Pattern, world: World, anchored: bool = False) -> DataFrame:
        kept = satisfied(identified(matches, pattern, self.deleted), pattern, world, self.conditions, anchored)
        return undangling(kept, pattern, world, self.deleted)
