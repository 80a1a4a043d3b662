"""Rules: what a match deletes, adds and changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from tessera.operators.conditions import Condition, Guard
from tessera.operators.matching import Monic
from tessera.pattern import Pattern, Threshold, Var

#: A value of the right side from the matched values: called with a function from "element.attr" or a variable's
#: name to its column.
Expression = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Delta:
    """attr of a kept element changes by so much, and not below or above the bounds."""

    element: str
    attr: str
    by: float
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Rule:
    """left: what has to be there. keep: element of left -> element of right. right: what there is afterwards.

    Elements of left that keep doesn't name are deleted; elements of right that it doesn't lead to are added; elements
    that keep leads to one element become one row, the first named, and what refers to them refers to it. A kept
    element changes the homs and attrs that right gives differently. expressions: (element of right, attr) -> value.
    An attr of right that is a Var of left has that value; a Var of its own stays as it was, or NULL in a new row.
    """

    name: str
    left: Pattern
    keep: Mapping[str, str]
    right: Pattern
    monic: Monic = False
    conditions: tuple[Condition, ...] = ()
    expressions: Mapping[tuple[str, str], Expression] = field(default_factory=dict)
    thresholds: tuple[Threshold, ...] = ()
    deltas: tuple[Delta, ...] = ()

    def __post_init__(self):
        for a, b in self.keep.items():
            if self.left.elements[a] != self.right.elements[b]:
                raise ValueError(f"{self.name}: {a} and {b} are of different tables")
        for d in self.deltas:
            if d.element not in self.keep:
                raise ValueError(f"{self.name}: {d.element} isn't kept")

    @property
    def deleted(self) -> tuple[str, ...]:
        return tuple(e for e in self.left.elements if e not in self.keep)

    @property
    def merged(self) -> tuple[tuple[str, str], ...]:
        """(element, the element whose row it becomes)."""
        first: dict[str, str] = {}
        for a, b in self.keep.items():
            first.setdefault(b, a)
        return tuple((a, first[b]) for a, b in self.keep.items() if first[b] != a)

    @property
    def added(self) -> tuple[str, ...]:
        there = set(self.keep.values())
        return tuple(e for e in self.right.elements if e not in there)

    @property
    def plucked(self) -> str | None:
        """The one element of left, where all that the rule does is to delete its row, which no foreign key can lead
        to: then a firing takes its own match from the legal ones, brings no new one, and leaves all others."""
        if len(self.left.elements) != 1 or self.keep or self.right.elements or self.conditions:
            return None
        ((e, o),) = self.left.elements.items()
        return None if any(b == o for _, b in self.left.schema.homs.values()) else e

    @property
    def guard(self) -> Guard:
        return Guard(self.conditions, self.deleted)

    def needed(self) -> dict[str, list[str]]:
        """Attrs of left elements whose values the right side is made of."""
        found: dict[str, list[str]] = {}

        def add(e, n):
            if n not in found.setdefault(e, []):
                found[e].append(n)

        if self.expressions:
            for e, o in self.left.elements.items():
                for n in self.left.schema.attrs_of(o):
                    add(e, n)
        for d in self.deltas:
            add(d.element, d.attr)
        return {e: ns for e, ns in found.items() if ns}

    def changed_attrs(self) -> dict[str, dict[str, Any]]:
        """By kept element of left: attr -> constant, Var of left, or Expression."""
        known, gone = set(self.left.variables()), {a for a, _ in self.merged}
        found: dict[str, dict[str, Any]] = {}
        for a, b in ((a, b) for a, b in self.keep.items() if a not in gone):
            for n in self.left.schema.attrs_of(self.left.elements[a]):
                if (b, n) in self.expressions:
                    found.setdefault(a, {})[n] = self.expressions[b, n]
                elif (b, n) in self.right.attrs:
                    v = self.right.attrs[b, n]
                    if self.left.attrs.get((a, n)) != v and not (isinstance(v, Var) and v.name not in known):
                        found.setdefault(a, {})[n] = v
        return found

    def changed_homs(self) -> dict[str, dict[str, str]]:
        """By kept element of left: hom -> element of right, where that differs from what left says."""
        found: dict[str, dict[str, str]] = {}
        gone = {a for a, _ in self.merged}
        for a, b in ((a, b) for a, b in self.keep.items() if a not in gone):
            for h in self.left.schema.homs_of(self.left.elements[a]):
                to = self.right.homs.get((b, h))
                if to is not None and self.keep.get(self.left.homs.get((a, h), "")) != to:
                    found.setdefault(a, {})[h] = to
        return found

    def renamed(self, schema, obs: dict, homs: dict, attrs: dict) -> Rule:
        """The rule over a schema with renamed tables, homs and attrs, conditions included."""

        def moved(p: Pattern) -> Pattern:
            return p.renamed(schema, obs, homs, attrs)

        monic = self.monic if isinstance(self.monic, bool) else tuple(obs.get(o, o) for o in self.monic)
        conditions = tuple(replace(c, extension=moved(c.extension), monic=c.monic if isinstance(c.monic, bool) else tuple(obs.get(o, o) for o in c.monic), thresholds=tuple(replace(t, attr=attrs.get(t.attr, t.attr)) for t in c.thresholds)) for c in self.conditions)
        return replace(
            self, left=moved(self.left), right=moved(self.right), monic=monic, conditions=conditions, expressions={(e, attrs.get(n, n)): f for (e, n), f in self.expressions.items()},
            thresholds=tuple(replace(t, attr=attrs.get(t.attr, t.attr)) for t in self.thresholds), deltas=tuple(replace(d, attr=attrs.get(d.attr, d.attr)) for d in self.deltas),
        )


def identity(name: str, pattern: Pattern, **more) -> Rule:
    """A rule that only looks."""
    return Rule(name, pattern, {e: e for e in pattern.elements}, pattern, **more)


def adding(name: str, left: Pattern, right: Pattern, **more) -> Rule:
    """A rule that keeps all of left, under the same names in right."""
    return Rule(name, left, {e: e for e in left.elements}, right, **more)


def deleting(name: str, left: Pattern, kept: Pattern, **more) -> Rule:
    """A rule that leaves only `kept` of left."""
    return Rule(name, left, {e: e for e in kept.elements}, kept, **more)
