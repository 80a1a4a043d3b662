"""Patterns: small instances of a schema whose elements are to be found in a world."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

from tessera.schema import Schema


@dataclass(frozen=True)
class Var:
    """A free attribute value; the same name twice asks for equal values."""

    name: str


@dataclass(frozen=True)
class Threshold:
    """attr of element must be <=, <, >= or > value."""

    element: str
    attr: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in ("<=", "<", ">=", ">"):
            raise ValueError(f"no comparison {self.op}")


@dataclass(frozen=True)
class Pattern:
    """elements: name -> table. homs: (element, hom) -> element. attrs: (element, attr) -> constant or Var.

    Element names are column names of the matches. The empty pattern has one empty match in every world.
    """

    schema: Schema
    elements: dict[str, str] = field(default_factory=dict)
    homs: dict[tuple[str, str], str] = field(default_factory=dict)
    attrs: dict[tuple[str, str], Any] = field(default_factory=dict)

    def __post_init__(self):
        for (e, h), to in self.homs.items():
            a, b = self.schema.homs[h]
            if self.elements[e] != a or self.elements[to] != b:
                raise ValueError(f"{h} goes from {a} to {b}, not from {self.elements[e]} to {self.elements[to]}")
        for e, n in self.attrs:
            if self.schema.attrs[n][0] != self.elements[e]:
                raise ValueError(f"{n} is no attr of {self.elements[e]}")

    def of(self, ob: str) -> list[str]:
        return [e for e, o in self.elements.items() if o == ob]

    def variables(self) -> dict[str, list[tuple[str, str]]]:
        """Where each variable stands."""
        found = defaultdict(list)
        for at, v in self.attrs.items():
            if isinstance(v, Var):
                found[v.name].append(at)
        return dict(found)

    def components(self) -> list[list[str]]:
        """Elements that homs or shared variables connect, each list in the order of declaration."""
        near = defaultdict(set)
        for (a, _), b in self.homs.items():
            near[a].add(b)
            near[b].add(a)
        for places in self.variables().values():
            for a, _ in places:
                near[a] |= {b for b, _ in places}
        left, found = list(self.elements), []
        while left:
            reached, todo = set(), [left[0]]
            while todo:
                e = todo.pop()
                if e not in reached:
                    reached.add(e)
                    todo += near[e] - reached
            found.append([e for e in left if e in reached])
            left = [e for e in left if e not in reached]
        return found

    def coproduct(self, other: Pattern, left: str = "", right: str = "r_") -> Pattern:
        """Both patterns side by side; names get a prefix, and variables stay apart."""

        def named(p: Pattern, x: str):
            attrs = {(x + e, n): Var(x + v.name) if isinstance(v, Var) else v for (e, n), v in p.attrs.items()}
            return {x + e: o for e, o in p.elements.items()}, {(x + e, h): x + t for (e, h), t in p.homs.items()}, attrs

        a, b = named(self, left), named(other, right)
        if a[0].keys() & b[0].keys():
            raise ValueError("the prefixes leave equal names")
        return Pattern(self.schema, a[0] | b[0], a[1] | b[1], a[2] | b[2])

    def renamed(self, schema: Schema, obs: dict, homs: dict, attrs: dict) -> Pattern:
        """The pattern over a schema with renamed tables, homs and attrs."""
        return Pattern(
            schema, {e: obs.get(o, o) for e, o in self.elements.items()}, {(e, homs.get(h, h)): t for (e, h), t in self.homs.items()}, {(e, attrs.get(n, n)): v for (e, n), v in self.attrs.items()}
        )


def representable(schema: Schema, ob: str) -> Pattern:
    """One row of a table and the rows that it needs: the closure under foreign keys, with free attrs.

    Tables on a cycle of foreign keys have no finite closure.
    """
    elements: dict[str, str] = {}
    homs: dict[tuple[str, str], str] = {}
    count: dict[str, int] = defaultdict(int)

    def add(o: str, above: tuple[str, ...]) -> str:
        if o in above:
            raise ValueError(f"{o} refers to itself: its closure has no end")
        count[o] += 1
        e = f"{o}_{count[o]}"
        elements[e] = o
        for h, to in schema.homs_of(o).items():
            homs[e, h] = add(to, (*above, o))
        return e

    add(ob, ())
    attrs = {(e, n): Var(f"{e}.{n}") for e, o in elements.items() for n in schema.attrs_of(o)}
    return Pattern(schema, elements, homs, attrs)


def path(schema: Schema, vertices: int, v: str = "V", e: str = "E", src: str = "src", tgt: str = "tgt") -> Pattern:
    """A directed path of so many vertices."""
    elements = {f"{v}_{i}": v for i in range(1, vertices + 1)} | {f"{e}_{i}": e for i in range(1, vertices)}
    homs = {}
    for i in range(1, vertices):
        homs[f"{e}_{i}", src], homs[f"{e}_{i}", tgt] = f"{v}_{i}", f"{v}_{i + 1}"
    return Pattern(schema, elements, homs)
