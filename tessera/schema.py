"""Schemas of typed relational worlds: tables (obs), foreign keys (homs) and scalar columns (attrs)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

KEYS = ("world_id", "part_id")


@dataclass(frozen=True)
class Schema:
    """obs: table names. homs: name -> (table, table it refers to). attrs: name -> (table, Spark type)."""

    obs: tuple[str, ...]
    homs: dict[str, tuple[str, str]] = field(default_factory=dict)
    attrs: dict[str, tuple[str, T.DataType]] = field(default_factory=dict)

    def __post_init__(self):
        known = set(self.obs)
        if len(known) != len(self.obs):
            raise ValueError("a table is named twice")
        for name, (a, b) in self.homs.items():
            if a not in known or b not in known:
                raise ValueError(f"hom {name}: no table {a if a not in known else b}")
        for name, (a, _) in self.attrs.items():
            if a not in known:
                raise ValueError(f"attr {name}: no table {a}")
            if name in self.homs or name in KEYS:
                raise ValueError(f"attr {name}: the name is taken")

    def homs_of(self, ob: str) -> dict[str, str]:
        return {h: b for h, (a, b) in self.homs.items() if a == ob}

    def attrs_of(self, ob: str) -> dict[str, T.DataType]:
        return {n: t for n, (a, t) in self.attrs.items() if a == ob}

    def struct(self, ob: str) -> T.StructType:
        """Columns of a table: world_id, part_id, its homs and its attrs."""
        long = T.LongType()
        return T.StructType(
            [T.StructField(k, long, False) for k in KEYS] + [T.StructField(h, long) for h in self.homs_of(ob)] + [T.StructField(n, t) for n, t in self.attrs_of(ob).items()]
        )

    def extend(self, obs=(), homs=None, attrs=None) -> Schema:
        """This schema with more tables, homs and attrs."""
        return Schema((*self.obs, *obs), self.homs | (homs or {}), self.attrs | (attrs or {}))

    def load_order(self) -> list[str]:
        """Tables after those that they refer to; tables on cycles last, as declared."""
        left, done = list(self.obs), []
        while ready := [o for o in left if all(b in done or b == o for b in self.homs_of(o).values())]:
            done += ready
            left = [o for o in left if o not in ready]
        return done + left

    def rename(self, obs: dict[str, str] | None = None, homs: dict[str, str] | None = None, attrs: dict[str, str] | None = None) -> Schema:
        obs, homs, attrs = obs or {}, homs or {}, attrs or {}
        return Schema(
            tuple(obs.get(o, o) for o in self.obs), {homs.get(h, h): (obs.get(a, a), obs.get(b, b)) for h, (a, b) in self.homs.items()}, {attrs.get(n, n): (obs.get(a, a), t) for n, (a, t) in self.attrs.items()}
        )

    def with_types(self, **types: T.DataType) -> Schema:
        return replace(self, attrs={n: (a, types.get(n, t)) for n, (a, t) in self.attrs.items()})


def reflect(tables: dict, homs: dict[str, tuple[str, str]]) -> Schema:
    """The schema of DataFrames by table name, given their foreign keys; all other columns are attrs."""
    attrs = {}
    for ob, df in tables.items():
        own = {h for h, (a, _) in homs.items() if a == ob}
        for f in df.schema:
            if f.name not in KEYS and f.name not in own:
                if f.name in attrs:
                    raise ValueError(f"attr {f.name} is in two tables")
                attrs[f.name] = (ob, f.dataType)
    return Schema(tuple(tables), dict(homs), attrs)
