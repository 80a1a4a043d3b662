"""Matching: every occurrence of a pattern in a batch of worlds, as a join plan.

An element is a scan of its table, a foreign key an equi-join, a constant or a threshold a filter that reaches the
scan, a shared variable an equality, an injectivity demand a residual inequality. Elements are joined along
connections, the most selective first; an element that only a foreign key leads to costs no join where the world's
keys are checked. Unconnected parts meet at the end, in a product that only they need.

Matches have world_id, a BIGINT for each element under its name, and `?name` for each variable. They form a set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.pattern import Pattern, Threshold, Var
from tessera.world import World

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {"<=": lambda c, v: c <= v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, ">": lambda c, v: c > v}
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)

Monic = bool | Iterable[str]


def _hom(e: str, h: str) -> str:
    return f"{e}.{h}"


def quoted(name: str) -> str:
    """A column's name as SQL text. Plans are written as text where they can be: each call of a column function goes
    to the JVM and back several times, and a pattern has hundreds of them."""
    return f"`{name}`"


def tick(name: str) -> Column:
    return F.col(quoted(name))


def columns(pattern: Pattern) -> list[str]:
    """The match columns in canonical order, without world_id."""
    return [*pattern.elements, *[f"?{v}" for v in pattern.variables()]]


def order(pattern: Pattern) -> list[Column]:
    """The canonical order of matches."""
    return [tick(e) for e in pattern.elements]


class Plan:
    """Decides scans, joins and their order for one pattern."""

    def __init__(
        self, pattern: Pattern, world: World, monic: Monic, pins: dict[str, Any], thresholds: Iterable[Threshold], keep_joins: bool = False, extra: dict[str, list[str]] | None = None, held: DataFrame | None = None, same: Iterable[tuple[str, str]] = ()
    ):
        self.pattern, self.world, self.pins = pattern, world, pins
        self.thresholds = list(thresholds)
        # rows that restrict the elements they name jointly: the search starts there
        self.held, self.anchors = held, [] if held is None else [e for e in pattern.elements if e in held.columns]
        self.same = list(same)
        if unknown := [e for pair in self.same for e in pair if e not in pattern.elements]:
            raise ValueError(f"no element {unknown[0]}")
        injective = set(world.schema.obs) if monic is True else set() if monic is False else set(monic)
        if unknown := injective - set(world.schema.obs):
            raise ValueError(f"no table {sorted(unknown)}")
        names = list(pattern.elements)
        self.apart = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if pattern.elements[a] == pattern.elements[b] and pattern.elements[a] in injective]
        for t in self.thresholds:
            kind = world.schema.attrs[t.attr][1]
            if not isinstance(kind, _ORDERED):
                raise TypeError(f"{t.attr} of type {kind.simpleString()} has no order")
        self.extra = extra or {}
        self.followed = set() if keep_joins or not world.checked else self._only_followed()

    def _only_followed(self) -> set[str]:
        """Elements that nothing but one foreign key of another element speaks of."""
        p = self.pattern
        busy = {e for e, _ in p.homs} | {e for e, _ in p.attrs} | {t.element for t in self.thresholds} | set(self.extra) | {e for pair in self.same for e in pair}
        return {e for e in p.elements if e not in busy and any(to == e for to in p.homs.values())}

    def scan(self, e: str) -> DataFrame:
        """Rows that an element may stand for, with what its constraints need."""
        p, ob = self.pattern, self.pattern.elements[e]
        t = self.world.table(ob)
        for (x, n), v in p.attrs.items():
            if x == e and not isinstance(v, Var):
                t = t.where(F.col(n) == F.lit(v))
        for c in self.thresholds:
            if c.element == e:
                t = t.where(_COMPARE[c.op](F.col(c.attr), F.lit(c.value)))
        if e in self.pins:
            t = t.where(F.col("part_id") == F.lit(self.pins[e]))
        homs = [h for x, h in p.homs if x == e]
        attrs = {n for (x, n), v in p.attrs.items() if x == e and isinstance(v, Var)}
        found = t.selectExpr("world_id", f"part_id AS {quoted(e)}", *[f"{quoted(n)} AS {quoted(_hom(e, n))}" for n in [*homs, *sorted(attrs | set(self.extra.get(e, ())))]])
        met = []
        for h in homs:
            to = p.homs[e, h]
            met.append(f"{quoted(_hom(e, h))} = {quoted(e)}" if to == e else f"{quoted(_hom(e, h))} IS NOT NULL")
            if to in self.pins and to != e:
                found = found.where(tick(_hom(e, h)) == F.lit(self.pins[to]))
        for places in p.variables().values():
            # two names for one key are one value
            own = [n for x, n in places if x == e]
            met += [f"{quoted(_hom(e, a))} = {quoted(_hom(e, b))}" for a, b in zip(own, own[1:])]
        return found.where(" AND ".join(met)) if met else found

    def weight(self, e: str) -> tuple:
        """Lower is more selective."""
        p = self.pattern
        constant = sum(x == e and not isinstance(v, Var) for (x, _), v in p.attrs.items())
        return (e not in self.pins, -constant, -sum(t.element == e for t in self.thresholds), -sum(x == e for x, _ in p.homs))

    def components(self) -> list[list[str]]:
        """The pattern's connected parts; rows that hold elements jointly, and elements that are one, connect them."""
        parts = self.pattern.components()
        for ties in [self.anchors, *self.same]:
            tied = [c for c in parts if set(c) & set(ties)]
            if len(tied) > 1:
                parts = [[e for e in self.pattern.elements if any(e in c for c in tied)]] + [c for c in parts if c not in tied]
        return parts

    def start(self, names: list[str]) -> tuple[DataFrame, list[str]]:
        """What the search of a part starts from: the rows that hold its elements, or its most selective scan."""
        todo = [e for e in names if e not in self.followed]
        own = [e for e in self.anchors if e in names]
        if not own:
            first = min(todo, key=self.weight)
            return self._follow(self.scan(first), done := [first]), done
        df = self.held.selectExpr("world_id", *[f"CAST({quoted(e)} AS BIGINT) AS {quoted(e)}" for e in own]).distinct()
        for a, b in self.apart:
            if a in own and b in own:
                df = df.where(f"{quoted(a)} <> {quoted(b)}")
        done = list(own)
        for e in own:
            if e not in self.followed:
                done.append(done.pop(done.index(e)))  # _follow() looks at the last
                df = self._follow(df.join(self.scan(e), ["world_id", e]), done)
        return df, done

    def component(self, names: list[str]) -> DataFrame:
        df, done = self.start(names)
        todo = [e for e in names if e not in self.followed and e not in done]
        while todo:
            near = [e for e in todo if self._between(e, done)]
            e = min(near, key=self.weight)
            right = self.scan(e).withColumnRenamed("world_id", "_w")
            conditions = ([] if self.world.one_world else ["world_id = _w"]) + self._between(e, done)
            conditions += [f"{quoted(a)} <> {quoted(b)}" for a, b in self.apart if e in (a, b) and (a in done or b in done)]
            df = df.join(right, F.expr(" AND ".join(conditions))).drop("_w")
            done.append(e)
            todo.remove(e)
            df = self._follow(df, done)
        return df

    def _follow(self, df: DataFrame, done: list[str]) -> DataFrame:
        """Elements that a foreign key of the last element leads to, without a join; they join `done`."""
        last, new, met = done[-1], [], []
        for (x, h), to in self.pattern.homs.items():
            if x == last and to in self.followed:
                if to in done:
                    met.append(f"{quoted(_hom(x, h))} = {quoted(to)}")
                else:
                    new.append(f"{quoted(_hom(x, h))} AS {quoted(to)}")
                    met += [f"{quoted(a)} <> {quoted(b)}" for a, b in self.apart if to in (a, b) and (b if to == a else a) in done]
                    if to in self.pins:
                        df = df.where(tick(_hom(x, h)) == F.lit(self.pins[to]))
                    done.insert(0, to)
        df = df.selectExpr("*", *new) if new else df
        return df.where(" AND ".join(met)) if met else df

    def _between(self, e: str, done: list[str]) -> list[str]:
        """What ties e to joined elements: foreign keys either way, shared variables, and being one row."""
        found = []
        for (x, h), to in self.pattern.homs.items():
            if x == to:
                continue
            if (x == e and to in done) or (to == e and x in done):
                found.append(f"{quoted(_hom(x, h))} = {quoted(to)}")
            elif x == e and to in self.followed:
                # another element's key leads to the same row
                found += [f"{quoted(_hom(x, h))} = {quoted(_hom(y, g))}" for (y, g), other in self.pattern.homs.items() if other == to and y in done][:1]
        for places in self.pattern.variables().values():
            before = [(x, n) for x, n in places if x in done]
            own = [(x, n) for x, n in places if x == e]
            if before and own:
                found.append(f"{quoted(_hom(*own[0]))} = {quoted(_hom(*before[0]))}")
        return found + [f"{quoted(a)} = {quoted(b)}" for a, b in self.same if (a == e and b in done) or (b == e and a in done)]

    def build(self) -> DataFrame:
        p = self.pattern
        if not p.elements:
            return self.world.ids.select("world_id")
        components = self.components()
        parts = [self.component(c) for c in components]
        df = parts[0]
        for other in parts[1:]:
            other = other.withColumnRenamed("world_id", "_w")
            df = (df.crossJoin(other) if self.world.one_world else df.join(other, F.col("world_id") == F.col("_w"))).drop("_w")
        names = set()
        for c in components:
            for a, b in self.apart:
                if (a in c) != (b in c) and (a, b) not in names:
                    names.add((a, b))
                    df = df.where(f"{quoted(a)} <> {quoted(b)}")
        bound = [f"{quoted(_hom(*places[0]))} AS {quoted(f'?{v}')}" for v, places in p.variables().items()]
        more = [quoted(_hom(e, n)) for e, ns in self.extra.items() for n in ns]
        return df.selectExpr("world_id", *map(quoted, p.elements), *bound, *more)


def match(
    pattern: Pattern,
    world: World,
    monic: Monic = False,
    pins: dict[str, Any] | DataFrame | None = None,
    thresholds: Iterable[Threshold] = (),
    take: int | None = None,
    seed: int = 0,
    limit: int | None = None,
    view: Callable[[World], World] | None = None,
    keep_joins: bool = False,
    extra: dict[str, list[str]] | None = None,
    same: Iterable[tuple[str, str]] = (),
) -> DataFrame:
    """All matches of the pattern.

    monic: True, or the tables within which elements must differ. pins: part ids by element, or a DataFrame with
    world_id and columns named like elements, whose rows restrict the matches jointly; the search starts from them.
    same: pairs of elements that must be one row. take: so many matches of each
    world by a seeded hash, all where there are no more. limit: the first so many of each world in canonical order.
    view: what of the world may be seen. keep_joins: join even where a checked foreign key suffices. extra: attrs of
    elements to carry as `element.attr`.
    """
    if view is not None:
        world = view(world)
    fixed, held = (pins, None) if isinstance(pins, dict) else ({}, pins)
    df = Plan(pattern, world, monic, fixed, thresholds, keep_joins, extra, held, same).build()
    if held is not None and not any(e in held.columns for e in pattern.elements):
        df = df.join(held.select("world_id").distinct(), "world_id", "left_semi")
    if take is not None:
        df = sample(df, pattern, take, seed)
    if limit is not None:
        df = first(df, limit, order(pattern), world.one_world)
    return df


#: Up to so many first rows of a group Spark finds before it shuffles; a larger number goes through lots.
FEW = 1000
LOTS = 1024


def first(df: DataFrame, n: int, by: list[Column], one_world: bool = False) -> DataFrame:
    """The first n rows of each world: a top-n for one world; for a few rows a window that Spark limits before it
    shuffles; else by lots of the first column's range."""
    if one_world:
        return df.orderBy(*by).limit(n) if by else df.limit(n)
    if n <= FEW or not by:
        w = Window.partitionBy("world_id").orderBy(*(by or [F.lit(0)]))
        return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    ends = df.groupBy("world_id").agg(F.min(by[0]).alias("_low"), F.max(by[0]).alias("_high"))
    width = (F.col("_high").cast("double") - F.col("_low") + 1) / LOTS
    return _by_lots(df.join(ends, "world_id"), n, F.floor((by[0].cast("double") - F.col("_low")) / width).cast("int"), by).drop("_low", "_high")


def _by_lots(df: DataFrame, n: int, lot: Column, by: list[Column]) -> DataFrame:
    """The first n rows of each world, where lots follow the order: lots are counted, and rows are ordered within
    their lot, so that a world's rows are many tasks."""
    placed = df.withColumn("_lot", lot)
    before = Window.partitionBy("world_id").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    # at most LOTS rows a world
    lots = placed.groupBy("world_id", "_lot").agg(F.count(F.lit(1)).alias("_held")).withColumn("_base", F.coalesce(F.sum("_held").over(before), F.lit(0))).where(F.col("_base") < n)
    kept = placed.join(lots.select("world_id", "_lot", "_base"), ["world_id", "_lot"])
    rank = F.row_number().over(Window.partitionBy("world_id", "_lot").orderBy(*by))
    return kept.withColumn("_rank", rank).where(F.col("_rank") + F.col("_base") <= n).drop("_rank", "_lot", "_base").select(*df.columns)


def uniform(seed: int | Column, *keys: Column) -> Column:
    """A number in (0, 1) that follows from the seed and the keys alone."""
    return (F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *keys).cast("double") + F.lit(2.0**63) + 0.5) / F.lit(2.0**64)


def sample(df: DataFrame, pattern: Pattern, n: int, seed: int) -> DataFrame:
    """n matches of each world, each set of n as likely as another over seeds."""
    ids = order(pattern)
    draw = F.xxhash64(F.lit(seed), F.col("world_id"), *ids)
    if n <= FEW:
        return first(df, n, [draw, *ids])
    return _by_lots(df.withColumn("_draw", draw), n, F.shiftright("_draw", 54).cast("int"), [F.col("_draw"), *ids]).drop("_draw")


def count(matches: DataFrame) -> DataFrame:
    """world_id, n for worlds with a match."""
    return matches.groupBy("world_id").agg(F.count(F.lit(1)).alias("n"))


def search_space(pattern: Pattern, world: World) -> DataFrame:
    """world_id and the logarithm of the product of the elements' table sizes."""
    sizes = world.counts()
    n = world.spark.createDataFrame([(o, pattern_count) for o, pattern_count in ((o, len(pattern.of(o))) for o in world.schema.obs) if pattern_count] or [("", 0)], "ob string, uses int")
    return sizes.join(F.broadcast(n), "ob").groupBy("world_id").agg(F.sum(F.col("uses") * F.log(F.col("n").cast("double"))).alias("log_space"))
