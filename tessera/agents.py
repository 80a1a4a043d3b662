"""Agents: who picks one of the legal matches of each world (and, in agent loops, of each agent)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.matching import tick, uniform
from tessera.world import World


@dataclass(frozen=True)
class Context:
    """What an agent may look at: the worlds, who it is, the step of the run, the matches' columns, a seed.

    groups are the columns of which each value gets one choice: world_id, and the agent's row in agent loops.
    """

    world: World
    player: str
    step: int
    elements: tuple[str, ...]
    seed: int = 0
    groups: tuple[str, ...] = ("world_id",)
    turns: DataFrame | None = None

    def graph(self):
        """(nodes, edges) of the worlds."""
        from tessera.operators.elements import edges, nodes

        return nodes(self.world), edges(self.world)


def best(candidates: DataFrame, ctx: Context, rank: list[Column]) -> DataFrame:
    """The candidate of each group that comes first by rank and then in canonical order; passes come last.

    A minimum of structs: combined before the shuffle, so a world with many matches is not one task.
    """
    canonical = [tick(e) for e in ctx.elements]
    key = F.struct(*[c.alias(f"r{i}") for i, c in enumerate([*rank, F.col("passes"), *canonical])])
    others = [c for c in candidates.columns if c not in ctx.groups]
    row = F.struct(key.alias("key"), F.struct(*[tick(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"))
    found = candidates.groupBy(*ctx.groups).agg(F.min(row).alias("_best"))
    return found.select(*ctx.groups, *[F.col(f"_best.row.c{i}").alias(c) for i, c in enumerate(others)])


class Agent:
    """choose() gets rows of groups, elements and `passes`, and gives one row a group; none means to pass."""

    def choose(self, candidates: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError


class First(Agent):
    """The first match in canonical order."""

    def choose(self, candidates, ctx):
        return best(candidates, ctx, [])


@dataclass(frozen=True)
class Random(Agent):
    """Each candidate as likely as another; a draw follows from seed, world, step and match."""

    seed: int = 0

    def choose(self, candidates, ctx):
        return best(candidates, ctx, [F.xxhash64(F.lit(self.seed + ctx.seed), F.lit(ctx.step), *[tick(g) for g in ctx.groups], *[tick(e) for e in ctx.elements], F.col("passes"))])


@dataclass(frozen=True)
class ArgMax(Agent):
    """The candidate with the highest score. score: from (candidates, context) to a column, or to a frame with `score`."""

    score: Callable[[DataFrame, Context], Any]

    def scored(self, candidates: DataFrame, ctx: Context) -> DataFrame:
        s = self.score(candidates, ctx)
        return s if isinstance(s, DataFrame) else candidates.withColumn("score", s.cast("double"))

    def choose(self, candidates, ctx):
        return best(self.scored(candidates, ctx), ctx, [-F.col("score")]).drop("score")


@dataclass(frozen=True)
class Softmax(ArgMax):
    """A candidate drawn in proportion to exp(score / temperature), by the Gumbel maximum."""

    temperature: float = 1.0
    seed: int = 0

    def choose(self, candidates, ctx):
        u = uniform(self.seed + ctx.seed, F.lit(ctx.step), *[tick(g) for g in ctx.groups], *[tick(e) for e in ctx.elements], F.col("passes"))
        return best(self.scored(candidates, ctx), ctx, [-(F.col("score") / self.temperature - F.log(-F.log(u)))]).drop("score")


def in_groups(candidates: DataFrame, ctx: Context, pick: Callable[[Any, Any, Any], Any]) -> DataFrame:
    """The rows that pick(table, edges, turns) names by their places in the table; a negative place is none.

    Groups come whole and in canonical order, many to a call: rows edges[i] .. edges[i + 1] of the Arrow table are
    group i, which is at turns[i]. Only a group larger than a batch makes a call hold more than about a batch.
    """
    turns = ctx.turns if ctx.turns is not None else candidates.select("world_id").distinct().withColumn("turn", F.lit(0).cast("long"))
    names = candidates.columns
    # match columns have dots and question marks in their names
    safe = [f"c{i}" for i in range(len(names))]
    own = {n: s for n, s in zip(names, safe)}
    keys = [own[g] for g in ctx.groups]
    given = candidates.join(turns.select("world_id", F.coalesce("turn", F.lit(0)).alias("_turn")), "world_id", "left")
    given = given.select(*[tick(c).alias(s) for c, s in zip(names, safe)], F.coalesce("_turn", F.lit(0)).alias("_turn"))
    dealt = given.repartition(*keys).sortWithinPartitions(*keys, own["passes"], *[own[e] for e in ctx.elements])
    schema = T.StructType([T.StructField(c, k.dataType) for c, k in zip(safe, candidates.schema)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def changes(t):
            differ = np.zeros(max(0, t.num_rows - 1), bool)
            for k in keys:
                v = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
                differ |= v[1:] != v[:-1]
            return np.flatnonzero(differ) + 1

        def chosen(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            edges = np.concatenate([[0], changes(t), [t.num_rows]])
            places = np.asarray(pick(t.rename_columns([*names, "_turn"]), edges, t.column("_turn").to_numpy()[edges[:-1]]), np.int64)
            yield from t.select(safe).take(pa.array(places[places >= 0])).to_batches()

        held, last = [], None  # the last group may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            if held and tuple(b.column(k)[0].as_py() for k in keys) != last:
                yield from chosen(held)
                held = []
            cuts = changes(b)
            if len(cuts):
                yield from chosen([*held, b.slice(0, int(cuts[-1]))])
                held = []
                b = b.slice(int(cuts[-1]))
            held.append(b)
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
        if held:
            yield from chosen(held)

    return dealt.mapInArrow(run, schema).toDF(*names)


@dataclass(frozen=True)
class Function(Agent):
    """A Python function of (world id, turn, list of candidate dicts), giving an index or None.

    It runs once for each group, on the group's candidates; for many candidates use ArgMax or Batched.
    """

    f: Callable[[int, int, list[dict]], int | None]

    def choose(self, candidates, ctx):
        f = self.f

        def pick(table, edges, turns):
            places = []
            for a, b, turn in zip(edges, edges[1:], turns):
                rows = table.slice(a, b - a).drop_columns("_turn").to_pylist()
                i = f(rows[0]["world_id"], int(turn), rows)
                places.append(-1 if i is None else a + range(len(rows))[i])
            return places

        return in_groups(candidates, ctx, pick)


@dataclass(frozen=True)
class Batched(Agent):
    """A Python function of (matrix of candidates by elements, edges, turns) giving a 1-based index for each group,
    which is clamped; rows edges[i] .. edges[i + 1] of the matrix are group i. One call serves many worlds and agents.
    A pass is a row of zeros.
    """

    f: Callable[[Any, Any, Any], Any]

    def choose(self, candidates, ctx):
        f, elements = self.f, list(ctx.elements)

        def pick(table, edges, turns):
            import numpy as np

            cols = [table.column(e).fill_null(0).to_numpy() for e in elements]
            matrix = np.stack(cols, axis=1) if cols else np.zeros((table.num_rows, 0), np.int64)
            return edges[:-1] + np.clip(np.asarray(f(matrix, edges, turns), np.int64), 1, np.diff(edges)) - 1

        return in_groups(candidates, ctx, pick)


@dataclass(frozen=True)
class Vectorised(Agent):
    """A Python function of (matrix of candidates by elements, turn) giving a 1-based index, which is clamped.

    One call serves a group, on a slice of the matrix that the groups of a batch share.
    """

    f: Callable[[Any, int], int]

    def choose(self, candidates, ctx):
        f = self.f

        def each(matrix, edges, turns):
            return [int(f(matrix[a:b], int(t))) for a, b, t in zip(edges, edges[1:], turns)]

        return Batched(each).choose(candidates, ctx)


@dataclass
class Scripted(Agent):
    """Chooses the match at the place that a table (world_id, step, place) gives, in canonical order; else passes."""

    script: DataFrame = field(repr=False)

    def choose(self, candidates, ctx):
        from pyspark.sql.window import Window

        w = Window.partitionBy(*ctx.groups).orderBy("passes", *[tick(e) for e in ctx.elements])
        here = self.script.where(F.col("step") == ctx.step).select("world_id", F.col("place").cast(T.IntegerType()).alias("_place"))
        return candidates.withColumn("_at", F.row_number().over(w)).join(here, "world_id").where("_at = _place").drop("_at", "_place")
