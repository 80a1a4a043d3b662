"""Games: players, a start, a schedule of moves, and what ends them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.migration import Renaming, included
from tessera.plans import runner
from tessera.plans.schedule import Schedule
from tessera.schema import Schema
from tessera.world import World


@dataclass(frozen=True)
class Game:
    """players: names. initial: makes the world, from a session. terminal: World -> (world_id, done, winner).
    win_conditions: exit wire -> winner, None for a draw; where given, terminal isn't asked."""

    players: tuple[str, ...]
    initial: Callable[[SparkSession], World] | None = None
    terminal: Callable[[World], DataFrame] | None = None
    schema: Schema | None = None
    win_conditions: Mapping[str, str | None] | None = None

    def __post_init__(self):
        if not self.players:
            raise ValueError("a game needs players")
        if len(set(self.players)) != len(self.players):
            raise ValueError("a player is named twice")

    @property
    def nplayers(self) -> int:
        return len(self.players)

    @classmethod
    def from_spec(cls, **spec: Any) -> Game:
        """A game from keywords; players must be among them, and others than the fields are an error."""
        known = {"players", "initial", "terminal", "schema", "win_conditions"}
        if unknown := set(spec) - known:
            raise ValueError(f"no part of a game: {', '.join(sorted(unknown))}")
        if "players" not in spec:
            raise ValueError("a game needs players")
        return cls(**spec | {"players": tuple(spec["players"])})

    def run(self, schedule: Schedule, world: World, agents: Mapping, **options) -> runner.Result:
        return runner.run(schedule, world, agents, terminal=self.terminal, win_conditions=self.win_conditions, **options)


@dataclass(frozen=True)
class GameMigration:
    """A game moved to another schema: by new names, or by inclusion where no renaming is given."""

    source: Game
    target: Schema
    renaming: Renaming | None = None

    def world(self, w: World) -> World:
        moved = self.renaming.world(w) if self.renaming else w
        return included(moved, self.target)

    def game(self) -> Game:
        start = self.source.initial
        return replace(self.source, schema=self.target, initial=None if start is None else lambda spark: self.world(start(spark)))
