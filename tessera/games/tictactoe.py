"""Tic-tac-toe as rules and a schedule: marks are rows, a line is a pattern, the board a small graph."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.agents import Agent, Random
from tessera.game import Game
from tessera.operators.conditions import forbid
from tessera.operators.matching import match
from tessera.pattern import Pattern, Var
from tessera.plans.runner import Result
from tessera.plans.schedule import Merge, PlayerRuleApp, Schedule, schedule
from tessera.rule import adding
from tessera.schema import Schema
from tessera.world import World, make, repeated

#: Rows, columns and the two diagonals each have edges of their own kind, from a square to the next of the line.
SCHEMA = Schema(
    ("Sq", "Step", "X", "O"), {"xsq": ("X", "Sq"), "osq": ("O", "Sq"), "src": ("Step", "Sq"), "tgt": ("Step", "Sq")}, {"num": ("Sq", T.LongType()), "kind": ("Step", T.StringType())}
)


def steps() -> list[dict]:
    found = []
    for i in range(9):
        row, col = divmod(i, 3)
        for kind, r, c in (("row", 0, 1), ("column", 1, 0), ("down", 1, 1), ("up", -1, 1)):
            if 0 <= row + r < 3 and 0 <= col + c < 3:
                found.append({"src": i + 1, "tgt": 3 * (row + r) + col + c + 1, "kind": kind})
    return found


def board(spark: SparkSession) -> World:
    return replace(make(spark, SCHEMA, {"Sq": [{"num": i + 1} for i in range(9)], "Step": steps()}), checked=True)


def mark(player: str):
    """Put a mark on a square that has none."""
    left = Pattern(SCHEMA, {"s": "Sq"})
    right = Pattern(SCHEMA, {"s": "Sq", "m": player}, {("m", f"{player.lower()}sq"): "s"})
    taken = [forbid(Pattern(SCHEMA, {"s": "Sq", "t": p}, {("t", f"{p.lower()}sq"): "s"})) for p in ("X", "O")]
    return adding(f"mark_{player}", left, right, conditions=tuple(taken))


def line(player: str) -> Pattern:
    """Three marks along two steps of one kind."""
    h = f"{player.lower()}sq"
    return Pattern(
        SCHEMA, {"a": "Sq", "b": "Sq", "c": "Sq", "e": "Step", "f": "Step", "x": player, "y": player, "z": player},
        {("e", "src"): "a", ("e", "tgt"): "b", ("f", "src"): "b", ("f", "tgt"): "c", ("x", h): "a", ("y", h): "b", ("z", h): "c"}, {("e", "kind"): Var("kind"), ("f", "kind"): Var("kind")},
    )


def terminal(w: World) -> DataFrame:
    """Won by a line, drawn by nine marks."""
    won = None
    for p in ("X", "O"):
        found = match(line(p), w).select("world_id", F.lit(p).alias("winner"))
        won = found if won is None else won.unionByName(found)
    won = won.groupBy("world_id").agg(F.min("winner").alias("winner"))
    marks = w.table("X").select("world_id").unionByName(w.table("O").select("world_id")).groupBy("world_id").agg(F.count(F.lit(1)).alias("n"))
    return w.ids.join(won, "world_id", "left").join(marks, "world_id", "left").select("world_id", (F.col("winner").isNotNull() | (F.col("n") >= 9)).alias("done"), "winner")


def turns() -> Schedule:
    """X moves, then O, round and round; a player that can't move ends the game as a draw."""
    boxes = {"x": PlayerRuleApp("x_moves", mark("X"), "X"), "o": PlayerRuleApp("o_moves", mark("O"), "O")}
    return schedule("tictactoe", ["again"], ["start"], boxes | {"merge": Merge()}, "w = merge(again, start)\nx1, x0 = x(w)\no1, o0 = o(x1)\nreturn o1, x0, o0")


GAME = Game(("X", "O"), board, terminal, SCHEMA)


def play(spark: SparkSession, games: int, agents: Mapping[str, Agent] | None = None, seed: int = 0, **options) -> Result:
    """So many games at once, by default at random."""
    agents = agents or {"X": Random(1), "O": Random(2)}
    return GAME.run(turns(), repeated(board(spark), games), agents, seed=seed, **options)
