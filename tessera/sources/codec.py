"""JSON forms of schemas, worlds, patterns, rules, schedules and games.

Everything of a rule is written but its functions: expressions, views and matchers are named, and a reader gives the
functions by name. Values keep their types, which the schema states. A world in the plain form, with `_n` counts and
columns of 1-based ids and of texts, can be read as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessera.game import Game
from tessera.operators.conditions import Condition
from tessera.pattern import Pattern, Threshold, Var
from tessera.plans import schedule as S
from tessera.rule import Delta, Rule
from tessera.schema import Schema
from tessera.world import World, make

Functions = Mapping[str, Callable]


def schema_out(s: Schema) -> dict:
    return {"obs": list(s.obs), "homs": {h: list(v) for h, v in s.homs.items()}, "attrs": {n: [o, t.json()] for n, (o, t) in s.attrs.items()}}


def schema_in(d: dict) -> Schema:
    return Schema(tuple(d["obs"]), {h: tuple(v) for h, v in d["homs"].items()}, {n: (o, T._parse_datatype_json_string(t)) for n, (o, t) in d["attrs"].items()})


def _plain(v: Any) -> Any:
    if isinstance(v, T.Row):
        return v.asDict(recursive=True)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, float, str, dict)) else {"_text": str(v)}


def world_out(w: World) -> dict:
    """A small world as rows by table; big ones go to tessera.sources.parquet."""
    rows = {o: [{k: _plain(v) for k, v in r.asDict().items()} for r in w.tables[o].orderBy("world_id", "part_id").collect()] for o in w.schema.load_order()}
    return {"worlds": sorted(r["world_id"] for r in w.ids.collect()), "tables": rows}


def world_in(spark: SparkSession, schema: Schema, d: dict) -> World:
    if "tables" in d:
        return make(spark, schema, d["tables"], d["worlds"])
    rows: dict[str, list[dict]] = {}
    for o in schema.obs:
        given = d.get(o, {})
        n = given.get("_n", 0) if isinstance(given, dict) else 0
        cols = {**schema.homs_of(o), **schema.attrs_of(o)}
        rows[o] = [{c: _typed(given[c][i], cols[c]) for c in cols if c in given} for i in range(n)]
    return make(spark, schema, rows)


def _typed(v: Any, kind: Any) -> Any:
    if v is None or isinstance(kind, str):
        return v or None
    if isinstance(kind, T.IntegralType):
        return int(v)
    if isinstance(kind, T.FractionalType):
        return float(v)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else str(v).lower() == "true"
    return str(v).removeprefix(":") if isinstance(kind, T.StringType) else v


def _value_out(v: Any) -> Any:
    return {"_var": v.name} if isinstance(v, Var) else v


def _value_in(v: Any) -> Any:
    return Var(v["_var"]) if isinstance(v, dict) and "_var" in v else v


def pattern_out(p: Pattern) -> dict:
    return {"elements": p.elements, "homs": [[e, h, t] for (e, h), t in p.homs.items()], "attrs": [[e, n, _value_out(v)] for (e, n), v in p.attrs.items()]}


def pattern_in(s: Schema, d: dict) -> Pattern:
    return Pattern(s, d["elements"], {(e, h): t for e, h, t in d["homs"]}, {(e, n): _value_in(v) for e, n, v in d["attrs"]})


def morphism_out(left: Pattern, right: Pattern, mapping: Mapping[str, str]) -> dict:
    """A map of patterns by elements, with both its ends."""
    if bad := [e for e, to in mapping.items() if left.elements[e] != right.elements[to]]:
        raise ValueError(f"{bad[0]} and {mapping[bad[0]]} are of different tables")
    return {"dom": pattern_out(left), "codom": pattern_out(right), "elements": dict(mapping)}


def morphism_in(s: Schema, d: dict) -> tuple[Pattern, Pattern, dict[str, str]]:
    return pattern_in(s, d["dom"]), pattern_in(s, d["codom"]), dict(d["elements"])


def _monic_out(m):
    return m if isinstance(m, bool) else list(m)


def _monic_in(m):
    return m if isinstance(m, bool) else tuple(m)


def _thresholds_out(ts):
    return [[t.element, t.attr, t.op, t.value] for t in ts]


def _name(f: Callable | None, functions: Functions) -> str | None:
    if f is None:
        return None
    for k, v in functions.items():
        if v is f:
            return k
    raise ValueError(f"{f!r} has no name among the functions")


def rule_out(r: Rule, functions: Functions | None = None) -> dict:
    functions = functions or {}
    return {
        "name": r.name, "left": pattern_out(r.left), "keep": dict(r.keep), "right": pattern_out(r.right), "monic": _monic_out(r.monic), "thresholds": _thresholds_out(r.thresholds),
        "conditions": [{"extension": pattern_out(c.extension), "must": c.must, "monic": _monic_out(c.monic), "thresholds": _thresholds_out(c.thresholds)} for c in r.conditions],
        "expressions": [[e, n, _name(f, functions)] for (e, n), f in r.expressions.items()], "deltas": [[d.element, d.attr, d.by, d.low, d.high] for d in r.deltas],
    }


def rule_in(s: Schema, d: dict, functions: Functions | None = None) -> Rule:
    functions = functions or {}
    conditions = tuple(Condition(pattern_in(s, c["extension"]), c["must"], _monic_in(c["monic"]), tuple(Threshold(*t) for t in c["thresholds"])) for c in d["conditions"])
    return Rule(
        d["name"], pattern_in(s, d["left"]), d["keep"], pattern_in(s, d["right"]), _monic_in(d["monic"]), conditions, {(e, n): functions[f] for e, n, f in d["expressions"]}, tuple(Threshold(*t) for t in d["thresholds"]), tuple(Delta(*x) for x in d["deltas"])
    )


def box_out(b: Any, functions: Functions | None = None) -> dict:
    functions = functions or {}
    if isinstance(b, S.PlayerRuleApp):
        take = b.take if b.take is None or isinstance(b.take, int) else {"_function": _name(b.take, functions)}
        return {"kind": "player", "name": b.name, "rule": rule_out(b.rule, functions), "player": b.player, "in_hom": dict(b.in_hom), "out_hom": dict(b.out_hom), "can_pass": b.can_pass, "match_limit": b.match_limit, "take": take, "view_fn": _name(b.view_fn, functions), "fast_match_fn": _name(b.fast_match_fn, functions), "use_cache": b.use_cache}
    if isinstance(b, S.RuleApp):
        return {"kind": "rule", "name": b.name, "rule": rule_out(b.rule, functions), "in_hom": dict(b.in_hom)}
    if isinstance(b, S.Query):
        return {"kind": "query", "name": b.name, "pattern": pattern_out(b.pattern), "monic": _monic_out(b.monic)}
    if isinstance(b, S.Merge):
        return {"kind": "merge", "name": b.name, "inputs": b.inputs}
    if isinstance(b, S.Coin):
        return {"kind": "coin", "name": b.name, "p": b.p}
    if isinstance(b, S.Split):
        return {"kind": "split", "name": b.name, "weights": list(b.weights)}
    if isinstance(b, S.Weaken):
        return {"kind": "weaken", "name": b.name}
    if isinstance(b, S.While):
        return {"kind": "while", "name": b.name, "body": box_out(b.body, functions), "test": _name(b.test, functions), "most": b.most}
    if isinstance(b, S.AgentLoop):
        return {"kind": "agents", "name": b.name, "interface": pattern_out(b.interface), "body": box_out(b.body, functions), "at_once": b.at_once}
    if isinstance(b, S.Schedule):
        return {"kind": "schedule", "name": b.name, "trace": list(b.trace), "inputs": list(b.inputs), "boxes": {k: box_out(x, functions) for k, x in b.boxes.items()}, "body": b.body}
    raise TypeError(f"no box: {b!r}")


def box_in(s: Schema, d: dict, functions: Functions | None = None) -> Any:
    functions = functions or {}

    def f(name):
        return None if name is None else functions[name]

    k = d["kind"]
    if k == "player":
        take = f(d["take"]["_function"]) if isinstance(d["take"], dict) else d["take"]
        return S.PlayerRuleApp(d["name"], rule_in(s, d["rule"], functions), d["player"], d["in_hom"], d["out_hom"], d["can_pass"], d["match_limit"], take, f(d["view_fn"]), f(d["fast_match_fn"]), d["use_cache"])
    if k == "rule":
        return S.RuleApp(d["name"], rule_in(s, d["rule"], functions), d["in_hom"])
    if k == "query":
        return S.Query(d["name"], pattern_in(s, d["pattern"]), _monic_in(d["monic"]))
    if k == "while":
        return S.While(d["name"], box_in(s, d["body"], functions), f(d["test"]), d["most"])
    if k == "agents":
        return S.AgentLoop(d["name"], pattern_in(s, d["interface"]), box_in(s, d["body"], functions), d["at_once"])
    if k == "schedule":
        return S.schedule(d["name"], d["trace"], d["inputs"], {n: box_in(s, x, functions) for n, x in d["boxes"].items()}, d["body"])
    simple = {"merge": lambda: S.Merge(d["name"], d["inputs"]), "coin": lambda: S.Coin(d["name"], d["p"]), "split": lambda: S.Split(d["name"], tuple(d["weights"])), "weaken": lambda: S.Weaken(d["name"])}
    if k not in simple:
        raise ValueError(f"no kind of box: {k}")
    return simple[k]()


def write_game(path: str, game: Game, schedule: S.Schedule, world: World, functions: Functions | None = None) -> None:
    """A game, its schedule and its start as one JSON file."""
    doc = {"players": list(game.players), "schema": schema_out(world.schema), "initial": world_out(world), "win_conditions": game.win_conditions, "terminal": _name(game.terminal, functions or {}), "schedule": box_out(schedule, functions)}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f)


def read_game(spark: SparkSession, path: str, functions: Functions | None = None) -> tuple[Game, S.Schedule, World]:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    schema = schema_in(d["schema"])
    world = world_in(spark, schema, d["initial"])
    terminal = None if d["terminal"] is None else (functions or {})[d["terminal"]]
    return Game(tuple(d["players"]), lambda _: world, terminal, schema, d["win_conditions"]), box_in(schema, d["schedule"], functions), world
