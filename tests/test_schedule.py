"""The schedule language, and schedules run on batches of worlds."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import agents
from tessera.game import Game
from tessera.operators.conditions import forbid
from tessera.pattern import Pattern
from tessera.plans import runner
from tessera.plans import schedule as S
from tessera.rule import adding, deleting, identity
from tessera.schema import Schema
from tessera.world import graph_rows, make, repeated

GRAPH = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})
V = Pattern(GRAPH, {"v": "V"})
GROW = adding("grow", Pattern(GRAPH), V)
DROP = deleting("drop", V, Pattern(GRAPH))
LOOP = Pattern(GRAPH, {"v": "V", "e": "E"}, {("e", "src"): "v", ("e", "tgt"): "v"})
MARK = adding("mark", V, LOOP, conditions=(forbid(LOOP),))
AGENTS = {"p": agents.First(), "r": agents.Random(4)}


def world(spark, n, copies=1):
    w = make(spark, GRAPH, graph_rows(n, []))
    return repeated(w, copies) if copies > 1 else w


def sizes(result, ob="V"):
    return {r["world_id"]: r["n"] for r in result.world.nparts(ob).collect()}


def test_parse():
    steps, returns = S.parse("a, b = x(i)\nc = m([a, b], y(m(j)))\nreturn c, a")
    assert steps == (S.Step("x", ("i",), ("a", "b")), S.Step("m", ("j",), ("_gstmp_2",)), S.Step("y", ("_gstmp_2",), ("_gstmp_1",)), S.Step("m", ("a", "b", "_gstmp_1"), ("c",)))
    assert returns == ("c", "a")
    for bad in ("a = b", "import os", "a = 1(x)", "a = x(1)"):
        with pytest.raises(SyntaxError):
            S.parse(bad)


def test_wiring_is_checked():
    m = {"m": S.Merge()}
    for body in ("a = n(i)\nreturn a", "a = m(k)\nreturn a", "a = m(i)\nb = m(i)\nreturn a, b", "a, b = m(i)\nreturn a", "a = m(i)\nreturn i"):
        with pytest.raises(ValueError):
            S.schedule("s", [], ["i"], m, body)


def looped(box):
    return S.schedule("loop", ["t"], ["i"], {"box": box, "m": S.Merge()}, "w = m(t, i)\ns, f = box(w)\nreturn s, f")


@pytest.mark.parametrize("t_max", [0, 2])
def test_turns(spark, t_max):
    r = runner.run(looped(S.PlayerRuleApp("grow", GROW, "p")), world(spark, 1, 2), AGENTS, t_max=t_max)
    assert sizes(r) == {0: 2 + t_max, 1: 2 + t_max}
    rows = r.experiences.orderBy("world_id", "turn").collect()
    assert [x["turn"] for x in rows if x["world_id"] == 1] == list(range(1, t_max + 2))
    assert [x["done"] for x in rows if x["world_id"] == 1] == [False] * t_max + [True]


def test_exhaustion_takes_the_failure_wire(spark):
    s = looped(S.PlayerRuleApp("mark", MARK, "r"))
    r = runner.run(s, world(spark, 2, 2), AGENTS, win_conditions={"f": "winner"}, keep_legal=True, snapshots=True, log_changes=True)
    assert sizes(r, "E") == {0: 2, 1: 2}
    rows = r.experiences.where("world_id = 0").orderBy("turn").collect()
    assert [(x["action"], x["legal"], x["done"], x["winner"]) for x in rows] == [("mark", 2, False, None), ("mark", 1, False, None), (None, 0, True, "winner")]
    assert [len(x["legal_actions"] or []) for x in rows] == [2, 1, 0]
    assert {(x["done"], x["winner"], x["exit_wire"]) for x in r.control.collect()} == {(True, "winner", "f")}
    assert [t["E"].where("world_id = 0").count() for _, t in r.snapshots] == [1, 2, 2]
    assert r.changes.where("world_id = 0 and change = 'add'").count() == 2
    assert r.events.where("fired").count() == 4


def test_terminal(spark):
    def terminal(w):
        return w.nparts("V").select("world_id", (F.col("n") >= 3).alias("done"), F.lit("p").alias("winner"))

    r = runner.run(looped(S.PlayerRuleApp("grow", GROW, "p")), world(spark, 1, 2), AGENTS, terminal=terminal)
    assert set(sizes(r).values()) == {3}
    assert r.experiences.where("done").select("winner").distinct().first()["winner"] == "p"
    # where exits decide, the terminal isn't asked
    r = Game(("p",), None, terminal, GRAPH, {"f": None}).run(looped(S.PlayerRuleApp("grow", GROW, "p")), world(spark, 1), AGENTS, t_max=2)
    assert sizes(r) == {0: 4}


def test_native_rule_is_no_decision(spark):
    body = {"n": S.RuleApp("native", MARK), "p": S.PlayerRuleApp("player", MARK, "p")}
    s = S.schedule("s", [], ["i"], body, "a, b = n(i)\nc, d = p(a)\nreturn c, d, b")
    r = runner.run(s, world(spark, 2), AGENTS)
    assert r.experiences.count() == 1 and r.control.first()["turn"] == 1
    r = runner.run(s, make(spark, GRAPH, graph_rows(1, [(1, 1)])), AGENTS)
    assert r.experiences.count() == 0 and r.control.first()["exit_wire"] == "b"


def test_pass(spark):
    box = S.PlayerRuleApp("mark", MARK, "f", can_pass=True)
    last = agents.Function(lambda w, turn, rows: len(rows) - 1)
    r = runner.run(S.tryrule(box), world(spark, 2), {"f": last})
    row = r.experiences.first()
    assert row["action"] is None and row["legal"] == 3 and sizes(r, "E") == {0: 0}
    none = agents.Function(lambda w, turn, rows: None)
    assert runner.run(S.tryrule(box), world(spark, 2), {"f": none}).experiences.first()["action"] is None
    nothing = make(spark, GRAPH, graph_rows(1, [(1, 1)]))
    assert runner.run(S.tryrule(box), nothing, {"f": last}).experiences.first()["legal"] == 0


@pytest.mark.parametrize("cached", [False, True])
def test_limit_and_cache(spark, cached):
    box = S.PlayerRuleApp("mark", MARK, "p", match_limit=1, use_cache=cached)
    r = runner.run(looped(box), world(spark, 2), AGENTS)
    assert [x["legal"] for x in r.experiences.orderBy("turn").collect()] == [1, 1, 0]
    assert sizes(r, "E") == {0: 2}


def test_views_and_own_matchers(spark):
    from tessera.operators.matching import match

    seen = S.PlayerRuleApp("mark", MARK, "p", view_fn=lambda w: w.with_tables(V=w.table("V").where("part_id > 2")))
    r = runner.run(looped(seen), world(spark, 4), AGENTS)
    assert sorted(x["src"] for x in r.world.table("E").collect()) == [3, 4]
    own = S.PlayerRuleApp("mark", MARK, "p", fast_match_fn=lambda rule, w: match(rule.left, w).where("v = 2"))
    assert [x["src"] for x in runner.run(looped(own), world(spark, 4), AGENTS).world.table("E").collect()] == [2]
    some = S.PlayerRuleApp("mark", MARK, "p", take=lambda step, box: 2)
    assert runner.run(S.tryrule(some), world(spark, 4), AGENTS).experiences.first()["legal"] == 2


@pytest.mark.parametrize("n", [3])
def test_agent_loop(spark, n):
    box = S.PlayerRuleApp("mark", MARK, "p", in_hom={"a": "v"})
    loop = S.AgentLoop("each", Pattern(GRAPH, {"a": "V"}), box)
    s = S.schedule("s", [], ["i"], {"l": loop}, "r = l(i)\nreturn r")
    r = runner.run(s, world(spark, n, 2), AGENTS)
    assert set(sizes(r, "E").values()) == {n} and r.experiences.count() == 2 * n


@pytest.mark.parametrize("n", [310])
def test_agents_at_once(spark, n):
    box = S.PlayerRuleApp("mark", MARK, "p", in_hom={"a": "v"})
    s = S.schedule("s", [], ["i"], {"l": S.AgentLoop("each", Pattern(GRAPH, {"a": "V"}), box, at_once=True)}, "r = l(i)\nreturn r")
    assert sizes(runner.run(s, world(spark, n), AGENTS), "E") == {0: n}


def test_agents_that_contend(spark):
    pair = Pattern(GRAPH, {"a": "V", "b": "V"})
    eat = deleting("eat", pair, Pattern(GRAPH, {"a": "V"}), monic=True)
    box = S.PlayerRuleApp("eat", eat, "p", in_hom={"x": "a"})
    for at_once in (True, False):
        s = S.schedule("s", [], ["i"], {"l": S.AgentLoop("each", Pattern(GRAPH, {"x": "V"}), box, at_once=at_once)}, "r = l(i)\nreturn r")
        left = sizes(runner.run(s, world(spark, 3), AGENTS))[0]
        assert left == (1 if not at_once else 2)


def test_coin_and_split(spark):
    s = S.schedule("s", [], ["i"], {"c": S.Coin("c", 0.25)}, "a, b = c(i)\nreturn a, b")
    r = runner.run(s, world(spark, 1, 400), AGENTS, seed=3)
    heads = r.control.where("exit_wire = 'a'").count()
    assert 60 < heads < 140
    again = runner.run(s, world(spark, 1, 400), AGENTS, seed=3)
    assert again.control.where("exit_wire = 'a'").count() == heads
    s = S.schedule("s", [], ["i"], {"c": S.Split("c", (1, 2, 1))}, "a, b, c2 = c(i)\nreturn a, b, c2")
    got = {x["exit_wire"]: x["count"] for x in runner.run(s, world(spark, 1, 400), AGENTS).control.groupBy("exit_wire").count().collect()}
    assert sum(got.values()) == 400 and got["b"] > got["a"] > 50
    with pytest.raises(ValueError):
        S.Coin("c", 2)


def test_query_while_nested(spark):
    s = S.schedule("s", [], ["i"], {"q": S.Query("q", LOOP)}, "a, b = q(i)\nreturn a, b")
    assert runner.run(s, make(spark, GRAPH, graph_rows(1, [(1, 1)])), AGENTS).control.first()["exit_wire"] == "a"
    grow = S.While("w", S.RuleApp("grow", GROW), lambda w: w.nparts("V").where("n < 2").select("world_id"))
    s = S.schedule("s", [], ["i"], {"w": grow}, "a = w(i)\nreturn a")
    assert sizes(runner.run(s, world(spark, 1), AGENTS)) == {0: 2}
    inner = looped(S.PlayerRuleApp("mark", MARK, "p"))
    s = S.schedule("outer", [], ["i"], {"x": inner, "w": S.Weaken()}, "a = x(i)\nb = w(a)\nreturn b")
    r = runner.run(s, world(spark, 1), AGENTS)
    assert sizes(r, "E") == {0: 1} and r.control.first()["exit_wire"] == "b"
    assert r.experiences.first()["schedule_path"] == ["outer", "loop"]


def test_combinators(spark):
    grow, mark = S.RuleApp("g", GROW), S.RuleApp("m", MARK)
    r = runner.run(S.then(grow, mark), world(spark, 0), AGENTS)
    assert sizes(r) == {0: 1} and sizes(r, "E") == {0: 1}
    r = runner.run(S.then(S.tryrule(grow), S.tryrule(grow)), world(spark, 0), AGENTS)
    assert sizes(r) == {0: 2}
    r = runner.run(S.tensor(grow, mark), world(spark, 1), AGENTS)
    assert sizes(r) == {0: 2, 1: 1} and sizes(r, "E") == {0: 0, 1: 1}
    assert {x["world_id"]: x["exit_wire"] for x in r.control.collect()} == {0: "s1", 1: "s2"}


def test_batches_are_single_runs(spark):
    s = looped(S.PlayerRuleApp("mark", MARK, "r"))
    many = runner.run(s, world(spark, 2, 3), AGENTS, seed=5)
    tables = make(spark, GRAPH, {"V": [{"world_id": 2, "part_id": i + 1} for i in range(2)], "E": []})
    one = runner.run(s, tables, AGENTS, seed=5)

    def order(r):
        return [x["src"] for x in r.world.table("E").where("world_id = 2").orderBy("part_id").collect()]

    assert order(many) == order(one)


def test_walks_and_drawing():
    p = S.PlayerRuleApp("x", MARK, "red")
    outer = S.schedule("o", [], ["i"], {"a": S.AgentLoop("l", V, looped(p)), "c": S.Coin("c", 0.5)}, "b = a(i)\nd, e = c(b)\nreturn d, e")
    assert [b.name for b in S.players(outer)] == ["x"]
    assert [x.elements for x in S.right_sides(outer)] == [LOOP.elements]
    text = S.dot(looped(p))
    assert text.startswith("digraph") and "dashed" in text
    blue = S.mapped(outer, lambda r: r, lambda q: q, lambda n: "blue")
    assert S.players(blue)[0].player == "blue" and S.players(blue)[0].match_limit is None


def test_policies(spark):
    w = make(spark, Schema(("V",), {}, {"x": ("V", T.LongType())}), {"V": [{"x": i} for i in (4, 9, 2)]})
    p = Pattern(w.schema, {"v": "V"})
    from tessera.operators.matching import match

    found = match(p, w, extra={"v": ["x"]}).withColumn("passes", F.lit(False))
    ctx = agents.Context(w, "p", 1, ("v",))
    assert agents.ArgMax(lambda df, c: F.col("`v.x`")).choose(found, ctx).first()["v"] == 2
    assert agents.First().choose(found, ctx).first()["v"] == 1
    assert agents.Vectorised(lambda m, turn: 99).choose(found, ctx).first()["v"] == 3
    assert agents.Vectorised(lambda m, turn: -5).choose(found, ctx).first()["v"] == 1
    assert agents.Softmax(lambda df, c: F.col("`v.x`") * 100).choose(found, ctx).first()["v"] == 2
    drawn = {agents.Random(s).choose(found, ctx).first()["v"] for s in range(20)}
    assert drawn == {1, 2, 3}
    nodes, edges = ctx.graph()
    assert nodes.count() == 3 and edges.count() == 0


def test_games_need_players():
    with pytest.raises(ValueError):
        Game.from_spec(terminal=None)
    with pytest.raises(ValueError):
        Game.from_spec(players=["a"], colour=1)
    assert Game.from_spec(players=["a", "b"]).nplayers == 2


def test_tictactoe(spark):
    from tessera.games import tictactoe

    r = tictactoe.play(spark, 30, seed=2, t_max=2)
    marks = r.world.table("X").unionByName(r.world.table("O").withColumnRenamed("osq", "xsq"))
    assert marks.count() == 30 * 4 and marks.select("world_id", "xsq").distinct().count() == 30 * 4
    won = make(spark, tictactoe.SCHEMA, {"Sq": [{"num": i + 1} for i in range(9)], "Step": tictactoe.steps(), "X": [{"xsq": i} for i in (3, 5, 7)], "O": [{"osq": i} for i in (1, 2, 6)]})
    assert tictactoe.terminal(won).first()["winner"] == "X"
    bent = won.with_tables(X=won.table("X").withColumn("xsq", F.when(F.col("xsq") == 7, 1).otherwise(F.col("xsq")).cast("long")))
    assert not tictactoe.terminal(bent).first()["done"]


def test_identity_rules_only_look(spark):
    r = runner.run(S.tryrule(S.PlayerRuleApp("look", identity("look", V), "p")), world(spark, 2), AGENTS)
    assert sizes(r) == {0: 2} and r.experiences.first()["action"] == "look"
