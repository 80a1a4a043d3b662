"""Conditions, rules and rewriting against golden cases."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import conditions, incremental, rewriting
from tessera.operators.matching import match
from tessera.pattern import Pattern, Threshold, Var, path
from tessera.rule import Delta, Rule, adding, deleting, identity
from tessera.schema import Schema
from tessera.world import graph_rows, make, repeated

GRAPH = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})
BLOCKED = Schema(("V", "Blk"), {"bv": ("Blk", "V")})
FUEL = Schema(("V",), {}, {"fuel": ("V", T.LongType())})
FARM = Schema(
    ("V", "E", "Sheep", "Wolf", "Time"), {"src": ("E", "V"), "tgt": ("E", "V"), "sheep_loc": ("Sheep", "V"), "wolf_loc": ("Wolf", "V"), "countdown": ("Time", "V")},
    {"sheep_eng": ("Sheep", T.LongType()), "wolf_eng": ("Wolf", T.LongType()), "dir": ("E", T.StringType()), "sheep_dir": ("Sheep", T.StringType()), "wolf_dir": ("Wolf", T.StringType())},
)
V = Pattern(GRAPH, {"v": "V"})
LOOP = Pattern(GRAPH, {"v": "V", "e": "E"}, {("e", "src"): "v", ("e", "tgt"): "v"})


def fire(rule, world, **options):
    """Apply the first legal match."""
    return rewriting.apply(rule, rewriting.legal(rule, world, limit=1, **options), world)


def test_blocked(spark):
    rule = adding("block", Pattern(BLOCKED, {"v": "V"}), Pattern(BLOCKED, {"v": "V", "b": "Blk"}, {("b", "bv"): "v"}), conditions=(conditions.forbid(Pattern(BLOCKED, {"v": "V", "x": "Blk"}, {("x", "bv"): "v"})),))
    w = make(spark, BLOCKED, {"V": [{}, {}], "Blk": [{"bv": 1}]})
    assert [r["v"] for r in rewriting.legal(rule, w).collect()] == [2]
    after = fire(rule, w).world
    assert after.table("Blk").count() == 2 and rewriting.legal(rule, after).count() == 0


def loop_rule():
    return adding("loop", V, LOOP, conditions=(conditions.forbid(LOOP),))


def test_loops(spark):
    assert rewriting.legal(loop_rule(), make(spark, GRAPH, graph_rows(2, [(1, 1), (2, 2)]))).count() == 0
    assert rewriting.legal(loop_rule(), make(spark, GRAPH, graph_rows(2, []))).count() == 2
    w = make(spark, GRAPH, graph_rows(3, [(1, 1), (2, 2)]))
    assert [r["v"] for r in rewriting.legal(loop_rule(), w).collect()] == [3]
    assert fire(loop_rule(), w).world.table("E").count() == 3
    half = make(spark, GRAPH, graph_rows(80, [(i, i) for i in range(1, 41)]))
    assert fire(loop_rule(), half).world.table("E").count() == 41


def test_two_new_elements(spark):
    out = Pattern(GRAPH, {"v": "V", "u": "V", "e": "E"}, {("e", "src"): "v", ("e", "tgt"): "u"})
    for monic, looped in ((False, [2, 3]), (["V"], [1, 2, 3])):
        rule = adding("loop", V, LOOP, conditions=(conditions.forbid(out, monic=monic),))
        assert rewriting.legal(rule, make(spark, GRAPH, graph_rows(2, [(1, 2), (2, 1)]))).count() == 0
        assert rewriting.legal(rule, make(spark, GRAPH, graph_rows(2, []))).count() == 2
        assert sorted(r["v"] for r in rewriting.legal(rule, make(spark, GRAPH, graph_rows(3, [(1, 2)]))).collect()) == [2, 3]
        # an edge to itself counts where the new vertex may be the old one
        assert sorted(r["v"] for r in rewriting.legal(rule, make(spark, GRAPH, graph_rows(3, [(1, 1)]))).collect()) == looped


def test_shared_variables_in_conditions(spark):
    s = GRAPH.extend(attrs={"c": ("V", T.StringType())})
    left = Pattern(s, {"v": "V"}, {}, {("v", "c"): Var("x")})
    twin = Pattern(s, {"v": "V", "u": "V"}, {}, {("v", "c"): Var("x"), ("u", "c"): Var("x")})
    w = make(spark, s, {"V": [{"c": "a"}, {"c": "a"}, {"c": "b"}], "E": []})
    found = conditions.satisfied(match(left, w), left, w, [conditions.forbid(twin, monic=True)])
    assert [r["v"] for r in found.collect()] == [3]
    assert conditions.satisfied(match(left, w), left, w, [conditions.require(twin)]).count() == 3


def test_random_conditions_are_brute_force(spark):
    rng = random.Random(2)
    for _ in range(6):
        n = rng.randint(2, 6)
        edges = [(rng.randint(1, n), rng.randint(1, n)) for _ in range(rng.randint(0, 7))]
        w = make(spark, GRAPH, graph_rows(n, edges))
        p2 = path(GRAPH, 2)
        longer = Pattern(GRAPH, p2.elements | {"V_3": "V", "E_2": "E"}, p2.homs | {("E_2", "src"): "V_2", ("E_2", "tgt"): "V_3"})
        got = {r["E_1"] for r in conditions.satisfied(match(p2, w), p2, w, [conditions.forbid(longer)]).collect()}
        assert got == {i + 1 for i, (_, b) in enumerate(edges) if not any(a == b for a, _ in edges)}
        got = {r["E_1"] for r in conditions.satisfied(match(p2, w), p2, w, [conditions.require(longer, monic=["E"])]).collect()}
        assert got == {i + 1 for i, (_, b) in enumerate(edges) if any(a == b and j != i for j, (a, _) in enumerate(edges))}


def test_dangling_and_identification(spark):
    drop = deleting("drop", V, Pattern(GRAPH))
    w = make(spark, GRAPH, graph_rows(3, [(1, 2)]))
    assert [r["v"] for r in rewriting.legal(drop, w).collect()] == [3]
    both = deleting("both", Pattern(GRAPH, {"e": "E", "a": "V", "b": "V"}, {("e", "src"): "a", ("e", "tgt"): "b"}), Pattern(GRAPH))
    assert rewriting.legal(both, w).count() == 1
    assert fire(both, w).world.table("V").count() == 1
    # one row can't be both deleted and kept
    one = deleting("one", Pattern(GRAPH, {"a": "V", "b": "V"}), Pattern(GRAPH, {"b": "V"}))
    assert rewriting.legal(one, make(spark, GRAPH, graph_rows(1, []))).count() == 0
    assert rewriting.legal(one, make(spark, GRAPH, graph_rows(2, []))).count() == 2


def test_ids_are_never_used_again(spark):
    w = make(spark, GRAPH, graph_rows(3, []))
    w = fire(deleting("drop", V, Pattern(GRAPH)), w, pins={"v": 3}).world
    add = adding("add", Pattern(GRAPH), V)
    w = fire(add, w).world
    first = {r["part_id"] for r in w.table("V").collect()}
    w = fire(deleting("drop", V, Pattern(GRAPH)), w, pins={"v": max(first)}).world
    w = fire(add, w).world
    assert max(r["part_id"] for r in w.table("V").collect()) > max(first)


def test_counting_down(spark):
    p = Pattern(FUEL, {"v": "V"})
    rule = identity("burn", p, thresholds=(Threshold("v", "fuel", ">=", 1),), deltas=(Delta("v", "fuel", -1, low=0),))
    w = make(spark, FUEL, {"V": [{"fuel": 3}]})
    for _ in range(5):
        w = fire(rule, w).world
    assert w.table("V").first()["fuel"] == 0


def farm(spark, **rows):
    base = {"V": [{}, {}], "E": [{"src": 1, "tgt": 2, "dir": "N"}]}
    return make(spark, FARM, base | rows)


def test_turn_and_move(spark):
    sheep = {"s": "Sheep", "v": "V"}
    homs = {("s", "sheep_loc"): "v"}
    left_of = {"N": "W", "W": "S", "S": "E", "E": "N"}
    from tessera.functions.numbering import chosen_of

    at = Pattern(FARM, sheep, homs, {("s", "sheep_dir"): Var("d")})
    turn = Rule("left", at, {"s": "s", "v": "v"}, at, expressions={("s", "sheep_dir"): lambda of: chosen_of(of("d"), left_of)})
    w = fire(turn, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_dir": "N", "sheep_eng": 10}])).world
    assert (w.table("Sheep").first()["sheep_dir"], w.table("Sheep").first()["sheep_eng"]) == ("W", 10)

    ahead = Pattern(FARM, {"s": "Sheep", "a": "V", "b": "V", "e": "E"}, {("s", "sheep_loc"): "a", ("e", "src"): "a", ("e", "tgt"): "b"}, {("s", "sheep_dir"): Var("d"), ("e", "dir"): Var("d")})
    after = Pattern(FARM, ahead.elements, ahead.homs | {("s", "sheep_loc"): "b"}, ahead.attrs)
    starved = Pattern(FARM, {"s": "Sheep"}, {}, {("s", "sheep_eng"): 0})
    move = Rule("move", ahead, {e: e for e in ahead.elements}, after, conditions=(conditions.forbid(starved),), expressions={("s", "sheep_eng"): lambda of: of("s.sheep_eng") - 1})
    w = fire(move, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_dir": "N", "sheep_eng": 10}])).world
    assert (w.table("Sheep").first()["sheep_loc"], w.table("Sheep").first()["sheep_eng"]) == (2, 9)
    assert rewriting.legal(move, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_dir": "N", "sheep_eng": 0}])).count() == 0
    assert rewriting.legal(move, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_dir": "S", "sheep_eng": 5}])).count() == 0


def test_eat_and_breed(spark):
    at = Pattern(FARM, {"s": "Sheep", "v": "V"}, {("s", "sheep_loc"): "v"})
    grown = Pattern(FARM, at.elements | {f"t{i}": "Time" for i in range(30)}, at.homs | {(f"t{i}", "countdown"): "v" for i in range(30)})
    eaten = Pattern(FARM, {"v": "V", "t": "Time"}, {("t", "countdown"): "v"})
    eat = Rule("eat", at, {"s": "s", "v": "v"}, grown, conditions=(conditions.forbid(eaten),), expressions={("s", "sheep_eng"): lambda of: of("s.sheep_eng") + 4})
    w = fire(eat, farm(spark, Sheep=[{"sheep_loc": 2, "sheep_dir": "W", "sheep_eng": 3}])).world
    assert w.table("Sheep").first()["sheep_eng"] == 7
    assert w.table("Time").groupBy("countdown").count().first().asDict() == {"countdown": 2, "count": 30}
    assert rewriting.legal(eat, w).count() == 0

    prey = Pattern(FARM, {"w": "Wolf", "s": "Sheep", "v": "V"}, {("w", "wolf_loc"): "v", ("s", "sheep_loc"): "v"})
    fed = Pattern(FARM, {"w": "Wolf", "v": "V"}, {("w", "wolf_loc"): "v"})
    hunt = Rule("hunt", prey, {"w": "w", "v": "v"}, fed, expressions={("w", "wolf_eng"): lambda of: of("w.wolf_eng") + 20})
    w = fire(hunt, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_eng": 3}], Wolf=[{"wolf_loc": 1, "wolf_eng": 16}])).world
    assert w.table("Sheep").count() == 0 and w.table("Wolf").first()["wolf_eng"] == 36

    starve = deleting("starve", Pattern(FARM, {"s": "Sheep"}, {}, {("s", "sheep_eng"): 0}), Pattern(FARM))
    w = fire(starve, farm(spark, Sheep=[{"sheep_loc": 1, "sheep_eng": 0}, {"sheep_loc": 1, "sheep_eng": 2}])).world
    assert [r["sheep_eng"] for r in w.table("Sheep").collect()] == [2]

    one = Pattern(FARM, {"s": "Sheep", "v": "V"}, {("s", "sheep_loc"): "v"}, {("s", "sheep_dir"): Var("d")})
    two = Pattern(FARM, one.elements | {"n": "Sheep"}, one.homs | {("n", "sheep_loc"): "v"}, {("s", "sheep_dir"): Var("d"), ("n", "sheep_dir"): Var("d")})
    half = {(e, "sheep_eng"): lambda of: F.ceil(of("s.sheep_eng") / 2) for e in ("s", "n")}
    w = fire(Rule("breed", one, {"s": "s", "v": "v"}, two, expressions=half), farm(spark, Sheep=[{"sheep_loc": 1, "sheep_dir": "E", "sheep_eng": 10}])).world
    assert [(r["sheep_eng"], r["sheep_dir"], r["sheep_loc"]) for r in w.table("Sheep").collect()] == [(5, "E", 1)] * 2

    grass = deleting("grass", Pattern(FARM, {"t": "Time"}), Pattern(FARM))
    assert fire(grass, farm(spark, Time=[{"countdown": 1}] * 3)).world.table("Time").count() == 2


def test_set_at_a_time(spark):
    w = repeated(make(spark, GRAPH, graph_rows(3, [(1, 2)])), 4)
    after = rewriting.apply(loop_rule(), rewriting.legal(loop_rule(), w), w).world
    assert {r["world_id"]: r["n"] for r in after.nparts("E").collect()} == {i: 4 for i in range(4)}
    assert after.table("E").select("world_id", "part_id").distinct().count() == 16
    assert after.dangling().count() == 0


def test_values_can_become_null(spark):
    p = Pattern(FUEL, {"v": "V"})
    w = fire(Rule("clear", p, {"v": "v"}, p, expressions={("v", "fuel"): lambda of: F.lit(None).cast("long")}), make(spark, FUEL, {"V": [{"fuel": 3}]})).world
    assert w.table("V").first()["fuel"] is None


def test_independent(spark):
    pair = Pattern(GRAPH, {"a": "V", "b": "V"})
    eat = deleting("eat", pair, Pattern(GRAPH, {"a": "V"}), monic=True)
    w = make(spark, GRAPH, graph_rows(4, []))
    kept = rewriting.independent(eat, rewriting.legal(eat, w), [F.col("a"), F.col("b")])
    rows = [(r["a"], r["b"]) for r in kept.collect()]
    used = [x for row in rows for x in row]
    assert rows and (1, 2) in rows
    for a, b in rows:
        assert used.count(b) == 1


def test_cascade(spark):
    w = make(spark, GRAPH, graph_rows(4, [(1, 2), (2, 3), (3, 4)]))
    after = rewriting.cascade(w, {"V": w.table("V").where("part_id = 2").select("world_id", "part_id")})
    assert after.table("V").count() == 3 and [r["part_id"] for r in after.table("E").collect()] == [3]
    s = Schema(("A",), {"up": ("A", "A")})
    w = make(spark, s, {"A": [{"up": None}, {"up": 1}, {"up": 2}, {"up": 4}]})
    assert [r["part_id"] for r in rewriting.cascade(w, {"A": w.table("A").where("part_id = 1").select("world_id", "part_id")}).table("A").collect()] == [4]


def test_cache_is_fresh(spark):
    rng = random.Random(3)
    look = identity("look", path(GRAPH, 3), monic=["E"])
    rules = [loop_rule(), deleting("cut", path(GRAPH, 2), Pattern(GRAPH, {"V_1": "V", "V_2": "V"})), adding("grow", V, Pattern(GRAPH, {"v": "V", "u": "V", "e": "E"}, {("e", "src"): "v", ("e", "tgt"): "u"}))]
    turn = Pattern(GRAPH, {"e": "E", "a": "V", "b": "V"}, {("e", "src"): "a", ("e", "tgt"): "b"})
    rules.append(Rule("turn", turn, {e: e for e in turn.elements}, Pattern(GRAPH, turn.elements, {("e", "src"): "b", ("e", "tgt"): "a"})))
    w = make(spark, GRAPH, graph_rows(4, [(1, 2), (2, 3), (3, 4), (4, 1)]))
    cache = incremental.MatchCache.fresh(look, w)
    for _ in range(5):
        rule = rng.choice(rules)
        change = rewriting.apply(rule, rewriting.legal(rule, w, take=1, seed=rng.randrange(99)), w)
        w = change.world.cut()
        from dataclasses import replace

        cache = cache.updated(w, replace(change, world=w)).cut()
        assert incremental.same(cache.matches, match(look.left, w, look.monic), look)


def test_streamed_changes(spark, tmp_path):
    from tessera.streaming.maintain import Maintained, follow

    w = make(spark, GRAPH, graph_rows(3, [(1, 2)]))
    state = Maintained(w, identity("look", path(GRAPH, 3)), "E")
    schema = "world_id bigint, part_id bigint, src bigint, tgt bigint, change string, seq bigint"
    spark.createDataFrame([(0, 2, 2, 3, "add", 1), (0, 1, 1, 1, "update", 2), (0, 2, 2, 2, "update", 3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), state, str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination()
    assert incremental.same(state.cache.matches, match(path(GRAPH, 3), state.world), state.rule)
    assert state.matches.count() == 2


def test_merging(spark):
    """Chains of merges end at one row, and what referred to any of them refers to it."""
    from tessera.operators import rewriting
    from tessera.pattern import Pattern
    from tessera.rule import Rule
    from tessera.schema import Schema
    from tessera.world import graph_rows, make

    graph = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})
    w = make(spark, graph, graph_rows(6, [(1, 2), (2, 3), (5, 6), (4, 1)]))
    edge = Pattern(graph, {"a": "V", "b": "V", "e": "E"}, {("e", "src"): "a", ("e", "tgt"): "b"})
    loop = Pattern(graph, {"x": "V", "e": "E"}, {("e", "src"): "x", ("e", "tgt"): "x"})
    rule = Rule("shrink", edge, {"a": "x", "b": "x", "e": "e"}, loop)
    assert rule.merged == (("b", "a"),)
    after = rewriting.apply(rule, rewriting.legal(rule, w), w).world
    # 4 only stays, so 1, 2 and 3 become 4; 6 becomes 5
    assert sorted(r["part_id"] for r in after.table("V").collect()) == [4, 5]
    assert sorted((r["src"], r["tgt"]) for r in after.table("E").collect()) == [(4, 4), (4, 4), (4, 4), (5, 5)]
    circle = make(spark, graph, graph_rows(3, [(1, 2), (2, 3), (3, 1)]))
    assert [r["part_id"] for r in rewriting.apply(rule, rewriting.legal(rule, circle), circle).world.table("V").collect()] == [1]


def test_isomorphic(spark):
    from tessera.operators.isomorphism import isomorphic
    from tessera.schema import Schema
    from tessera.world import graph_rows, make

    graph = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})

    def cycles(*sizes):
        edges, at = [], 0
        for n in sizes:
            edges += [(at + i + 1, at + (i + 1) % n + 1) for i in range(n)]
            at += n
        return make(spark, graph, graph_rows(at, edges))

    # all rows look alike: only a search tells two triangles from a ring of six
    assert isomorphic(cycles(3, 3), cycles(3, 3)).first()["same"]
    assert not isomorphic(cycles(3, 3), cycles(6)).first()["same"]
    a, b = make(spark, graph, graph_rows(3, [(1, 2), (2, 3)])), make(spark, graph, graph_rows(3, [(3, 1), (1, 2)]))
    assert isomorphic(a, b).first()["same"]
    assert not isomorphic(a, make(spark, graph, graph_rows(3, [(1, 2), (1, 3)]))).first()["same"]
    assert isomorphic(make(spark, graph, {}), make(spark, graph, {})).first()["same"]
