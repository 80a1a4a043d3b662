"""Codecs, sources, migration, graphs, codes, zones, logs and measures."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import experience
from tessera.functions import encoding
from tessera.functions.numbering import numbered, reinforce_loss, softmax
from tessera.game import Game, GameMigration
from tessera.operators import changes, elements, migration, zones
from tessera.operators.conditions import forbid, require
from tessera.operators.matching import match
from tessera.pattern import Pattern, Threshold, Var
from tessera.plans import schedule as S
from tessera.rule import Delta, Rule, identity
from tessera.schema import Schema, reflect
from tessera.sources import codec, parquet
from tessera.world import graph_rows, make

SCHEMA = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")}, {"w": ("E", T.DoubleType()), "name": ("V", T.StringType()), "at": ("V", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))})


def world(spark):
    return make(spark, SCHEMA, {"V": [{"name": "a", "at": (1, 2)}, {"name": None}], "E": [{"src": 1, "tgt": 2, "w": 0.1}, {"src": 2, "tgt": None, "w": None}]})


def same(a, b):
    assert {o: [str(r) for r in rows] for o, rows in a.collected().items()} == {o: [str(r) for r in rows] for o, rows in b.collected().items()}


def full_rule():
    p = Pattern(SCHEMA, {"v": "V", "e": "E"}, {("e", "src"): "v"}, {("v", "name"): Var("n"), ("e", "w"): 0.5})
    return Rule("r", p, {"v": "v", "e": "e"}, p, ("E",), (forbid(p, monic=True), require(p, thresholds=(Threshold("e", "w", "<", 3),))), {("e", "w"): double}, (Threshold("e", "w", ">=", 0.25),), (Delta("e", "w", -1, 0, None),))


def double(of):
    return of("e.w") * 2


def view(w):
    return w


FUNCTIONS = {"double": double, "view": view}


def test_json_keeps_all(spark, tmp_path):
    rule = full_rule()
    assert codec.rule_in(SCHEMA, json.loads(json.dumps(codec.rule_out(rule, FUNCTIONS))), FUNCTIONS) == rule
    inner = S.schedule("in", ["t"], ["i"], {"p": S.PlayerRuleApp("p", rule, "a", {"x": "v"}, can_pass=True, match_limit=3, view_fn=view), "m": S.Merge()}, "w = m(t, i)\na, b = p(w)\nreturn a, b")
    boxes = {"s": inner, "c": S.Coin("c", 0.3), "l": S.AgentLoop("l", Pattern(SCHEMA, {"x": "V"}), S.RuleApp("n", rule)), "q": S.Query("q", rule.left), "k": S.Split("k", (1, 2)), "id": S.Weaken(), "w": S.While("w", S.RuleApp("n", rule), view)}
    s = S.schedule("out", [], ["i"], boxes, "a = s(i)\nb, c = c(a)\nd = l(b)\ne, f = q(d)\ng, h = k(e)\nj = id(g)\nu = w(j)\nreturn u, c, f, h")
    path = str(tmp_path / "game.json")
    codec.write_game(path, Game(("a", "b"), win_conditions={"u": "a", "c": None}), s, world(spark), FUNCTIONS)
    game, read, start = codec.read_game(spark, path, FUNCTIONS)
    assert game.players == ("a", "b") and game.win_conditions == {"u": "a", "c": None} and read == s
    same(start, world(spark))
    assert game.initial(spark) is start
    with pytest.raises(ValueError):
        codec.rule_out(rule)
    with pytest.raises(ValueError):
        codec.box_in(SCHEMA, {"kind": "what", "name": "x"})


def test_plain_json_worlds(spark):
    d = {"V": {"_n": 2, "name": [":a", "b"]}, "E": {"_n": 2, "src": [1, 2], "tgt": [2, 0], "w": ["0.5", 2]}}
    w = codec.world_in(spark, SCHEMA, d)
    rows = w.collected()
    assert [r["name"] for r in rows["V"]] == ["a", "b"] and [(r["src"], r["tgt"], r["w"]) for r in rows["E"]] == [(1, 2, 0.5), (2, None, 2.0)]


def test_files(spark, tmp_path):
    parquet.write(world(spark), str(tmp_path / "w"))
    same(parquet.read(spark, SCHEMA, str(tmp_path / "w")), world(spark))


def test_schema():
    assert SCHEMA.load_order() == ["V", "E"]
    assert Schema(("A", "B"), {"f": ("A", "B"), "g": ("B", "A")}).load_order() == ["A", "B"]
    assert codec.schema_in(codec.schema_out(SCHEMA)) == SCHEMA
    with pytest.raises(ValueError):
        SCHEMA.extend(attrs={"src": ("V", T.LongType())})


def test_reflect(spark):
    w = world(spark)
    assert reflect(w.tables, SCHEMA.homs).attrs.keys() == SCHEMA.attrs.keys()


def test_dangling_keys(spark):
    w = make(spark, SCHEMA, {"V": [{}], "E": [{"src": 1, "tgt": 9, "w": 1.0}]})
    assert [(r["hom"], r["part_id"]) for r in w.dangling().collect()] == [("tgt", 1)]
    assert w.mended().table("E").first()["tgt"] is None and w.mended().table("E").first()["src"] == 1


def test_renaming_twice_is_nothing(spark):
    w = world(spark)
    there = migration.Renaming(SCHEMA, {"V": "Node", "E": "Arc"}, {"src": "from"}, {"name": "label"})
    back = migration.Renaming(there.target, {"Node": "V", "Arc": "E"}, {"from": "src"}, {"label": "name"})
    assert back.target == SCHEMA
    same(back.world(there.world(w)), w)
    assert back.rule(there.rule(full_rule())) == full_rule()
    box = S.PlayerRuleApp("p", full_rule(), "a", match_limit=2, can_pass=True)
    moved = there.schedule(box, {"a": "b"})
    assert (moved.player, moved.match_limit, moved.can_pass) == ("b", 2, True)
    assert match(there.pattern(Pattern(SCHEMA, {"v": "V", "e": "E"}, {("e", "src"): "v"})), there.world(w)).count() == 2


def test_inclusion(spark):
    larger = SCHEMA.extend(["X"], {"xv": ("X", "V")}, {"age": ("V", T.LongType())})
    w = GameMigration(Game(("a",), world), larger).world(world(spark))
    assert w.table("X").count() == 0 and w.table("V").first()["age"] is None
    assert GameMigration(Game(("a",), world), larger).game().initial(spark).table("X").count() == 0


def test_graphs(spark):
    w = world(spark)
    assert elements.nodes(w, ["w"]).where("ob = 'E' and part_id = 1").first()["feat"] == pytest.approx([0.1])
    assert elements.nodes(w, ["w"], one_hot=True).where("ob = 'V' and part_id = 1").first()["feat"] == [1.0, 0.0, 0.0]
    assert elements.edges(w).count() == 3 and elements.edges(w, ("src",)).count() == 5
    broken = make(spark, SCHEMA, {"V": [{}], "E": [{"src": 1, "tgt": 9}]})
    assert elements.live(elements.edges(broken), broken).count() == 1
    n, e = elements.positions(w)
    assert sorted(r["index"] for r in n.collect()) == [0, 1, 2, 3] and e.count() == 3


def test_codes(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, "a", 3), (3, "b", None)], "i bigint, s string, n bigint")
    ranks, names = encoding.ordinal(df, "n"), encoding.nominal(df, "s", ["i"])
    assert {r["value"]: r["code"] for r in ranks.collect()} == {3: 1, 5: 2}
    assert {r["value"]: r["code"] for r in names.collect()} == {"b": 1, "a": 2}
    coded = encoding.encode(df, "n", ranks)
    assert [r["n_code"] for r in coded.orderBy("i").collect()] == [2, 1, 0]
    assert [r["back"] for r in encoding.decode(coded, "n_code", ranks, "back").orderBy("i").collect()] == [5, 3, None]
    more = spark.createDataFrame([(4,), (5,)], "value bigint")
    assert {r["value"]: r["code"] for r in encoding.extended(ranks, more, True).collect()} == {3: 1, 4: 2, 5: 3}
    assert {r["value"]: r["code"] for r in encoding.extended(names, spark.createDataFrame([("c",)], "value string"), False).collect()} == {"b": 1, "a": 2, "c": 3}
    d = encoding.bins([10, 20])
    got = spark.createDataFrame([(5,), (10,), (25,), (None,)], "v bigint").select(d.encode(F.col("v")).alias("c")).select("c", d.decode(F.col("c")).alias("v")).collect()
    assert [r["c"] for r in got] == [1, 2, 3, 0] and got[3]["v"] is None


def test_zones(spark):
    s = Schema(("V",))
    w = make(spark, s, {"V": [{}, {}, {}, {}]})
    z = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 0)], "world_id bigint, part_id bigint, zone bigint")
    got = zones.zoned(Pattern(s, {"a": "V", "b": "V"}), zones.assigned(w, {"V": z}), ["V"], monic=True)
    assert sorted((r["a"], r["b"], r["zone"]) for r in got.where("a < b").collect()) == [(1, 2, 1), (1, 4, 1), (2, 4, 1), (3, 4, 2)]


def test_changes(spark):
    a = make(spark, SCHEMA, graph_rows(3, [(1, 2)]))
    b = a.with_tables(V=a.table("V").where("part_id <> 3").withColumn("name", F.when(F.col("part_id") == 1, "x")))
    log = changes.between(a, b)
    assert sorted((r["ob"], r["part_id"], r["change"]) for r in log.collect()) == [("V", 1, "update"), ("V", 3, "delete")]
    assert changes.events(log.withColumn("step", F.lit(1))).count() == 3
    assert changes.replayed(a.table("V"), log, b.table("V"), "V").count() == 2
    assert changes.between(a, a).count() == 0


def trajectory(spark):
    schema = "world_id bigint, step bigint, player string, turn bigint, action string, done boolean, winner string"
    return spark.createDataFrame([(0, 1, "alice", 1, "move", False, None), (0, 2, "bob", 2, None, True, "alice"), (1, 3, "alice", 1, "move", True, None)], schema)


def test_measures(spark):
    t = trajectory(spark)
    assert experience.win_rate(t, "alice").first()[0] == 0.5 and experience.win_rate(t, "bob").first()[0] == 0.0 and experience.win_rate(t.limit(0), "x").first()[0] == 0.0
    assert {r["world_id"]: r["length"] for r in experience.episode_length(t).collect()} == {0: 2, 1: 1}
    assert {r["action"]: r["n"] for r in experience.action_counts(t).collect()} == {"move": 2, "pass": 1}
    row = experience.summary(t).first()
    assert (row["episodes"], row["ends"], row["mean_length"]) == (2, {"alice": 1, "draw": 1}, 1.5)


def test_arrow(spark, tmp_path):
    path = str(tmp_path / "t.arrow")
    experience.write_arrow(trajectory(spark), path)
    got = experience.read_arrow(spark, path)
    assert [tuple(r) for r in got.collect()] == [("alice", 1, "move", False, "nothing"), ("bob", 2, "nothing", True, "alice"), ("alice", 1, "move", True, "nothing")]
    assert experience.restored(got).where("winner is null").count() == 2


def test_numbers(spark):
    df = spark.createDataFrame([(w, k) for w in range(3) for k in range(50)], "world_id bigint, k bigint")
    rows = numbered(df, ["k"]).collect()
    for w in range(3):
        assert sorted(r["n"] for r in rows if r["world_id"] == w) == list(range(50))
    soft = softmax(df.withColumn("x", F.col("k") * 1.0), "x", ["world_id"], "p")
    assert soft.groupBy().agg(F.sum("p")).first()[0] == pytest.approx(3.0)
    loss = reinforce_loss(spark.createDataFrame([(0, -1.0, 2.0), (0, -3.0, 0.0)], "w bigint, lp double, r double"), "lp", "r", ["w"])
    assert loss.first()["loss"] == pytest.approx(1.0)


def test_look_rule_is_whole():
    assert identity("x", Pattern(SCHEMA)).deleted == ()


def test_ranks(spark):
    from tessera.functions.numbering import ranked

    df = spark.createDataFrame([(i * 7 % 101, f"x{i}") for i in range(101)], "a bigint, b string").repartition(5)
    assert sorted((r["a"], r["at"]) for r in ranked(df, ["a"], "at").collect()) == [(i, i + 1) for i in range(101)]
    assert ranked(df.limit(0), ["a"], "at").count() == 0


def test_zones_with_global_rows(spark):
    from tessera.operators import zones
    from tessera.pattern import Pattern
    from tessera.schema import Schema
    from tessera.world import make

    w = make(spark, Schema(("V",)), {"V": [{} for _ in range(6)]})
    own = {1: 1, 2: 1, 3: 2, 4: 2, 5: 0}
    z = zones.assigned(w, {"V": spark.createDataFrame([(0, p, v) for p, v in own.items()], "world_id bigint, part_id bigint, zone bigint")})
    for names in ("ab", "abc"):
        found = zones.zoned(Pattern(z.schema, {e: "V" for e in names}), z, ["V"])
        want = []
        import itertools

        for pick in itertools.product(range(1, 7), repeat=len(names)):
            there = {own.get(p, 0) for p in pick} - {0}
            if len(there) < 2:
                want.append((*pick, next(iter(there), None)))
        assert sorted(map(str, ((*(r[e] for e in names), r["zone"]) for r in found.collect()))) == sorted(map(str, want))


def test_groups_come_whole_to_agents(spark):
    """Groups that span Arrow batches, and batches with many groups."""
    from pyspark.sql import functions as F

    from tessera import agents
    from tessera.schema import Schema
    from tessera.world import make

    w = make(spark, Schema(("V",)), {})
    sizes = [1, 1, 300, 2, 50, 1]
    rows = [(g, i, False) for g, n in enumerate(sizes) for i in range(n)]
    found = spark.createDataFrame(rows, "world_id bigint, v bigint, passes boolean").repartition(3)
    ctx = agents.Context(w, "p", 1, ("v",), turns=spark.createDataFrame([(g, g * 10) for g in range(6)], "world_id bigint, turn bigint"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        last = agents.Function(lambda world, turn, rows: None if len(rows) == 2 else len(rows) - 1 if turn == world * 10 else 0).choose(found, ctx)
        assert sorted((r["world_id"], r["v"]) for r in last.collect()) == [(g, n - 1) for g, n in enumerate(sizes) if n != 2]
        middle = agents.Vectorised(lambda m, turn: len(m) // 2 + 1).choose(found, ctx)
        assert sorted((r["world_id"], r["v"]) for r in middle.collect()) == [(g, n // 2) for g, n in enumerate(sizes)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert agents.Batched(lambda m, edges, turns: edges[:-1] * 0).choose(found.where(F.lit(False)), ctx).count() == 0
