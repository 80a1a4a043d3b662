"""Registered runs of schedules, each with the SQL that gives the same rows.

Suppliers and nations are worlds here, one for each region, so that a batch of worlds goes through each schedule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import agents
from tessera.game import Game, GameMigration
from tessera.operators import changes, matching
from tessera.operators.migration import Renaming
from tessera.pattern import Pattern, Threshold
from tessera.plans import runner
from tessera.plans import schedule as S
from tessera.plans.catalog import query
from tessera.rule import adding, deleting, identity
from tessera.schema import Schema
from tessera.world import World

SCHEMA = Schema(("nation", "supplier"), {"s_nationkey": ("supplier", "nation")}, {"n_name": ("nation", T.StringType()), "s_name": ("supplier", T.StringType()), "s_acctbal": ("supplier", T.DoubleType())})
NATION = Pattern(SCHEMA, {"n": "nation"})
SUPPLIER = Pattern(SCHEMA, {"s": "supplier"})
IN_NATION = Pattern(SCHEMA, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"})
#: Suppliers deep in debt are dropped.
DEBT = -500.0
DROP = deleting("drop", SUPPLIER, Pattern(SCHEMA), thresholds=(Threshold("s", "s_acctbal", "<", DEBT),))
FOUND = adding("found", NATION, Pattern(SCHEMA, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"}, {("s", "s_name"): "new"}))
LOOK = identity("look", SUPPLIER)
FIRST = {"p": agents.First()}

#: Suppliers with their worlds, for the SQL.
BASE = "WITH sup AS (SELECT n_regionkey::BIGINT AS world, s_suppkey::BIGINT AS s, s_nationkey::BIGINT AS n, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey), worlds AS (SELECT r_regionkey::BIGINT AS world FROM region), debt AS (SELECT world, count(s)::BIGINT AS k FROM worlds LEFT JOIN (SELECT * FROM sup WHERE s_acctbal < -500) USING (world) GROUP BY 1) "


def regions(spark: SparkSession, sf_dir: str) -> World:
    """A world for each region: its nations, and their suppliers."""
    r, n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier"))
    nation = n.select(F.col("n_regionkey").cast("long").alias("world_id"), F.col("n_nationkey").cast("long").alias("part_id"), "n_name")
    home = nation.select("world_id", F.col("part_id").alias("_n"))
    supplier = s.join(home, F.col("s_nationkey").cast("long") == F.col("_n")).select("world_id", F.col("s_suppkey").cast("long").alias("part_id"), F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_name", "s_acctbal")
    return World(SCHEMA, {"nation": nation, "supplier": supplier}, r.select(F.col("r_regionkey").cast("long").alias("world_id")), checked=True)


def looped(box) -> S.Schedule:
    """A box again and again, until it fails."""
    return S.schedule("loop", ["t"], ["i"], {"box": box, "m": S.Merge()}, "w = m(t, i)\ns, f = box(w)\nreturn s, f")


def once(box, outs: str = "s, f") -> S.Schedule:
    return S.schedule("once", [], ["i"], {"box": box}, f"{outs} = box(i)\nreturn {outs}")


def suppliers(w: World) -> DataFrame:
    return w.table("supplier").select(F.col("world_id").alias("world"), F.col("part_id").alias("s"))


def ends(r: runner.Result) -> DataFrame:
    return r.control.select(F.col("world_id").alias("world"), "exit_wire")


REST = BASE + "SELECT world, s FROM sup WHERE s_acctbal >= -500"


@query(REST)
def sched_native_loop(spark, sf_dir):
    """A rule without a player fires at its first match in each world, round and round."""
    return suppliers(runner.run(looped(S.RuleApp("drop", DROP)), regions(spark, sf_dir), {}).world)


@query(BASE + "SELECT world, t::BIGINT AS turn, CASE WHEN t <= k THEN 'drop' END AS action, CASE WHEN t <= k THEN k - t + 1 ELSE 0 END::BIGINT AS legal, t > k AS done, CASE WHEN t > k THEN 'clean' END AS winner FROM debt, range(1, 1000000) r(t) WHERE t <= k + 1")
def sched_experiences(spark, sf_dir):
    """A player's decisions up to the exit that ends the game."""
    r = runner.run(looped(S.PlayerRuleApp("drop", DROP, "p")), regions(spark, sf_dir), FIRST, win_conditions={"f": "clean"})
    return r.experiences.select(F.col("world_id").alias("world"), "turn", "action", "legal", "done", "winner")


@query(BASE + "SELECT world, t::BIGINT AS step, t <= k AS fired FROM debt, range(1, 1000000) r(t) WHERE t <= k + 1")
def sched_events(spark, sf_dir):
    """What was tried and what fired, step by step."""
    r = runner.run(looped(S.RuleApp("drop", DROP)), regions(spark, sf_dir), {})
    return r.events.select(F.col("world_id").alias("world"), "step", "fired")


@query(BASE + "SELECT worlds.world, 3::BIGINT AS turn, true AS done, count(s)::BIGINT + 3 AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_t_max(spark, sf_dir):
    """Turns run out: the decision that goes beyond the limit is the last."""
    r = runner.run(looped(S.PlayerRuleApp("found", FOUND, "p")), regions(spark, sf_dir), FIRST, t_max=2)
    return r.control.join(r.world.nparts("supplier"), "world_id").select(F.col("world_id").alias("world"), "turn", "done", "n")


@query(BASE + "SELECT worlds.world, true AS done, 'p' AS winner, count(s)::BIGINT + 2 AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_terminal(spark, sf_dir):
    """A game that is over as soon as a world has two new suppliers."""

    def terminal(w: World) -> DataFrame:
        new = F.count(F.when(F.col("s_name") == "new", 1))
        return w.table("supplier").groupBy("world_id").agg((new >= 2).alias("done"), F.lit("p").alias("winner"))

    w = regions(spark, sf_dir)
    r = Game(("p",), None, terminal, SCHEMA).run(looped(S.PlayerRuleApp("found", FOUND, "p")), w, FIRST)
    return r.control.join(r.world.nparts("supplier"), "world_id").select(F.col("world_id").alias("world"), "done", "winner", "n")


def customers(spark: SparkSession, sf_dir: str) -> World:
    """A world for each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("world_id"), F.lit(1).cast("long").alias("part_id"), "c_mktsegment")
    return World(Schema(("customer",), {}, {"c_mktsegment": ("customer", T.StringType())}), {"customer": c}, c.select("world_id"))


#: A draw in [0, 1) from seed, step, world and the box's name.
DRAW = "('0x' || substr(md5(concat_ws(':', {seed}, 1, c_custkey, '{name}')), 1, 13))::BIGINT / 4503599627370496"


@query(f"SELECT c_custkey::BIGINT AS world, CASE WHEN {DRAW.format(seed=3, name='c')} < 0.25 THEN 'a' ELSE 'b' END AS exit_wire FROM customer")
def sched_coin(spark, sf_dir):
    return ends(runner.run(once(S.Coin("c", 0.25), "a, b"), customers(spark, sf_dir), {}, seed=3))


@query(f"SELECT c_custkey::BIGINT AS world, CASE WHEN u < 1 THEN 'a' WHEN u < 3 THEN 'b' ELSE 'c' END AS exit_wire FROM (SELECT c_custkey, 4 * {DRAW.format(seed=5, name='s')} AS u FROM customer)")
def sched_split(spark, sf_dir):
    """One of several ways, by weight."""
    return ends(runner.run(once(S.Split("s", (1, 2, 1)), "a, b, c"), customers(spark, sf_dir), {}, seed=5))


@query("SELECT c_custkey::BIGINT AS world, 'm' AS exit_wire FROM customer")
def sched_merge(spark, sf_dir):
    """Ways that part and meet again."""
    s = S.schedule("s", [], ["i"], {"c": S.Coin("c", 0.5), "m": S.Merge(), "id": S.Weaken()}, "a, b = c(i)\nm = m(a, id(b))\nreturn m")
    return ends(runner.run(s, customers(spark, sf_dir), {}))


@query(BASE + "SELECT world, CASE WHEN k > 0 THEN 'yes' ELSE 'no' END AS exit_wire FROM debt")
def sched_query(spark, sf_dir):
    """A box that only looks: does a pattern occur? Here suppliers in debt, by a view of the worlds."""
    w = regions(spark, sf_dir)
    w = w.with_tables(supplier=w.table("supplier").where(F.col("s_acctbal") < DEBT))
    return ends(runner.run(once(S.Query("q", SUPPLIER), "yes, no"), w, {}))


@query(BASE + "SELECT worlds.world, least(count(s), 22)::BIGINT AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_while(spark, sf_dir):
    """A body that runs while a world has more than 22 suppliers."""
    shrink = S.While("w", S.RuleApp("any", deleting("any", SUPPLIER, Pattern(SCHEMA))), S.MoreThan("supplier", 22))
    r = runner.run(once(shrink, "o"), regions(spark, sf_dir), {})
    return r.world.nparts("supplier").select(F.col("world_id").alias("world"), "n")


@query(BASE + "SELECT world, k + 1 AS decisions, 'outer/loop' AS path, 'b' AS exit_wire FROM debt")
def sched_nested(spark, sf_dir):
    """A schedule with a loop as a box of another."""
    s = S.schedule("outer", [], ["i"], {"x": looped(S.PlayerRuleApp("drop", DROP, "p")), "w": S.Weaken()}, "a = x(i)\nb = w(a)\nreturn b")
    r = runner.run(s, regions(spark, sf_dir), FIRST)
    each = r.experiences.groupBy("world_id", F.array_join("schedule_path", "/").alias("path")).agg(F.count(F.lit(1)).alias("decisions"))
    return each.join(r.control, "world_id").select(F.col("world_id").alias("world"), "decisions", "path", "exit_wire")


@query(BASE + "SELECT 2 * world AS world, 's1' AS exit_wire FROM worlds UNION ALL SELECT 2 * world + 1, CASE WHEN k > 0 THEN 's2' ELSE 'f2' END FROM debt")
def sched_tensor(spark, sf_dir):
    """Two rules side by side, each with a copy of every world."""
    return ends(runner.run(S.tensor(S.RuleApp("found", FOUND), S.RuleApp("drop", DROP)), regions(spark, sf_dir), {}))


@query(BASE + "SELECT world, CASE WHEN k > 0 THEN 't' ELSE 'r' END AS exit_wire FROM debt")
def sched_then(spark, sf_dir):
    """A rule after a rule: worlds where the second fails leave by the wire of failures."""
    return ends(runner.run(S.then(S.RuleApp("found", FOUND), S.RuleApp("drop", DROP)), regions(spark, sf_dir), {}))


@query(BASE + "SELECT worlds.world, (count(s) + 2)::BIGINT AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_compose_tries(spark, sf_dir):
    """Schedules one after another, each passing worlds on whether its rule fires or not."""
    rule = S.RuleApp("found", FOUND)
    r = runner.run(S.then(S.then(S.tryrule(rule), S.tryrule(rule)), S.tryrule(S.RuleApp("none", deleting("none", SUPPLIER, Pattern(SCHEMA), thresholds=(Threshold("s", "s_acctbal", ">", 1e9),))))), regions(spark, sf_dir), {})
    return r.world.nparts("supplier").select(F.col("world_id").alias("world"), "n")


@query("SELECT r_regionkey::BIGINT AS world, (SELECT max(n_nationkey) + 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey)::BIGINT AS part_id, 'new' AS name FROM region r")
def sched_create(spark, sf_dir):
    """A box that adds rows to every world, whatever is there; ids go on from each world's highest."""
    box = S.create("more", Pattern(SCHEMA, {"n": "nation"}, {}, {("n", "n_name"): "new"}))
    w = runner.run(once(box), regions(spark, sf_dir), {}).world
    return w.table("nation").where("n_name = 'new'").select(F.col("world_id").alias("world"), "part_id", F.col("n_name").alias("name"))


@query(BASE + "SELECT worlds.world, (count(s) + 3)::BIGINT AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_interpret(spark, sf_dir):
    """A loop that would never end, stopped after three passes."""
    w = runner.interpret(looped(S.RuleApp("found", FOUND)), regions(spark, sf_dir), max_step=3)
    return w.nparts("supplier").select(F.col("world_id").alias("world"), "n")


# -- agent loops

EACH = Pattern(SCHEMA, {"a": "nation"})


def _each(box, at_once: bool = False) -> S.Schedule:
    return once(S.AgentLoop("each", EACH, box, at_once=at_once), "r")


@query(BASE + "SELECT n_nationkey::BIGINT AS nation, count(s)::BIGINT + 1 AS n FROM nation LEFT JOIN sup ON n = n_nationkey GROUP BY 1")
def agents_one_by_one(spark, sf_dir):
    """Every nation of a world is an agent, one after another, and founds a supplier."""
    r = runner.run(_each(S.PlayerRuleApp("found", FOUND, "p", in_hom={"a": "n"})), regions(spark, sf_dir), FIRST)
    return r.world.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT n_regionkey::BIGINT AS world, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS turn, n_nationkey::BIGINT AS nation, 1::BIGINT AS legal FROM nation")
def agents_take_turns(spark, sf_dir):
    """The decisions of agents one after another: a turn each, in the order of their rows, at their own row only."""
    r = runner.run(_each(S.PlayerRuleApp("found", FOUND, "p", in_hom={"a": "n"})), regions(spark, sf_dir), FIRST)
    return r.experiences.select(F.col("world_id").alias("world"), "turn", F.col("match")["n"].alias("nation"), "legal")


@query(BASE + "SELECT n_nationkey::BIGINT AS nation, count(s)::BIGINT + 1 AS n FROM nation LEFT JOIN sup ON n = n_nationkey GROUP BY 1")
def agents_at_once(spark, sf_dir):
    """The same by one search and one rewrite for all agents."""
    r = runner.run(_each(S.PlayerRuleApp("found", FOUND, "p", in_hom={"a": "n"}), at_once=True), regions(spark, sf_dir), FIRST)
    return r.world.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query(BASE + "SELECT world, s FROM (SELECT world, s, row_number() OVER (PARTITION BY n ORDER BY s) AS r FROM sup) WHERE r <> 2")
def agents_that_contend(spark, sf_dir):
    """Every supplier would drop the first other one of its nation. The first agent's choice stands, which is the
    second supplier; all others use a row that this choice holds."""
    pair = Pattern(SCHEMA, {"n": "nation", "a": "supplier", "b": "supplier"}, {("a", "s_nationkey"): "n", ("b", "s_nationkey"): "n"})
    drop = deleting("oust", pair, Pattern(SCHEMA, {"n": "nation", "a": "supplier"}, {("a", "s_nationkey"): "n"}), monic=True)
    loop = S.AgentLoop("each", Pattern(SCHEMA, {"x": "supplier"}), S.PlayerRuleApp("oust", drop, "p", in_hom={"x": "a"}), at_once=True)
    return suppliers(runner.run(once(loop, "r"), regions(spark, sf_dir), FIRST).world)


@query(BASE + "SELECT n AS nation, min(s)::BIGINT AS s FROM sup GROUP BY 1")
def pinned_agents(spark, sf_dir):
    """The choice of each nation among its suppliers; the search starts from the agents' rows."""
    w = regions(spark, sf_dir)
    pins = w.table("nation").select("world_id", F.col("part_id").alias("n"))
    found = matching.match(IN_NATION, w, pins=pins).withColumns({"passes": F.lit(False), "@n": F.col("n")})
    ctx = agents.Context(w, "p", 1, ("n", "s"), groups=("world_id", "@n"))
    return agents.First().choose(found, ctx).select(F.col("n").alias("nation"), "s")


# -- what a player is offered


@query(BASE + "SELECT worlds.world, count(s)::BIGINT + 1 AS legal, CAST(NULL AS VARCHAR) AS action, count(s)::BIGINT AS n FROM worlds LEFT JOIN sup USING (world) GROUP BY 1 HAVING count(s) > 0")
def sched_pass(spark, sf_dir):
    """Passing is offered beside the matches, and taken."""
    w = regions(spark, sf_dir)
    box = S.PlayerRuleApp("any", deleting("any", SUPPLIER, Pattern(SCHEMA)), "f", can_pass=True)
    r = runner.run(S.tryrule(box), w, {"f": agents.Function(lambda world, turn, rows: len(rows) - 1)})
    return r.experiences.where("legal > 0").join(r.world.nparts("supplier"), "world_id").select(F.col("world_id").alias("world"), "legal", "action", "n")


@query(BASE + "SELECT world, t::BIGINT AS turn, least(2, greatest(k - t + 1, 0))::BIGINT AS legal FROM debt, range(1, 1000000) r(t) WHERE t <= k + 1")
def sched_limit_and_cache(spark, sf_dir):
    """The first two matches of each world are offered, from matches that are kept and followed."""
    r = runner.run(looped(S.PlayerRuleApp("drop", DROP, "p", match_limit=2, use_cache=True)), regions(spark, sf_dir), FIRST)
    return r.experiences.select(F.col("world_id").alias("world"), "turn", "legal")


@query(BASE + "SELECT worlds.world, least(3, count(s))::BIGINT AS legal FROM worlds LEFT JOIN sup USING (world) GROUP BY 1")
def sched_take(spark, sf_dir):
    """A draw of matches, as many as a function of step and box says."""
    r = runner.run(S.tryrule(S.PlayerRuleApp("look", LOOK, "p", take=lambda step, box: 2 + step)), regions(spark, sf_dir), FIRST)
    return r.experiences.select(F.col("world_id").alias("world"), "legal")


@query(BASE + "SELECT world, min(s)::BIGINT AS s FROM sup WHERE s_acctbal > 0 GROUP BY 1")
def sched_view(spark, sf_dir):
    """A player that sees only suppliers with money."""
    box = S.PlayerRuleApp("look", LOOK, "p", view_fn=lambda w: w.with_tables(supplier=w.table("supplier").where("s_acctbal > 0")))
    r = runner.run(S.tryrule(box), regions(spark, sf_dir), FIRST)
    return r.experiences.where("action is not null").select(F.col("world_id").alias("world"), F.col("match")["s"].alias("s"))


@query(BASE + "SELECT world, max(s)::BIGINT AS s FROM sup GROUP BY 1")
def sched_matcher(spark, sf_dir):
    """A matcher of the caller's own in place of the search."""

    def last(rule, w: World) -> DataFrame:
        return w.table("supplier").groupBy("world_id").agg(F.max("part_id").alias("s"))

    r = runner.run(S.tryrule(S.PlayerRuleApp("look", LOOK, "p", fast_match_fn=last)), regions(spark, sf_dir), FIRST)
    return r.experiences.where("action is not null").select(F.col("world_id").alias("world"), F.col("match")["s"].alias("s"))


# -- what a run leaves behind


@query(BASE + "SELECT t::BIGINT AS step, worlds.world, (SELECT count(*) FROM sup WHERE sup.world = worlds.world)::BIGINT + t AS n FROM worlds, range(1, 4) r(t)")
def sched_snapshots(spark, sf_dir):
    """The tables after each step of a player."""
    r = runner.run(looped(S.PlayerRuleApp("found", FOUND, "p")), regions(spark, sf_dir), FIRST, t_max=2, snapshots=True)
    return reduce(DataFrame.unionByName, [t["supplier"].groupBy(F.col("world_id").alias("world")).agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step).cast("long")) for step, t in r.snapshots])


@query(BASE + "SELECT world, row_number() OVER (PARTITION BY world ORDER BY s)::BIGINT AS step, 'supplier' AS ob, s AS part_id, false AS added FROM sup WHERE s_acctbal < -500")
def sched_change_log(spark, sf_dir):
    """Rows that a run added and deleted, step by step."""
    r = runner.run(looped(S.RuleApp("drop", DROP)), regions(spark, sf_dir), {}, log_changes=True)
    log = r.changes if r.changes is not None else spark.createDataFrame([], changes.COLUMNS + ", step bigint")
    return changes.events(log).select(F.col("world_id").alias("world"), "step", "ob", "part_id", "added")


@query(BASE + ", gone AS (SELECT world, s, row_number() OVER (PARTITION BY world ORDER BY s)::BIGINT AS step FROM sup WHERE s_acctbal < -500) SELECT g.world, g.step, (SELECT count(*) FROM sup WHERE sup.world = g.world)::BIGINT - g.step AS n FROM gone g")
def sched_reconstructed(spark, sf_dir):
    """Steps that fired with the table as they left it, from events and snapshots."""
    from tessera.experience import reconstructed

    r = runner.run(looped(S.PlayerRuleApp("drop", DROP, "p")), regions(spark, sf_dir), FIRST, snapshots=True)
    return reconstructed(r.events, r.snapshots, "supplier").groupBy(F.col("world_id").alias("world"), "step").agg(F.count(F.lit(1)).alias("n"))


# -- schedules and games in other forms


@query(REST)
def sched_from_json(spark, sf_dir):
    """A game, its schedule and its worlds, written as JSON text and read again."""
    import json

    from tessera.sources import codec

    w = regions(spark, sf_dir)
    text = json.dumps({"schema": codec.schema_out(w.schema), "world": codec.world_out(w), "schedule": codec.box_out(looped(S.RuleApp("drop", DROP)))})
    d = json.loads(text)
    schema = codec.schema_in(d["schema"])
    return suppliers(runner.run(codec.box_in(schema, d["schedule"]), codec.world_in(spark, schema, d["world"]), {}).world)


@query(REST.replace("world, s FROM", "world, s AS vendor FROM"))
def sched_migrated(spark, sf_dir):
    """A schedule, a game and its worlds moved to a schema with other names."""
    f = Renaming(SCHEMA, {"supplier": "vendor"}, {"s_nationkey": "land"}, {"s_acctbal": "balance"})
    game = GameMigration(Game(("p",), None, None, SCHEMA), f.target, f)
    moved = f.schedule(looped(S.PlayerRuleApp("drop", DROP, "p")), {"p": "q"})
    r = game.game().run(moved, game.world(regions(spark, sf_dir)), {"q": agents.First()})
    return r.world.table("vendor").select(F.col("world_id").alias("world"), F.col("part_id").alias("vendor"))


@query("SELECT * FROM (VALUES (1, 'x', 'i', 'a,b'), (2, 'm', 'j', '_gstmp_2'), (3, 'y', '_gstmp_2', '_gstmp_1'), (4, 'm', 'a,b,_gstmp_1', 'c')) t(step, box, inputs, outputs)")
def sched_parsed(spark, sf_dir):
    """The steps of a body of the schedule language: several outputs, lists of inputs, calls within calls."""
    steps, _ = S.parse("a, b = x(i)\nc = m([a, b], y(m(j)))\nreturn c, a")
    return spark.createDataFrame([(i + 1, s.box, ",".join(s.inputs), ",".join(s.outputs)) for i, s in enumerate(steps)], "step int, box string, inputs string, outputs string")


@query("SELECT * FROM (VALUES ('in_t', 's0', 't', ''), ('in_i', 's0', 'i', ''), ('s0', 's1', 'w', ''), ('s1', 'in_t', 's', 'dashed'), ('s1', 'out_f', 'f', '')) t(a, b, wire, style)")
def sched_drawn(spark, sf_dir):
    """The edges of the drawing of a loop; the wire that leads back is dashed."""
    import re

    edge = re.compile(r'"(.+)" -> "(.+)" \[label="(.+?)"(?:, style=(\w+))?\];')
    found = [m.groups(default="") for m in map(edge.search, S.dot(looped(S.RuleApp("drop", DROP))).split("\n")) if m]
    return spark.createDataFrame(found, "a string, b string, wire string, style string")


@query("SELECT * FROM (VALUES ('no players', 'ValueError'), ('unknown part', 'ValueError'), ('twice', 'ValueError'), ('two players', 'a,b')) t(spec, said)")
def game_specs(spark, sf_dir):
    """Games from keywords, and the errors of bad ones."""

    def said(**spec) -> str:
        try:
            return ",".join(Game.from_spec(**spec).players)
        except ValueError as e:
            return type(e).__name__

    return spark.createDataFrame([("no players", said(terminal=None)), ("unknown part", said(players=["a"], colour=1)), ("twice", said(players=["a", "a"])), ("two players", said(players=["a", "b"]))], "spec string, said string")


@query("SELECT * FROM (VALUES ('player', 'drop'), ('player', 'found'), ('right', ''), ('right', 'n,s')) t(kind, name)")
def sched_walked(spark, sf_dir):
    """All players' boxes of a schedule and the right sides of its rules, nested ones included."""
    inner = looped(S.PlayerRuleApp("drop", DROP, "p"))
    x = S.schedule("o", [], ["i"], {"x": inner, "l": _each(S.PlayerRuleApp("found", FOUND, "p", in_hom={"a": "n"}))}, "a = x(i)\nb = l(a)\nreturn b")
    rows = [("player", b.name) for b in S.players(x)] + [("right", ",".join(p.elements)) for p in S.right_sides(x)]
    return spark.createDataFrame(rows, "kind string, name string")


@query(None)
def tictactoe_games(spark, sf_dir):
    """Two hundred games at random: how each ended, and after how many turns."""
    from tessera.games import tictactoe

    r = tictactoe.play(spark, 200, seed=7)
    return r.control.select("world_id", "turn", "done", "winner")
