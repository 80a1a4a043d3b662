"""Queries over the driver's tables, each with the SQL that gives the same rows.

The star schema is one world: tables are its obs, foreign keys its homs. Queries give natural keys, and cast counts to
BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import agents, experience
from tessera.functions import encoding
from tessera.functions.numbering import chosen_of, softmax
from tessera.operators import changes, conditions, elements, incremental, matching, migration, rewriting, zones
from tessera.operators.matching import match, tick
from tessera.pattern import Pattern, Threshold, Var
from tessera.rule import Delta, Rule, adding, deleting, identity
from tessera.sources.parquet import star_world
from tessera.world import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _p(w: World, elements_: dict, homs: dict | None = None, attrs: dict | None = None) -> Pattern:
    return Pattern(w.schema, elements_, homs or {}, attrs or {})


def _ids(df: DataFrame, **names: str) -> DataFrame:
    """Elements under the names of natural keys."""
    return df.select(*[tick(e).cast("long").alias(n) for e, n in names.items()])


# -- matching

CHAIN = {("n", "n_regionkey"): "r", ("c", "c_nationkey"): "n"}


@query("SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n, c_custkey::BIGINT AS c FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def match_path3(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer"])
    return _ids(match(_p(w, {"r": "region", "n": "nation", "c": "customer"}, CHAIN), w), r="r", n="n", c="c")


def triangle(w: World) -> Pattern:
    return _p(w, {"n": "nation", "c": "customer", "o": "orders", "l": "lineitem", "s": "supplier"}, {("c", "c_nationkey"): "n", ("o", "o_custkey"): "c", ("l", "l_orderkey"): "o", ("l", "l_suppkey"): "s", ("s", "s_nationkey"): "n"})


@query("SELECT n_nationkey::BIGINT AS n, c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o, s_suppkey::BIGINT AS s, count(*)::BIGINT AS lines FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = n_nationkey GROUP BY ALL")
def match_triangle_same_nation(spark, sf_dir):
    """Cycles of nation, customer, order, line and supplier that close in one nation."""
    w = star_world(spark, sf_dir)
    found = match(triangle(w), w)
    return found.groupBy(*[F.col(e).alias(e) for e in ("n", "c", "o", "s")]).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT s_nationkey::BIGINT AS nation, c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o, s_suppkey::BIGINT AS s, count(*)::BIGINT AS lines FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY ALL")
def match_shared_variable(spark, sf_dir):
    """The same cycle by a shared attribute: the customer's and the supplier's nation as one variable."""
    from tessera.sources.parquet import TABLE_HOMS, TABLE_KEYS, from_tables

    obs = ["customer", "orders", "lineitem", "supplier"]
    tables = {o: (spark.read.parquet(f"{sf_dir}/{o}.parquet"), TABLE_KEYS[o]) for o in obs}
    w = from_tables(tables, {h: ab for h, ab in TABLE_HOMS.items() if set(ab) <= set(obs)}, checked=True)
    p = _p(w, {"c": "customer", "o": "orders", "l": "lineitem", "s": "supplier"}, {("o", "o_custkey"): "c", ("l", "l_orderkey"): "o", ("l", "l_suppkey"): "s"}, {("c", "c_nationkey"): Var("nation"), ("s", "s_nationkey"): Var("nation")})
    return match(p, w).groupBy(F.col("`?nation`").cast("long").alias("nation"), "c", "o", "s").agg(F.count(F.lit(1)).alias("lines"))


def _supplier_pairs(w: World) -> Pattern:
    return _p(w, {"n": "nation", "a": "supplier", "b": "supplier"}, {("a", "s_nationkey"): "n", ("b", "s_nationkey"): "n"})


@query("SELECT a.s_nationkey::BIGINT AS n, a.s_suppkey::BIGINT AS a, b.s_suppkey::BIGINT AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def match_monic_supplier_pairs(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    return _ids(match(_supplier_pairs(w), w, monic=True), n="n", a="a", b="b")


@query("SELECT a.s_nationkey::BIGINT AS n, a.s_suppkey::BIGINT AS a, b.s_suppkey::BIGINT AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def match_nonmonic_supplier_pairs(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    return _ids(match(_supplier_pairs(w), w), n="n", a="a", b="b")


@query("SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b, s.s_suppkey::BIGINT AS s, t.s_suppkey::BIGINT AS t FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN supplier s ON s.s_nationkey = a.n_nationkey JOIN supplier t ON t.s_nationkey = b.n_nationkey")
def match_componentwise_monic(spark, sf_dir):
    """Nations must differ; suppliers need not."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    p = _p(w, {"r": "region", "a": "nation", "b": "nation", "s": "supplier", "t": "supplier"}, {("a", "n_regionkey"): "r", ("b", "n_regionkey"): "r", ("s", "s_nationkey"): "a", ("t", "s_nationkey"): "b"})
    return _ids(match(p, w, monic=["nation"]), a="a", b="b", s="s", t="t")


@query("SELECT o_orderkey::BIGINT AS o, c_custkey::BIGINT AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'")
def match_constant(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    p = _p(w, {"o": "orders", "c": "customer"}, {("o", "o_custkey"): "c"}, {("o", "o_orderstatus"): "P", ("c", "c_mktsegment"): "BUILDING"})
    return _ids(match(p, w), o="o", c="c")


def _threshold(op: str, sql: str):
    def run(spark, sf_dir):
        w = star_world(spark, sf_dir, ["part"])
        return _ids(match(_p(w, {"p": "part"}), w, thresholds=[Threshold("p", "p_size", op, 10)]), p="p")

    name = f"match_threshold_{sql}"
    run.__name__ = name
    query(f"SELECT p_partkey::BIGINT AS p FROM part WHERE p_size {op} 10")(run)


for _op, _name in (("<=", "leq"), ("<", "lt"), (">=", "geq"), (">", "gt")):
    _threshold(_op, _name)


@query("SELECT n_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey = 7")
def match_pinned(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    return _ids(match(_p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"}), w, pins={"n": 7}), n="n", s="s")


@query("SELECT n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 0 AND r_regionkey = 1 AND n_regionkey <> 1")
def match_inconsistent_pin(spark, sf_dir):
    """Nation 0 pinned to a region that isn't its own: nothing."""
    w = star_world(spark, sf_dir, ["region", "nation"])
    own = w.table("nation").where("part_id = 0").first()["n_regionkey"]
    return _ids(match(_p(w, {"n": "nation", "r": "region"}, {("n", "n_regionkey"): "r"}), w, pins={"n": 0, "r": own + 1}), n="n", r="r")


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def match_joint_pins(spark, sf_dir):
    """Pins as a table: matches of the customers of a region, the search starting from them."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    there = match(_p(w, {"c": "customer", "n": "nation", "r": "region"}, {("c", "c_nationkey"): "n", ("n", "n_regionkey"): "r"}), w, pins={"r": 1})
    pins = there.select("world_id", "c")
    return _ids(match(_p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"}), w, pins=pins), c="c", o="o")


@query("SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region CROSS JOIN nation")
def match_cross_product(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation"])
    return _ids(match(_p(w, {"r": "region", "n": "nation"}), w), r="r", n="n")


@query("SELECT 0::BIGINT AS world_id")
def match_empty_pattern(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region"])
    return match(_p(w, {}), w).select(F.col("world_id").cast("long").alias("world_id"))


@query("SELECT c_custkey::BIGINT AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def match_fog_of_war(spark, sf_dir):
    """Only region 2 is in sight."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer"])

    def view(x: World) -> World:
        return x.with_tables(nation=x.table("nation").where("n_regionkey = 2"))

    return _ids(match(_p(w, {"c": "customer", "n": "nation"}, {("c", "c_nationkey"): "n"}), w, view=view, keep_joins=True), c="c")


# -- limits and choices


def _orders(w: World) -> Pattern:
    return _p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"})


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY 1, 2 LIMIT 1")
def choose_first(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    return _ids(match(_orders(w), w, limit=1), c="c", o="o")


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY 1, 2 LIMIT 25")
def match_limit_n(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    return _ids(match(_orders(w), w, limit=25), c="c", o="o")


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY o_totalprice DESC, 1, 2 LIMIT 1")
def argmax_choice(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    found = match(_orders(w), w, extra={"o": ["o_totalprice"]}).withColumn("passes", F.lit(False))
    ctx = agents.Context(w, "p", 1, ("c", "o"))
    return _ids(agents.ArgMax(lambda df, _: F.col("`o.o_totalprice`")).choose(found, ctx), c="c", o="o")


@query("SELECT n_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def take_n_all(spark, sf_dir):
    """A sample as large as the whole set."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    p = _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"})
    return _ids(match(p, w, take=10_000_000, seed=3, keep_joins=True), n="n", s="s")


@query("SELECT least(100, count(*))::BIGINT AS taken, least(100, count(*))::BIGINT AS distinct_taken, least(100, count(*))::BIGINT AS legal, true AS seeds_differ FROM orders")
def take_n_some(spark, sf_dir):
    """A hundred of the matches: how many there are, are distinct and are matches, and whether another seed gives others."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    taken, other = match(_orders(w), w, take=100, seed=5), match(_orders(w), w, take=100, seed=6)
    counted = taken.agg(F.count(F.lit(1)).alias("taken"), F.countDistinct("c", "o").alias("distinct_taken"))
    real = taken.join(w.table("orders").select(F.col("part_id").alias("o"), F.col("o_custkey").alias("c")), ["o", "c"], "left_semi").agg(F.count(F.lit(1)).alias("legal"))
    differ = taken.join(other, ["c", "o"], "left_anti").agg((F.count(F.lit(1)) > 0).alias("seeds_differ"))
    return counted.crossJoin(real).crossJoin(differ)


@query("SELECT count(*)::BIGINT AS taken, true AS whole FROM orders")
def take_n_many(spark, sf_dir):
    """A sample of more than a task should order, through lots: here as many as there are."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    found = match(_orders(w), w)
    taken = matching.sample(found, _orders(w), 10_000_000, 3)
    return taken.agg(F.count(F.lit(1)).alias("taken")).crossJoin(found.join(taken, ["c", "o"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("whole")))


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r = 1")
def agents_best_order(spark, sf_dir):
    """Every customer is an agent and picks its dearest order, all at once."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    found = match(_orders(w), w, extra={"o": ["o_totalprice"]}).withColumns({"passes": F.lit(False), "@c": F.col("c")})
    ctx = agents.Context(w, "p", 1, ("c", "o"), groups=("world_id", "@c"))
    return _ids(agents.ArgMax(lambda df, _: F.col("`o.o_totalprice`")).choose(found, ctx), c="c", o="o")


@query("SELECT n, s, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY n), 9) AS p FROM (SELECT s_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s, s_acctbal / 1000 AS x, max(s_acctbal / 1000) OVER (PARTITION BY s_nationkey) AS m FROM supplier)")
def softmax_scores(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    p = _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"})
    df = match(p, w, extra={"s": ["s_acctbal"]}).withColumn("x", F.col("`s.s_acctbal`") / 1000)
    return softmax(df, "x", ["n"]).select("n", "s", F.round("p", 9).alias("p"))


# -- conditions


@query("SELECT c_custkey::BIGINT AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def nac_no_order_status_p(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    left = _p(w, {"c": "customer"})
    nac = conditions.forbid(_p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"}, {("o", "o_orderstatus"): "P"}))
    return _ids(conditions.satisfied(match(left, w), left, w, [nac]), c="c")


@query("SELECT c_custkey::BIGINT AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def nac_two_new_elements(spark, sf_dir):
    w = star_world(spark, sf_dir)
    left = _p(w, {"c": "customer"})
    nac = conditions.forbid(_p(w, {"c": "customer", "o": "orders", "l": "lineitem"}, {("o", "o_custkey"): "c", ("l", "l_orderkey"): "o"}, {("l", "l_returnflag"): "R"}))
    return _ids(conditions.satisfied(match(left, w), left, w, [nac]), c="c")


URGENT = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


@query(f"SELECT c_custkey::BIGINT AS c FROM customer WHERE {URGENT}")
def pac_urgent_order(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    left = _p(w, {"c": "customer"})
    pac = conditions.require(_p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"}, {("o", "o_orderpriority"): "1-URGENT"}))
    return _ids(conditions.satisfied(match(left, w), left, w, [pac]), c="c")


@query(f"SELECT c_custkey::BIGINT AS c FROM customer WHERE {URGENT} AND NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def pac_and_nac(spark, sf_dir):
    w = star_world(spark, sf_dir)
    left = _p(w, {"c": "customer"})
    pac = conditions.require(_p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"}, {("o", "o_orderpriority"): "1-URGENT"}))
    nac = conditions.forbid(_p(w, {"c": "customer", "o": "orders", "l": "lineitem"}, {("o", "o_custkey"): "c", ("l", "l_orderkey"): "o"}, {("l", "l_returnflag"): "R"}))
    return _ids(conditions.satisfied(match(left, w), left, w, [pac, nac]), c="c")


@query("SELECT o_orderkey::BIGINT AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def dangling_free_orders(spark, sf_dir):
    """Orders that may be deleted: no line refers to them."""
    w = star_world(spark, sf_dir)
    left = _p(w, {"o": "orders"})
    return _ids(conditions.undangling(match(left, w), left, w, ["o"]), o="o")


@query("SELECT l_orderkey::BIGINT AS o FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def dangling_delete_order_with_line(spark, sf_dir):
    """Orders that may be deleted with a line: it is their only one."""
    w = star_world(spark, sf_dir)
    left = _p(w, {"o": "orders", "l": "lineitem"}, {("l", "l_orderkey"): "o"})
    return _ids(conditions.undangling(match(left, w), left, w, ["o", "l"]), o="o")


# -- rewriting


@query("SELECT o_orderkey::BIGINT AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rewrite_delete(spark, sf_dir):
    """Orders after all that no line refers to are deleted."""
    w = star_world(spark, sf_dir)
    rule = deleting("drop", _p(w, {"o": "orders"}), _p(w, {}))
    return rewriting.apply(rule, rewriting.legal(rule, w), w).world.table("orders").select(F.col("o_orderkey").cast("long").alias("o"))


@query("SELECT n_nationkey::BIGINT AS nation, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'new' FROM nation")
def rewrite_add(spark, sf_dir):
    """A new supplier in each nation."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    rule = adding("found", _p(w, {"n": "nation"}), _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"}, {("s", "s_name"): "new"}))
    after = rewriting.apply(rule, rewriting.legal(rule, w), w).world
    return after.table("supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_name").alias("name"))


@query("SELECT c_custkey::BIGINT AS c, CASE WHEN c_nationkey = 3 THEN 4 ELSE c_nationkey END::BIGINT AS n FROM customer")
def rewrite_update_fk(spark, sf_dir):
    """Customers of nation 3 move to nation 4."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer"])
    both = {"c": "customer", "a": "nation", "b": "nation"}
    rule = Rule("move", _p(w, both, {("c", "c_nationkey"): "a"}), {e: e for e in both}, _p(w, both, {("c", "c_nationkey"): "b"}))
    found = rewriting.legal(rule, w, pins={"a": 3, "b": 4})
    return rewriting.apply(rule, found, w).world.table("customer").select(F.col("c_custkey").cast("long").alias("c"), F.col("c_nationkey").cast("long").alias("n"))


@query("SELECT p_partkey::BIGINT AS p, CASE WHEN p_size >= 25 THEN ceil(p_size / 2.0) ELSE p_size END::BIGINT AS size FROM part")
def rewrite_expr(spark, sf_dir):
    """Sizes from 25 up are halved, by an expression of the matched value."""
    w = star_world(spark, sf_dir, ["part"])
    p = _p(w, {"p": "part"})
    rule = Rule("halve", p, {"p": "p"}, p, thresholds=(Threshold("p", "p_size", ">=", 25),), expressions={("p", "p_size"): lambda of: F.ceil(of("p.p_size") / 2)})
    return rewriting.apply(rule, rewriting.legal(rule, w), w).world.table("part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("size"))


@query("SELECT p_partkey::BIGINT AS p, greatest(p_size - 10, 1)::BIGINT AS size FROM part")
def rewrite_delta_clamped(spark, sf_dir):
    w = star_world(spark, sf_dir, ["part"])
    rule = identity("shrink", _p(w, {"p": "part"}), deltas=(Delta("p", "p_size", -10, low=1),))
    return rewriting.apply(rule, rewriting.legal(rule, w), w).world.table("part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("size"))


GONE = "c_nationkey <> 5"


@query(f"SELECT 'nation' AS ob, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE {GONE} UNION ALL SELECT 'orders', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {GONE} UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey <> 5 UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE {GONE} AND s_nationkey <> 5")
def spo_cascade_delete(spark, sf_dir):
    """Nation 5 and all that refers to it, however far."""
    w = star_world(spark, sf_dir)
    after = rewriting.cascade(w, {"nation": w.table("nation").where("part_id = 5").select("world_id", "part_id")})
    parts = [after.table(o).select(F.lit(o).alias("ob"), F.col("l_orderkey" if o == "lineitem" else "part_id").alias("key")) for o in ("nation", "customer", "orders", "supplier", "lineitem")]
    return reduce(DataFrame.unionByName, parts)


# -- following changes


@query("SELECT n_nationkey::BIGINT AS n, s_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey <> 2 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_regionkey = 1")
def incremental_equals_fresh(spark, sf_dir):
    """Matches of suppliers in nations, kept while suppliers are added and those of nation 2 deleted."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    p = _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"}, {("s", "s_name"): Var("name")})
    look = identity("look", p)
    add = adding("found", _p(w, {"n": "nation", "r": "region"}, {("n", "n_regionkey"): "r"}), _p(w, {"n": "nation", "r": "region", "s": "supplier"}, {("n", "n_regionkey"): "r", ("s", "s_nationkey"): "n"}, {("s", "s_name"): "new"}))
    drop = deleting("drop", p, _p(w, {"n": "nation"}))
    cache = incremental.MatchCache(look, match(p, w))
    one = rewriting.apply(drop, rewriting.legal(drop, w, pins={"n": 2}), w)
    cache = cache.updated(w, one)
    two = rewriting.apply(add, rewriting.legal(add, one.world, pins={"r": 1}), one.world)
    cache = cache.updated(one.world, two)
    return cache.matches.select(F.col("n").cast("long").alias("n"), F.col("`?name`").alias("name"))


@query("SELECT 'part' AS ob, p_partkey::BIGINT AS part_id, CASE WHEN p_size > 45 THEN 'delete' ELSE 'update' END AS change FROM part WHERE p_size > 45 OR p_size > 1")
def cdc_between_snapshots(spark, sf_dir):
    """What two rules log, one that deletes large parts and one that shrinks the others."""
    w = star_world(spark, sf_dir, ["part"])
    p = _p(w, {"p": "part"})
    drop = deleting("drop", p, _p(w, {}), thresholds=(Threshold("p", "p_size", ">", 45),))
    shrink = identity("shrink", p, deltas=(Delta("p", "p_size", -1, low=1),))
    one = rewriting.apply(drop, rewriting.legal(drop, w), w).world
    two = rewriting.apply(shrink, rewriting.legal(shrink, one), one).world
    return changes.between(w, two).select("ob", "part_id", "change")


# -- zones, migration, graphs, codes


def _zones(w: World) -> DataFrame:
    """A zone for each supplier: its region's number, from 1."""
    nation = w.table("nation").select(F.col("part_id").alias("_n"), (F.col("n_regionkey") + 1).alias("zone"))
    return w.table("supplier").join(nation, F.col("s_nationkey") == F.col("_n")).select("world_id", "part_id", "zone")


@query("SELECT a.s_suppkey::BIGINT AS a, b.s_suppkey::BIGINT AS b, m.n_regionkey::BIGINT + 1 AS zone FROM supplier a JOIN nation m ON a.s_nationkey = m.n_nationkey JOIN supplier b ON a.s_suppkey <> b.s_suppkey JOIN nation n ON b.s_nationkey = n.n_nationkey AND m.n_regionkey = n.n_regionkey")
def zone_local_pairs(spark, sf_dir):
    """Pairs of suppliers of one region, regions being zones and the pattern having no other tie."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    z = zones.assigned(w, {"supplier": _zones(w)})
    return zones.zoned(Pattern(z.schema, {"a": "supplier", "b": "supplier"}), z, ["supplier"], monic=True).select("a", "b", "zone")


@query("WITH s AS (SELECT s_suppkey::BIGINT AS s, CASE WHEN n_regionkey > 0 THEN n_regionkey::BIGINT + 1 END AS zone FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT n_nationkey::BIGINT AS n, CASE WHEN n_regionkey > 0 THEN n_regionkey::BIGINT + 1 END AS zone FROM nation) SELECT s, n, coalesce(s.zone, n.zone) AS zone FROM s JOIN n ON s.zone IS NULL OR n.zone IS NULL OR s.zone = n.zone")
def zone_global_rows(spark, sf_dir):
    """Suppliers and nations of one zone, where the rows of region 0 have none and so are in every zone."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    own = w.table("nation").where("n_regionkey > 0").select("world_id", "part_id", (F.col("n_regionkey") + 1).alias("zone"))
    z = zones.assigned(w, {"supplier": _zones(w).where("zone > 1"), "nation": own})
    return zones.zoned(Pattern(z.schema, {"s": "supplier", "n": "nation"}), z, ["supplier", "nation"]).select("s", "n", "zone")


@query("SELECT s_suppkey::BIGINT AS key, s_nationkey::BIGINT AS land, s_name AS label FROM supplier")
def migrate_swap(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    f = migration.Renaming(w.schema, {"supplier": "vendor"}, {"s_nationkey": "land"}, {"s_name": "label"})
    return f.world(w).table("vendor").select(F.col("part_id").alias("key"), "land", "label")


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name, CAST(NULL AS BIGINT) AS rank FROM region")
def migrate_include(spark, sf_dir):
    from pyspark.sql import types as T

    w = star_world(spark, sf_dir, ["region"])
    larger = w.schema.extend(["city"], {"city_region": ("city", "region")}, {"rank": ("region", T.LongType())})
    return migration.included(w, larger).table("region").select(F.col("part_id").alias("key"), F.col("r_name").alias("name"), "rank")


@query("SELECT c_custkey::BIGINT AS key, n_regionkey::BIGINT AS region, r_name AS region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def migrate_pullback(spark, sf_dir):
    """Customers straight in regions: a hom of the target is a path of the source."""
    from pyspark.sql import types as T

    from tessera.schema import Schema

    w = star_world(spark, sf_dir, ["region", "nation", "customer"])
    target = Schema(("area", "client"), {"client_area": ("client", "area")}, {"area_name": ("area", T.StringType()), "client_area_name": ("client", T.StringType())})
    after = migration.pulled_back(w, target, {"area": "region", "client": "customer"}, {"client_area": ["c_nationkey", "n_regionkey"]}, {"area_name": ([], "r_name"), "client_area_name": (["c_nationkey", "n_regionkey"], "r_name")})
    return after.table("client").select(F.col("part_id").alias("key"), F.col("client_area").alias("region"), F.col("client_area_name").alias("region_name"))


@query("SELECT 'region' AS ob, r_regionkey::BIGINT AS part_id FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def elements_nodes(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    return elements.nodes(w).select("ob", "part_id")


@query("SELECT 'n_regionkey' AS hom, n_nationkey::BIGINT AS src_id, n_regionkey::BIGINT AS dst_id FROM nation UNION ALL SELECT 's_nationkey', s_suppkey, s_nationkey FROM supplier")
def elements_edges(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "supplier"])
    return elements.live(elements.edges(w), w).select("hom", "src_id", "dst_id")


@query("SELECT p_size::BIGINT AS value, dense_rank() OVER (ORDER BY p_size)::BIGINT AS code FROM (SELECT DISTINCT p_size FROM part)")
def encode_ordinal(spark, sf_dir):
    w = star_world(spark, sf_dir, ["part"])
    return encoding.ordinal(w.table("part"), "p_size").select(F.col("value").cast("long").alias("value"), "code")


@query("SELECT p_brand AS value, row_number() OVER (ORDER BY first)::BIGINT AS code FROM (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1)")
def encode_nominal(spark, sf_dir):
    w = star_world(spark, sf_dir, ["part"])
    return encoding.nominal(w.table("part"), "p_brand", ["part_id"])


@query("SELECT p_partkey::BIGINT AS p, (CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END)::BIGINT AS code FROM part")
def encode_custom(spark, sf_dir):
    w = star_world(spark, sf_dir, ["part"])
    return w.table("part").select(F.col("part_id").alias("p"), encoding.bins([10, 30]).encode(F.col("p_size")).alias("code"))


@query("SELECT o_orderkey::BIGINT AS o, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'other' END AS status FROM orders")
def categorical_map(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    return w.table("orders").select(F.col("part_id").alias("o"), chosen_of(F.col("o_orderstatus"), {"O": "open", "F": "final"}, F.lit("other")).alias("status"))


# -- counts and trajectories


@query("SELECT 'region' AS ob, count(*)::BIGINT AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def nparts(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    return w.counts().select("ob", "n")


@query("SELECT o_custkey::BIGINT AS c, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def match_counts(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    found = match(_orders(w), w).select(F.col("c").alias("world_id"), "o")
    return matching.count(found).withColumnRenamed("world_id", "c")


@query("SELECT round(ln((SELECT count(*) FROM region)) + ln((SELECT count(*) FROM nation)), 9) AS log_space")
def search_space(spark, sf_dir):
    w = star_world(spark, sf_dir, ["region", "nation"])
    return matching.search_space(_p(w, {"r": "region", "n": "nation"}), w).select(F.round("log_space", 9).alias("log_space"))


def _trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions: a world for each user, done at its last event, won by its type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("world_id"), "event_id", "ts", "event_type")
    last = e.groupBy("world_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("world_id", F.col("last.event_id").alias("last_id"))
    return e.join(last, "world_id").select("world_id", F.col("event_type").alias("action"), (F.col("event_id") == F.col("last_id")).alias("done"), F.when(F.col("event_id") == F.col("last_id"), F.col("event_type")).alias("winner"))


@query("SELECT event_type AS action, count(*)::BIGINT AS n FROM events GROUP BY 1")
def action_counts(spark, sf_dir):
    return experience.action_counts(_trajectory(spark, sf_dir))


@query("SELECT user_id::BIGINT AS world_id, count(*)::BIGINT AS length FROM events GROUP BY 1")
def episode_length(spark, sf_dir):
    return experience.episode_length(_trajectory(spark, sf_dir))


@query("SELECT round(coalesce(avg((event_type = 'click')::DOUBLE), 0), 9) AS win_rate FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win_rate(spark, sf_dir):
    return experience.win_rate(_trajectory(spark, sf_dir), "click").select(F.round("win_rate", 9).alias("win_rate"))


@query("SELECT winner, wins, round(wins / ended, 9) AS win_rate FROM (SELECT event_type AS winner, count(*)::BIGINT AS wins, sum(count(*)) OVER () AS ended FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1)")
def win_rates(spark, sf_dir):
    return experience.win_rates(_trajectory(spark, sf_dir), []).select("winner", "wins", F.round("win_rate", 9).alias("win_rate"))


from tessera.plans import catalog_forms, catalog_runs  # noqa: E402, F401  they add to QUERIES
