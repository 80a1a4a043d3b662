"""Loops that are run in one pass: as many rounds as the rows ask for, and the same as round after round."""

from dataclasses import replace

import pytest

from tessera import agents
from tessera.experience import reconstructed
from tessera.operators.migration import Renaming
from tessera.pattern import Pattern
from tessera.plans import catalog, runner
from tessera.plans import schedule as S
from tessera.plans.catalog_runs import DROP, FIRST, FOUND, SCHEMA, SUPPLIER, looped, once
from tessera.rule import deleting
from tessera.world import make

ANY = deleting("any", SUPPLIER, Pattern(SCHEMA))


def world(spark, debts):
    """A nation in each world, and suppliers of which every other one is in debt until there are debts[i] such."""
    rows = [{"world_id": w, "part_id": 2 * i + d, "s_nationkey": 1, "s_name": "x", "s_acctbal": -900.0 if d else 900.0} for w, n in enumerate(debts) for i in range(n) for d in (0, 1)]
    return make(spark, SCHEMA, {"nation": [{"world_id": w, "n_name": "n"} for w in range(len(debts))], "supplier": rows}, list(range(len(debts))))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(a, b):
    """Two runs that can't be told apart."""
    assert {o: rows(t) for o, t in a.world.tables.items()} == {o: rows(t) for o, t in b.world.tables.items()}
    assert rows(a.control) == rows(b.control) and rows(a.events) == rows(b.events) and rows(a.experiences) == rows(b.experiences)
    assert rows(a.world.counters) == rows(b.world.counters)
    assert (a.changes is None) == (b.changes is None) and (a.changes is None or rows(a.changes) == rows(b.changes))
    assert [t for t, _ in a.snapshots] == [t for t, _ in b.snapshots]
    for (_, x), (_, y) in zip(a.snapshots, b.snapshots):
        assert {o: rows(x[o]) for o in x} == {o: rows(y[o]) for o in y}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Two regions; one has 103 suppliers in debt of 1,130, the other one of 30."""
    top = tmp_path_factory.mktemp("many")
    spark.createDataFrame([(0,), (1,), (2,)], "r_regionkey int").write.parquet(f"{top}/region.parquet")
    spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "c", 1), (3, "d", 2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{top}/nation.parquet")
    given = [(i, f"s{i}", i % 2 if i < 1130 else 2, -600.0 if i % 11 == 0 else 50.0) for i in range(1160)]
    spark.createDataFrame(given, "s_suppkey int, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{top}/supplier.parquet")
    return str(top)


def by_sql(spark, name, data):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "supplier"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = c.sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


def test_more_rounds_than_a_thousand(spark, many):
    by_sql(spark, "sched_while", many)


def test_while(spark):
    def ran(test, body=ANY):
        return runner.run(once(S.While("w", S.RuleApp("any", body), test), "o"), world(spark, [3, 1, 0, 2]), {}, log_changes=True)

    stepwise = ran(lambda w: w.nparts("supplier").where("n > 2").select("world_id"))
    same(ran(S.MoreThan("supplier", 2)), stepwise)
    assert stepwise.events.count() == 6
    # rows that no firing takes: the loop ends where nothing fires any more
    left = ran(S.MoreThan("supplier", 1), DROP)
    assert rows(left.world.nparts("supplier")) == ["Row(n=0, world_id=2)", "Row(n=1, world_id=1)", "Row(n=2, world_id=3)", "Row(n=3, world_id=0)"]


def test_other_ends_of_while(spark):
    most = S.While("w", S.RuleApp("any", ANY), S.MoreThan("supplier", 0), most=2)
    assert rows(runner.run(once(most, "o"), world(spark, [3]), {}).world.nparts("supplier")) == ["Row(n=4, world_id=0)"]
    # a rule whose rows are referred to is no such rule
    assert deleting("n", Pattern(SCHEMA, {"n": "nation"}), Pattern(SCHEMA)).plucked is None and FOUND.plucked is None and DROP.plucked == "s"


def test_sizes_stay_bounded(spark):
    """What the planner takes for the size of the control table doesn't double its digits with each round."""
    shrink = S.While("w", S.RuleApp("any", ANY), lambda w: w.nparts("supplier").where("n > 1").select("world_id"))
    r = runner.run(once(shrink, "o"), world(spark, [3]), {})
    assert r.control._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert r.events.count() == 5


def test_decisions_after_the_hundredth(spark, many):
    by_sql(spark, "sched_experiences", many)


def test_loop(spark):
    """After a decision of another box, so that steps and turns go on from there; worlds without a match, and one more
    round than any has matches."""
    inner = looped(S.PlayerRuleApp("drop", DROP, "p"))
    s = S.schedule("o", [], ["i"], {"b": S.PlayerRuleApp("found", FOUND, "p"), "l": inner}, "a, b = b(i)\nc = l(a)\nreturn c, b")

    def ran(**more):
        return runner.run(s, world(spark, [3, 1, 0, 2]), FIRST, win_conditions={"c": "clean"}, log_changes=True, **more)

    # with a limit of turns it is round after round
    swept, stepwise = ran(), ran(t_max=1000)
    same(swept, stepwise)
    assert rows(swept.experiences.where("world_id = 0").select("turn", "legal")) == [f"Row(legal={n}, turn={t})" for n, t in ((0, 5), (1, 1), (1, 4), (2, 3), (3, 2))]


def test_migrated_to_the_end(spark, many):
    by_sql(spark, "sched_migrated", many)


def test_renamed_tests_count_the_renamed_table(spark):
    f = Renaming(SCHEMA, {"supplier": "vendor"})
    s = f.schedule(once(S.While("w", S.RuleApp("any", ANY), S.MoreThan("supplier", 2)), "o"))
    r = runner.run(s, f.world(world(spark, [3, 1])), {})
    assert rows(r.world.nparts("vendor")) == ["Row(n=2, world_id=0)", "Row(n=2, world_id=1)"]


def test_nested_to_the_end(spark, many):
    by_sql(spark, "sched_nested", many)


def test_reconstructed_to_the_end(spark, many):
    by_sql(spark, "sched_reconstructed", many)


def test_snapshots(spark):
    loop = looped(S.PlayerRuleApp("drop", DROP, "p"))
    swept, stepwise = (runner.run(loop, world(spark, [2, 0, 1]), FIRST, snapshots=True, **more) for more in ({}, {"t_max": 1000}))
    same(swept, stepwise)
    for ob in ("supplier", "nation"):
        a, b = (reconstructed(r.events, r.snapshots, ob) for r in (swept, stepwise))
        assert a.columns == b.columns and rows(a) == rows(b)
        a, b = (reconstructed(r.events, [*r.snapshots[:1], *r.snapshots[2:]], ob) for r in (swept, stepwise))
        assert rows(a) == rows(b)


def test_limits_and_caches_to_the_end(spark, many):
    by_sql(spark, "sched_limit_and_cache", many)


@pytest.mark.parametrize("cached", [False, True])
def test_limits(spark, cached):
    loop = looped(S.PlayerRuleApp("drop", DROP, "p", match_limit=2, use_cache=cached))
    swept, stepwise = (runner.run(loop, world(spark, [3, 0]), FIRST, **more) for more in ({}, {"t_max": 1000}))
    same(swept, stepwise)
    # draws, passes, other agents, and rules that bring new matches go round after round
    free = S.PlayerRuleApp("drop", DROP, "p", match_limit=2)
    r = runner.Runner(world(spark, [1]), runner.Options({"p": agents.First(), "r": agents.Random(1)}))
    assert r.sweeps(free, ())
    for other in ({"take": 1}, {"can_pass": True}, {"view_fn": lambda w: w}, {"fast_match_fn": lambda rule, w: None}, {"player": "r"}, {"rule": FOUND}):
        assert not r.sweeps(replace(free, **other), ())
