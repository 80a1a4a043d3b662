"""Matching against golden cases and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import types as T

from tessera.operators import matching
from tessera.operators.matching import match
from tessera.pattern import Pattern, Threshold, Var, path, representable
from tessera.schema import Schema
from tessera.world import graph_rows, make, repeated

GRAPH = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")})
LABELS = GRAPH.extend(attrs={"label": ("V", T.StringType())})
FUEL = Schema(("V",), {}, {"fuel": ("V", T.LongType())})


def chain(spark, n, more=()):
    return make(spark, GRAPH, graph_rows(n, [(i, i + 1) for i in range(1, n)] + list(more)))


def rows(df, pattern):
    return sorted(tuple(r[e] for e in pattern.elements) for r in df.collect())


def brute(pattern, tables, monic=()):
    """All homomorphisms by trying every assignment. tables: rows by table, with part_id."""
    names = list(pattern.elements)
    found = set()
    for pick in itertools.product(*[tables.get(pattern.elements[e], []) for e in names]):
        at = dict(zip(names, pick))
        ok = all(at[e][h] == at[to]["part_id"] for (e, h), to in pattern.homs.items())
        values = {}
        for (e, n), v in pattern.attrs.items():
            x = at[e].get(n)
            if isinstance(v, Var):
                ok &= x is not None and values.setdefault(v.name, x) == x
            else:
                ok &= x == v
        for a, b in itertools.combinations(names, 2):
            if pattern.elements[a] == pattern.elements[b] and pattern.elements[a] in monic:
                ok &= at[a]["part_id"] != at[b]["part_id"]
        if ok:
            found.add(tuple(r["part_id"] for r in pick))
    return sorted(found)


def test_paths(spark):
    p3 = path(GRAPH, 3)
    assert match(p3, chain(spark, 4)).count() == 2
    assert match(p3, make(spark, GRAPH, graph_rows(1, [(1, 1)]))).count() == 1
    assert match(p3, chain(spark, 4), pins={"V_1": 2, "V_3": 4}).count() == 1
    assert match(p3, chain(spark, 4), pins={"V_1": 1, "E_1": 3}).count() == 0


def test_monic(spark):
    w = chain(spark, 3, [(1, 1), (2, 2), (3, 3), (2, 3)])
    p = path(GRAPH, 2)
    assert match(p, w, monic=True).count() == 3
    assert match(p, w).count() == 6
    assert rows(match(p, w, monic=["V"]), p) == rows(match(p, w, monic=True), p)
    with pytest.raises(ValueError):
        match(p, w, monic=["X"])


def both_ways(edges):
    return [(a, b) for a, b in edges] + [(b, a) for a, b in edges]


@pytest.mark.parametrize(("n", "k", "colourings"), [(5, 2, 0), (5, 3, 30), (6, 2, 2)])
def test_colourings(spark, n, k, colourings):
    elements = {f"v{i}": "V" for i in range(n)} | {f"e{i}": "E" for i in range(n)}
    homs = {(f"e{i}", "src"): f"v{i}" for i in range(n)} | {(f"e{i}", "tgt"): f"v{(i + 1) % n}" for i in range(n)}
    complete = make(spark, GRAPH, graph_rows(k, [(a, b) for a in range(1, k + 1) for b in range(1, k + 1) if a != b]))
    assert match(Pattern(GRAPH, elements, homs), complete).count() == colourings


def test_labels(spark):
    def cycle(names):
        return Pattern(LABELS, {f"v{i}": "V" for i in range(4)} | {f"e{i}": "E" for i in range(4)}, {(f"e{i}", h): f"v{(i + d) % 4}" for i in range(4) for h, d in (("src", 0), ("tgt", 1))}, {(f"v{i}", "label"): x for i, x in enumerate(names)})

    ring = [(1, 2), (2, 3), (3, 4), (4, 1)]
    assert match(cycle("abcd"), make(spark, LABELS, graph_rows(4, ring, label=list("cdab")))).count() == 1
    assert match(cycle("abcd"), make(spark, LABELS, graph_rows(4, ring, label=list("abdc")))).count() == 0


@pytest.mark.parametrize(("op", "value", "want"), [("<=", 3, range(4)), ("<", 3, range(3)), (">=", 5, range(5, 8)), (">", 5, (6, 7))])
def test_thresholds(spark, op, value, want):
    w = make(spark, FUEL, {"V": [{"fuel": i} for i in range(8)] + [{"fuel": None}]})
    p = Pattern(FUEL, {"v": "V"}, {}, {("v", "fuel"): Var("x")})
    assert sorted(r["?x"] for r in match(p, w, thresholds=[Threshold("v", "fuel", op, value)]).collect()) == list(want)
    assert match(Pattern(FUEL, {"v": "V"}), w).count() == 9


def test_thresholds_need_an_order(spark):
    s = Schema(("V",), {}, {"tags": ("V", T.ArrayType(T.StringType()))})
    with pytest.raises(TypeError):
        match(Pattern(s, {"v": "V"}), make(spark, s, {"V": []}), thresholds=[Threshold("v", "tags", "<", 1)])


def test_star(spark):
    s = Schema(("A", *[f"B{i}" for i in range(1, 8)]), {f"b{i}": (f"B{i}", "A") for i in range(1, 8)})
    w = make(spark, s, {"A": [{}] * 200} | {f"B{i}": [{f"b{i}": j} for j in range(1, 201)] for i in range(1, 8)})
    p = Pattern(s, {"a": "A"} | {f"x{i}": f"B{i}" for i in range(1, 8)}, {(f"x{i}", f"b{i}"): "a" for i in range(1, 8)})
    assert match(p, w).count() == 200


def test_random_patterns_are_brute_force(spark):
    rng = random.Random(5)
    for turn in range(12):
        n, m = rng.randint(2, 6), rng.randint(2, 8)
        data = graph_rows(n, [(rng.randint(1, n), rng.choice([None, *range(1, n + 1)])) for _ in range(m)], label=[rng.choice("ab") for _ in range(n)])
        w = make(spark, LABELS, data)
        k, j = rng.randint(1, 3), rng.randint(0, 3)
        elements = {f"v{i}": "V" for i in range(k)} | {f"e{i}": "E" for i in range(j)}
        homs = {(f"e{i}", h): f"v{rng.randrange(k)}" for i in range(j) for h in ("src", "tgt") if rng.random() < 0.8}
        attrs = {(f"v{i}", "label"): rng.choice(["a", Var("x"), Var("x")]) for i in range(k) if rng.random() < 0.5}
        p = Pattern(LABELS, elements, homs, attrs)
        tables = {o: [dict(r, part_id=i + 1) for i, r in enumerate(rs)] for o, rs in data.items()}
        for monic, names in ((False, ()), (True, ("V", "E")), (["V"], ("V",))):
            got = match(p, w, monic=monic)
            assert rows(got, p) == brute(p, tables, names), (turn, p, monic)
            assert got.count() == got.distinct().count()


def test_checked_keys_change_nothing(spark):
    from dataclasses import replace

    w = chain(spark, 5, [(2, 2), (5, 1)])
    for p in (path(GRAPH, 2), path(GRAPH, 3), Pattern(GRAPH, {"e": "E", "f": "E", "v": "V"}, {("e", "tgt"): "v", ("f", "tgt"): "v"})):
        for monic in (True, False, ["E"]):
            assert rows(match(p, replace(w, checked=True), monic=monic), p) == rows(match(p, w, monic=monic), p)
        for pins in ({"V_1": 2}, {"V_2": 2}):
            if "V_2" in p.elements:
                assert rows(match(p, replace(w, checked=True), pins=pins), p) == rows(match(p, w, pins=pins), p)


def test_worlds_do_not_mix(spark):
    one = chain(spark, 4)
    p = path(GRAPH, 3)
    assert {r["world_id"]: r["n"] for r in matching.count(match(p, repeated(one, 3))).collect()} == {0: 2, 1: 2, 2: 2}
    free = Pattern(GRAPH, {"a": "V", "b": "V"})
    assert match(free, repeated(one, 3)).count() == 48 and match(free, repeated(one, 3), monic=True).count() == 36


def test_empty_pattern(spark):
    assert match(Pattern(GRAPH), repeated(chain(spark, 2), 3)).count() == 3


@pytest.mark.parametrize(("length", "edges", "size"), [(3, [(1, 2), (2, 3), (3, 4)], 2), (2, [(1, 2), (2, 3), (3, 4), (4, 5)], 4), (2, [(1, 2), (2, 3), (3, 4), (4, 1)], 4), (3, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1)], 5)])
def test_samples(spark, length, edges, size):
    w = make(spark, GRAPH, graph_rows(5, edges))
    p = path(GRAPH, length)
    every = set(rows(match(p, w), p))
    assert len(every) == size
    reached = set()
    for seed in range(25):
        got = rows(match(p, w, take=2, seed=seed), p)
        assert len(got) == len(set(got)) == 2 and set(got) <= every
        reached |= set(got)
    assert reached == every
    assert set(rows(match(p, w, take=size, seed=1), p)) == every
    assert set(rows(match(p, w, take=99, seed=1), p)) == every


def test_limit_is_canonical(spark):
    p = path(GRAPH, 2)
    assert rows(match(p, chain(spark, 6), limit=2), p) == rows(match(p, chain(spark, 6)), p)[:2]
    assert match(p, repeated(chain(spark, 6), 4), limit=2).count() == 8


def test_representable_and_coproduct(spark):
    p = representable(GRAPH, "E")
    assert sorted(p.elements.values()) == ["E", "V", "V"]
    assert match(p, chain(spark, 4)).count() == 3
    two = p.coproduct(p)
    assert match(two, chain(spark, 4)).count() == 9
    with pytest.raises(ValueError):
        representable(Schema(("A",), {"up": ("A", "A")}), "A")


def test_patterns_are_checked():
    with pytest.raises(ValueError):
        Pattern(GRAPH, {"e": "E", "f": "E"}, {("e", "src"): "f"})
    with pytest.raises(ValueError):
        Schema(("A",), {"f": ("A", "B")})


def test_pins_come_first(spark):
    """Random pins on any elements, connected or not, are what filtering all matches gives."""
    rng = random.Random(11)
    w = make(spark, GRAPH, graph_rows(7, [(rng.randint(1, 7), rng.randint(1, 7)) for _ in range(16)]))
    for p, pinned in ((path(GRAPH, 3), ["V_2"]), (path(GRAPH, 3), ["V_1", "V_3"]), (path(GRAPH, 2).coproduct(path(GRAPH, 1), "a", "b"), ["aV_1", "bV_1"]), (path(GRAPH, 2), ["E_1"])):
        every = rows(match(p, w, monic=["V"]), p)
        held = [tuple(rng.randint(1, 9) for _ in pinned) for _ in range(12)]
        pins = spark.createDataFrame([(0, *h) for h in held], "world_id bigint, " + ", ".join(f"{e} bigint" for e in pinned))
        at = [list(p.elements).index(e) for e in pinned]
        assert rows(match(p, w, monic=["V"], pins=pins), p) == [r for r in every if tuple(r[i] for i in at) in set(held)]


def test_the_search_starts_from_pins(spark):
    w = chain(spark, 4)
    pins = spark.createDataFrame([(0, 2)], "world_id bigint, V_2 bigint")
    plan = match(path(GRAPH, 3), w, pins=pins)._jdf.queryExecution().optimizedPlan().toString()
    # below all joins, so at the deepest level of the plan
    depth = max(plan.split("\n"), key=lambda line: len(line) - len(line.lstrip(" :+-")))
    assert "Join" not in depth and plan.count("Join") >= 2


def test_elements_that_are_one_row(spark):
    w = chain(spark, 4, [(1, 1)])
    p = path(GRAPH, 3)
    assert rows(match(p, w, same=[("V_1", "V_2")]), p) == [r for r in rows(match(p, w), p) if r[0] == r[1]]
    apart = path(GRAPH, 2).coproduct(path(GRAPH, 2), "a", "b")
    assert rows(match(apart, w, same=[("aV_2", "bV_1")]), apart) == [r for r in rows(match(apart, w), apart) if r[1] == r[3]]
    with pytest.raises(ValueError):
        match(p, w, same=[("V_1", "nobody")])


def test_many_first_rows_go_through_lots(spark, monkeypatch):
    w = repeated(chain(spark, 9), 3)
    p = path(GRAPH, 2)
    few = {n: sorted(map(tuple, match(p, w, limit=n).collect())) for n in (1, 5, 20)}
    drawn = {n: sorted(map(tuple, match(p, w, take=n, seed=4).collect())) for n in (1, 5, 20)}
    monkeypatch.setattr(matching, "FEW", 0)
    for n in (1, 5, 20):
        assert sorted(map(tuple, match(p, w, limit=n).collect())) == few[n]
        assert sorted(map(tuple, match(p, w, take=n, seed=4).collect())) == drawn[n]
