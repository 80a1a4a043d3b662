"""Registered queries over forms of worlds: codecs, codes, graphs, agents, measures, merges, sameness and streams."""

from __future__ import annotations

import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import agents, experience
from tessera.functions import encoding
from tessera.functions.numbering import numbered, reinforce_loss, softmax
from tessera.operators import elements, isomorphism, matching, rewriting
from tessera.operators.matching import match
from tessera.pattern import Pattern, Threshold, Var, representable
from tessera.plans.catalog import _ids, _p, _trajectory, query
from tessera.rule import Rule, identity
from tessera.sources import parquet
from tessera.sources.parquet import star_world
from tessera.world import World, shared

SMALL = ["region", "nation", "supplier"]


def _in_nation(w: World) -> Pattern:
    return _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"})


# -- matching and rules


@query("SELECT n_nationkey::BIGINT AS n, a.s_suppkey::BIGINT AS a, a.s_suppkey::BIGINT AS b FROM supplier a JOIN nation ON a.s_nationkey = n_nationkey")
def match_same_element(spark, sf_dir):
    """Two elements that must be one row."""
    w = star_world(spark, sf_dir, SMALL)
    p = _p(w, {"n": "nation", "a": "supplier", "b": "supplier"}, {("a", "s_nationkey"): "n"})
    return _ids(match(p, w, same=[("a", "b")]), n="n", a="a", b="b")


@query("SELECT r_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation, s_suppkey::BIGINT AS supplier, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def match_representable(spark, sf_dir):
    """The representable of a table occurs once for each of its rows."""
    w = star_world(spark, sf_dir, SMALL)
    return match(representable(w.schema, "supplier"), w).select(F.col("region_1").alias("region"), F.col("nation_1").alias("nation"), F.col("supplier_1").alias("supplier"), F.col("`?supplier_1.s_name`").alias("name"))


@query("SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s FROM region CROSS JOIN nation JOIN supplier ON s_nationkey = n_nationkey")
def match_coproduct(spark, sf_dir):
    """Two patterns side by side: all pairs of their matches."""
    w = star_world(spark, sf_dir, SMALL)
    return _ids(match(_p(w, {"r": "region"}).coproduct(_in_nation(w), "l_", "r_"), w), l_r="r", r_n="n", r_s="s")


@query("SELECT c_custkey::BIGINT AS c, o_orderkey::BIGINT AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
def match_anchored(spark, sf_dir):
    """The customers of a nation as anchors, and only then their orders."""
    w = star_world(spark, sf_dir, ["region", "nation", "customer", "orders"])
    anchors = match(_p(w, {"c": "customer", "n": "nation"}, {("c", "c_nationkey"): "n"}), w, pins={"n": 7}).select("world_id", "c")
    return _ids(match(_p(w, {"c": "customer", "o": "orders"}, {("o", "o_custkey"): "c"}), w, pins=anchors), c="c", o="o")


@query("SELECT 'TypeError' AS said")
def match_threshold_unordered(spark, sf_dir):
    """A threshold on values without an order is refused."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = parquet.from_tables({"embeddings": (e, "vec_id")}, {})
    try:
        match(_p(w, {"e": "embeddings"}), w, thresholds=[Threshold("e", "embedding", "<", 1)])
    except TypeError as x:
        return spark.createDataFrame([(type(x).__name__,)], "said string")
    return spark.createDataFrame([], "said string")


@query("SELECT p_partkey::BIGINT AS p, CASE WHEN p_size > 40 THEN 40 ELSE p_size END::BIGINT AS size FROM part")
def rewrite_constant(spark, sf_dir):
    """A kept row's attr becomes a constant."""
    w = star_world(spark, sf_dir, ["part"])
    p = _p(w, {"p": "part"})
    rule = Rule("cap", p, {"p": "p"}, _p(w, {"p": "part"}, {}, {("p", "p_size"): 40}), thresholds=(Threshold("p", "p_size", ">", 40),))
    return rewriting.apply(rule, rewriting.legal(rule, w), w).world.table("part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("size"))


@query("SELECT p_partkey::BIGINT AS p, (p_size % 7)::BIGINT AS across, (p_size // 7)::BIGINT AS down FROM part")
def rewrite_grid(spark, sf_dir):
    """Places of a grid from a running number, by expressions of a rule."""
    w = star_world(spark, sf_dir, ["part"])
    p = _p(w, {"p": "part"})
    rule = identity("grid", p, expressions={("p", "p_size"): lambda of: F.pmod(of("p.p_size"), F.lit(7)), ("p", "p_retailprice"): lambda of: F.floor(of("p.p_size") / 7)})
    after = rewriting.apply(rule, rewriting.legal(rule, w), w).world.table("part")
    return after.select(F.col("part_id").alias("p"), F.col("p_size").cast("long").alias("across"), F.col("p_retailprice").cast("long").alias("down"))


@query("SELECT 'nation' AS ob, n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS refers FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey = 4 THEN 3 ELSE s_nationkey END FROM supplier UNION ALL SELECT 'customer', c_custkey, CASE WHEN c_nationkey = 4 THEN 3 ELSE c_nationkey END FROM customer")
def rewrite_merge(spark, sf_dir):
    """Nation 4 becomes one with nation 3; what referred to it refers to that."""
    w = star_world(spark, sf_dir, ["region", "nation", "supplier", "customer"])
    rule = Rule("unite", _p(w, {"a": "nation", "b": "nation"}), {"a": "x", "b": "x"}, _p(w, {"x": "nation"}))
    after = rewriting.apply(rule, rewriting.legal(rule, w, pins={"a": 3, "b": 4}), w).world
    parts = [after.table(o).select(F.lit(o).alias("ob"), F.col("part_id").alias("id"), F.col(h).alias("refers")) for o, h in (("nation", "n_regionkey"), ("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('moved', true), ('other', false)) t(world, same)")
def worlds_isomorphic(spark, sf_dir):
    """A world with other ids is the same; one with a supplier elsewhere isn't."""
    w = star_world(spark, sf_dir, SMALL)
    tables = {o: t.withColumn("part_id", F.col("part_id") * 3 + 11) for o, t in w.tables.items()}
    for h, (a, _) in w.schema.homs.items():
        tables[a] = tables[a].withColumn(h, F.col(h) * 3 + 11)
    moved = replace(w, tables=tables)
    first = moved.table("supplier").agg(F.min("part_id")).first()[0]
    other = moved.with_tables(supplier=moved.table("supplier").withColumn("s_nationkey", F.when(F.col("part_id") == first, F.when(F.col("s_nationkey") == 11, 14).otherwise(11)).otherwise(F.col("s_nationkey")).cast("long")))
    said = [(name, isomorphism.isomorphic(w, x).first()["same"]) for name, x in (("moved", moved), ("other", other))]
    return spark.createDataFrame(said, "world string, same boolean")


# -- agents


def _offered(w: World) -> tuple[DataFrame, agents.Context]:
    """Every nation's choice among its suppliers."""
    found = match(_in_nation(w), w, extra={"s": ["s_acctbal"]}).withColumns({"passes": F.lit(False), "@n": F.col("n")})
    return found, agents.Context(w, "p", 1, ("n", "s"), groups=("world_id", "@n"))


LAST = "SELECT s_nationkey::BIGINT AS n, max(s_suppkey)::BIGINT AS s FROM supplier GROUP BY 1"


@query(LAST)
def agents_function(spark, sf_dir):
    """A Python function of each agent's list of candidates."""
    found, ctx = _offered(star_world(spark, sf_dir, SMALL))
    return agents.Function(lambda world, turn, rows: len(rows) - 1).choose(found, ctx).select("n", "s")


@query(LAST)
def agents_vectorised(spark, sf_dir):
    """A Python function of each agent's matrix; an index beyond it is clamped."""
    found, ctx = _offered(star_world(spark, sf_dir, SMALL))
    return agents.Vectorised(lambda m, turn: 1_000_000).choose(found, ctx).select("n", "s")


@query(LAST)
def agents_batched(spark, sf_dir):
    """One call for the matrices of many agents."""
    found, ctx = _offered(star_world(spark, sf_dir, SMALL))

    def last(matrix, edges, turns):
        import numpy as np

        return np.array([int(matrix[a:b, 1].argmax()) + 1 for a, b in zip(edges, edges[1:])])

    return agents.Batched(last).choose(found, ctx).select("n", "s")


@query("SELECT n, arg_max(s, s_acctbal) AS s FROM (SELECT s_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s, s_acctbal FROM supplier) GROUP BY 1")
def agents_softmax_cold(spark, sf_dir):
    """A draw by softmax at a temperature near zero is the best."""
    found, ctx = _offered(star_world(spark, sf_dir, SMALL))
    return agents.Softmax(lambda df, _: F.col("`s.s_acctbal`"), temperature=1e-9).choose(found, ctx).select("n", "s")


@query("SELECT count(DISTINCT s_nationkey)::BIGINT AS chosen, count(DISTINCT s_nationkey)::BIGINT AS legal FROM supplier")
def agents_random(spark, sf_dir):
    """A draw for each agent: how many chose, and how many of the choices were offered."""
    found, ctx = _offered(star_world(spark, sf_dir, SMALL))
    drawn = agents.Random(3).choose(found, ctx).select("n", "s")
    return drawn.agg(F.count(F.lit(1)).alias("chosen")).crossJoin(drawn.join(found.select("n", "s"), ["n", "s"], "left_semi").agg(F.count(F.lit(1)).alias("legal")))


@query("SELECT 'node' AS kind, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'edge', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)")
def agents_see_graph(spark, sf_dir):
    """The graph that an agent may look at."""
    _, ctx = _offered(star_world(spark, sf_dir, SMALL))
    n, e = ctx.graph()
    return n.agg(F.lit("node").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(e.agg(F.lit("edge").alias("kind"), F.count(F.lit(1)).alias("n")))


# -- codes and graphs


@query("SELECT p_partkey::BIGINT AS p, p_brand AS brand, p_size::BIGINT AS size FROM part")
def codes_and_back(spark, sf_dir):
    """Codes of values, and values of codes."""
    t = star_world(spark, sf_dir, ["part"]).table("part")
    brands, sizes = encoding.nominal(t, "p_brand", ["part_id"]), encoding.ordinal(t, "p_size")
    coded = encoding.encode(encoding.encode(t, "p_brand", brands, "b"), "p_size", sizes, "z").select("part_id", "b", "z")
    back = encoding.decode(encoding.decode(coded, "b", brands, "brand"), "z", sizes, "size")
    return back.select(F.col("part_id").alias("p"), "brand", F.col("size").cast("long").alias("size"))


@query("SELECT 'ordered' AS kind, v::VARCHAR AS value, row_number() OVER (ORDER BY v)::BIGINT AS code FROM (SELECT DISTINCT p_size::BIGINT AS v FROM part UNION SELECT 0 UNION SELECT 999) UNION ALL SELECT 'numbered', v, c FROM (SELECT p_brand AS v, row_number() OVER (ORDER BY min(p_partkey))::BIGINT AS c FROM part GROUP BY 1) UNION ALL SELECT 'numbered', 'new brand', count(DISTINCT p_brand)::BIGINT + 1 FROM part")
def codes_extended(spark, sf_dir):
    """Values that a rule brings along: ranks shift, numbers are appended."""
    t = star_world(spark, sf_dir, ["part"]).table("part")
    sizes = encoding.extended(encoding.ordinal(t, "p_size"), spark.createDataFrame([(0,), (999,)], "value int"), ordered=True)
    brands = encoding.extended(encoding.nominal(t, "p_brand", ["part_id"]), spark.createDataFrame([("new brand",)], "value string"), ordered=False)
    return sizes.select(F.lit("ordered").alias("kind"), F.col("value").cast("string").alias("value"), "code").unionByName(brands.select(F.lit("numbered").alias("kind"), "value", "code"))


@query("SELECT s_suppkey::BIGINT AS s, 0 AS is_nation, 1 AS is_supplier, round(s_acctbal::FLOAT::DOUBLE, 2) AS balance FROM supplier")
def graph_features(spark, sf_dir):
    """Nodes with the place of their table and a numeric attr."""
    w = star_world(spark, sf_dir, SMALL)
    n = elements.nodes(w, ["s_acctbal"], one_hot=True).where("ob = 'supplier'")
    return n.select(F.col("part_id").alias("s"), F.col("feat")[1].cast("int").alias("is_nation"), F.col("feat")[2].cast("int").alias("is_supplier"), F.round(F.col("feat")[3].cast("double"), 2).alias("balance"))


@query("SELECT 'n_regionkey' AS hom, 'nation' AS src_ob, n_nationkey::BIGINT AS src_id, n_regionkey::BIGINT AS dst_id FROM nation UNION ALL SELECT 's_nationkey', 'supplier', s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 's_nationkey', 'nation', s_nationkey, s_suppkey FROM supplier")
def graph_both_ways(spark, sf_dir):
    """Edges, those of one foreign key also in reverse."""
    return elements.edges(star_world(spark, sf_dir, SMALL), both_ways=("s_nationkey",)).select("hom", "src_ob", "src_id", "dst_id")


@query("SELECT s_suppkey::BIGINT AS src_id, s_nationkey::BIGINT AS dst_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def graph_live(spark, sf_dir):
    """Edges both ends of which are still there."""
    w = star_world(spark, sf_dir, SMALL)
    w = w.with_tables(nation=w.table("nation").where("n_regionkey <> 2"))
    return elements.live(elements.edges(w), w).where("hom = 's_nationkey'").select("src_id", "dst_id")


@query("WITH n AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS nodes) SELECT nodes, nodes AS indexes, 0::BIGINT AS low, nodes - 1 AS high, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS edges FROM n")
def graph_positions(spark, sf_dir):
    """Dense indexes of nodes, and edges between them."""
    n, e = elements.positions(star_world(spark, sf_dir, SMALL))
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("index").alias("indexes"), F.min("index").alias("low"), F.max("index").alias("high")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))


# -- counts and trajectories


@query("SELECT max(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM supplier)")
def largest_table(spark, sf_dir):
    return star_world(spark, sf_dir, SMALL).largest().select("n")


@query("SELECT user_id::BIGINT AS world_id, 0::BIGINT AS low, count(*)::BIGINT - 1 AS high, count(*)::BIGINT AS numbers FROM events GROUP BY 1")
def numbered_rows(spark, sf_dir):
    """Gapless numbers within each world."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("world_id"), "event_id")
    return numbered(e, ["event_id"]).groupBy("world_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.countDistinct("n").alias("numbers"))


@query("WITH x AS (SELECT s_nationkey AS n, s_acctbal / 1000 AS x, s_acctbal / 10000 AS r, max(s_acctbal / 1000) OVER (PARTITION BY s_nationkey) AS m FROM supplier), p AS (SELECT n, r, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY n)) AS l FROM x) SELECT n::BIGINT AS n, round(-avg(r * l), 6) + 0.0 AS loss FROM p GROUP BY 1")
def reinforce(spark, sf_dir):
    """The loss of a policy by softmax, with rewards."""
    w = star_world(spark, sf_dir, SMALL)
    df = match(_in_nation(w), w, extra={"s": ["s_acctbal"]}).withColumn("x", F.col("`s.s_acctbal`") / 1000).withColumn("r", F.col("`s.s_acctbal`") / 10000)
    return reinforce_loss(softmax(df, "x", ["n"], "l", logarithm=True), "l", "r", ["n"]).select("n", (F.round("loss", 6) + 0.0).alias("loss"))


@query("WITH e AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_type AS winner, count(*)::BIGINT AS wins, (SELECT count(*) FROM e WHERE r = 1)::BIGINT AS episodes, (SELECT round(avg(n), 6) FROM e WHERE r = 1) AS mean_length FROM e WHERE r = 1 GROUP BY 1")
def trajectory_summary(spark, sf_dir):
    """One row for a batch of episodes, its ends taken apart."""
    e = _trajectory(spark, sf_dir).withColumn("step", F.col("done").cast("long"))
    s = experience.summary(e)
    return s.select(F.explode("ends").alias("winner", "wins"), "episodes", F.round("mean_length", 6).alias("mean_length"))


@query("SELECT n::BIGINT AS n, n::BIGINT AS inside, n::BIGINT AS distinct_draws FROM (SELECT count(*) AS n FROM customer)")
def uniform_draws(spark, sf_dir):
    """Draws that follow from seed and key lie between 0 and 1 and differ."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(matching.uniform(4, F.col("c_custkey")).alias("u"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("u") > 0) & (F.col("u") < 1), 1)).alias("inside"), F.countDistinct("u").alias("distinct_draws"))


# -- sources and sinks


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{shared(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS action_rule_name, CASE WHEN r = 1 THEN event_type ELSE 'nothing' END AS winner, r = 1 AS done, user_id::INT AS turn, 'p' AS player FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)")
def arrow_and_back(spark, sf_dir):
    """A trajectory in an Arrow file, and read again; missing values are a text."""
    rows = _trajectory(spark, sf_dir).withColumns({"player": F.lit("p"), "turn": F.col("world_id")})
    with tempfile.TemporaryDirectory() as d:
        # the file is the driver's own: it writes it and reads it into memory
        experience.write_arrow(rows, f"{d}/x.arrow")
        import pyarrow as pa

        with pa.OSFile(f"{d}/x.arrow", "rb") as f:
            found = pa.ipc.open_file(f).read_all()
    return spark.createDataFrame(found).select("action_rule_name", "winner", "done", "turn", "player")


@query("SELECT user_id::BIGINT AS world_id, event_type AS action, CASE WHEN r = 1 THEN event_type END AS winner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)")
def trajectory_files(spark, sf_dir):
    """A trajectory in Parquet, written by the executors."""
    path = _scratch(spark, "trajectory")
    experience.write_parquet(_trajectory(spark, sf_dir), path)
    return spark.read.parquet(path).select("world_id", "action", "winner")


@query("SELECT s_suppkey::BIGINT AS s, s_nationkey::BIGINT AS n, s_name AS name, s_acctbal AS balance FROM supplier")
def world_files(spark, sf_dir):
    """A batch of worlds written as files, and read by its schema."""
    w = star_world(spark, sf_dir, SMALL)
    path = _scratch(spark, "world")
    parquet.write(w, path)
    return parquet.read(spark, w.schema, path).table("supplier").select(F.col("part_id").alias("s"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query("SELECT s_suppkey::BIGINT AS s, CASE WHEN s_nationkey <> 3 THEN s_nationkey END::BIGINT AS n FROM supplier")
def world_mended(spark, sf_dir):
    """Foreign keys that lead nowhere are unset."""
    w = star_world(spark, sf_dir, SMALL)
    w = w.with_tables(nation=w.table("nation").where("part_id <> 3"))
    return w.mended().table("supplier").select(F.col("part_id").alias("s"), F.col("s_nationkey").alias("n"))


@query("SELECT s_suppkey::BIGINT AS s, 's_nationkey' AS hom FROM supplier WHERE s_nationkey = 3")
def world_dangling(spark, sf_dir):
    """Which foreign keys lead nowhere."""
    w = star_world(spark, sf_dir, SMALL)
    w = w.with_tables(nation=w.table("nation").where("part_id <> 3"))
    return w.dangling().select(F.col("part_id").alias("s"), "hom")


@query("SELECT n_nationkey::BIGINT AS part_id, n_name AS name, 7::BIGINT AS turn FROM nation")
def world_cut_and_snapshot(spark, sf_dir):
    """A world without its lineage, and its tables with a turn."""
    w = star_world(spark, sf_dir, ["region", "nation"])
    return w.cut().snapshot(7)["nation"].select("part_id", F.col("n_name").alias("name"), "turn")


@query("SELECT * FROM (VALUES ('n_regionkey', 'nation', 'region'), ('s_nationkey', 'supplier', 'nation')) t(name, of_table, leads_to) UNION ALL SELECT column_name, 'supplier', data_type FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'), ('s_nationkey', ''), ('s_acctbal', 'double')) c(column_name, data_type) WHERE column_name IN ('s_name', 's_acctbal')")
def schema_reflected(spark, sf_dir):
    """What a schema says of tables as they are: foreign keys, and some attrs with their types."""
    s = star_world(spark, sf_dir, SMALL).schema
    rows = [(h, a, b) for h, (a, b) in s.homs.items()] + [(n, a, t.simpleString()) for n, (a, t) in s.attrs.items() if n in ("s_name", "s_acctbal")]
    return spark.createDataFrame(rows, "name string, of_table string, leads_to string")


@query("SELECT n_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def rule_from_json(spark, sf_dir):
    """A rule with all its options, a pattern and a map between patterns, written as JSON and read again."""
    import json

    from tessera.sources import codec

    w = star_world(spark, sf_dir, SMALL)
    rule = identity("look", _in_nation(w), monic=True, thresholds=(Threshold("s", "s_acctbal", ">", 0.0),))
    schema = codec.schema_in(json.loads(json.dumps(codec.schema_out(w.schema))))
    read = codec.rule_in(schema, json.loads(json.dumps(codec.rule_out(rule))))
    left, right, mapping = codec.morphism_in(schema, json.loads(json.dumps(codec.morphism_out(read.left, read.right, read.keep))))
    again = replace(read, left=left, right=right, keep=mapping)
    return _ids(rewriting.legal(again, w), n="n", s="s")


# -- streams


@query("SELECT s_nationkey::BIGINT AS n, s_suppkey::BIGINT AS s, CASE WHEN s_acctbal < 0 THEN 'broke' ELSE s_name END AS name FROM supplier WHERE s_nationkey <> 2 UNION ALL SELECT n_nationkey, 1000000 + n_nationkey, 'new' FROM nation")
def stream_of_changes(spark, sf_dir):
    """Matches that follow a stream of rows that are added, changed and deleted, micro-batch by micro-batch."""
    from tessera.streaming.maintain import Maintained, follow

    w = star_world(spark, sf_dir, SMALL)
    p = _p(w, {"n": "nation", "s": "supplier"}, {("s", "s_nationkey"): "n"}, {("s", "s_name"): Var("name")})
    s, n = w.table("supplier"), w.table("nation")
    names = w.schema.struct("supplier").names
    gone = s.where("s_nationkey = 2").withColumns({"change": F.lit("delete"), "seq": F.lit(1)})
    other = s.where("s_nationkey <> 2 and s_acctbal < 0").withColumns({"s_name": F.lit("broke"), "change": F.lit("update"), "seq": F.lit(2)})
    values = {"part_id": F.lit(1_000_000).cast("long") + F.col("part_id"), "s_nationkey": F.col("part_id"), "s_name": F.lit("new")}
    kinds = {f.name: f.dataType for f in w.schema.struct("supplier")}
    new = n.select("world_id", *[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names[1:]], F.lit("add").alias("change"), F.lit(3).alias("seq"))
    path = _scratch(spark, "stream")
    for part in (gone, other, new):
        part.select(*names, "change", "seq").coalesce(1).write.mode("append").parquet(f"{path}/in")
    kept = Maintained(w, identity("look", p), "supplier")
    stream = spark.readStream.schema(T.StructType([*w.schema.struct("supplier").fields, T.StructField("change", T.StringType()), T.StructField("seq", T.IntegerType())])).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    follow(stream, kept, f"{path}/state", availableNow=True).awaitTermination()
    return kept.matches.select("n", "s", F.col("`?name`").alias("name"))
