"""Worlds: batches of instances of a schema, one DataFrame a table, told apart by world_id."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import Schema

#: Cuts of lineage go to this folder where the session names none; a cluster names one in spark.checkpoint.dir.
DEFAULT_SHARED = "file:///tmp/checkpoints/tessera-worlds"


@dataclass(frozen=True)
class World:
    """tables: name -> DataFrame(world_id, part_id, homs, attrs). ids: (world_id, the batch's worlds).

    one_world says that world_id has one value, so that products of components need no key. checked says that
    foreign keys are set and lead to rows, so that a join that only follows one can be left out.
    """

    schema: Schema
    tables: dict[str, DataFrame]
    ids: DataFrame
    one_world: bool = False
    checked: bool = False
    #: next free part_id by world and table, kept by rewriting: ids are never used again
    counters: DataFrame | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.ids.sparkSession

    def table(self, ob: str) -> DataFrame:
        return self.tables[ob]

    def with_tables(self, **tables: DataFrame) -> World:
        return replace(self, tables=self.tables | tables)

    def only(self, ids: DataFrame) -> World:
        """The worlds in ids(world_id)."""
        return replace(self, tables={o: t.join(ids, "world_id", "left_semi") for o, t in self.tables.items()}, ids=self.ids.join(ids, "world_id", "left_semi"))

    def union(self, other: World) -> World:
        """Both batches; their world ids differ."""
        return replace(self, tables={o: t.unionByName(other.tables[o]) for o, t in self.tables.items()}, ids=self.ids.unionByName(other.ids), one_world=False, checked=self.checked and other.checked, counters=_both(self.counters, other.counters))

    def counts(self) -> DataFrame:
        """world_id, ob, n for every world and table, zeros included."""
        each = [t.groupBy("world_id").agg(F.count(F.lit(1)).alias("n")).select("world_id", F.lit(o).alias("ob"), "n") for o, t in self.tables.items()]
        grid = self.ids.crossJoin(self.spark.createDataFrame([(o,) for o in self.schema.obs], "ob string"))
        return grid.join(reduce(DataFrame.unionByName, each), ["world_id", "ob"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))

    def nparts(self, ob: str) -> DataFrame:
        """world_id, n."""
        return self.counts().where(F.col("ob") == ob).select("world_id", "n")

    def largest(self) -> DataFrame:
        """world_id, n: rows of the world's largest table."""
        return self.counts().groupBy("world_id").agg(F.max("n").alias("n"))

    def dangling(self) -> DataFrame:
        """(world_id, ob, part_id, hom) of foreign keys that are not set or lead nowhere."""
        found = []
        for h, (a, b) in self.schema.homs.items():
            to = self.tables[b].select("world_id", F.col("part_id").alias("_to"))
            t = self.tables[a].select("world_id", "part_id", F.col(h).alias("_h"))
            bad = t.where("_h is null").unionByName(t.where("_h is not null").join(to, (t["world_id"] == to["world_id"]) & (t["_h"] == to["_to"]), "left_anti"))
            found.append(bad.select("world_id", F.lit(a).alias("ob"), "part_id", F.lit(h).alias("hom")))
        if not found:
            return self.spark.createDataFrame([], "world_id bigint, ob string, part_id bigint, hom string")
        return reduce(DataFrame.unionByName, found)

    def mended(self) -> World:
        """Foreign keys that lead nowhere become NULL."""
        tables = {}
        for o, t in self.tables.items():
            for h, b in self.schema.homs_of(o).items():
                to = self.tables[b].select(F.col("world_id").alias("_w"), F.col("part_id").alias("_p"))
                t = t.join(to, (F.col("world_id") == F.col("_w")) & (F.col(h) == F.col("_p")), "left").withColumn(h, F.col("_p")).drop("_w", "_p")
            tables[o] = t.select(*self.schema.struct(o).names)
        return replace(self, tables=tables)

    def cut(self) -> World:
        """The same worlds without their lineage: tables are checkpointed in the shared folder."""
        shared(self.spark)
        tables = {o: t.checkpoint() for o, t in self.tables.items()}
        return replace(self, tables=tables, ids=self.ids.checkpoint(), counters=None if self.counters is None else self.counters.checkpoint())

    def snapshot(self, turn: int | Column) -> dict[str, DataFrame]:
        """The tables with a column `turn`."""
        value = turn if isinstance(turn, Column) else F.lit(turn)
        return {o: t.withColumn("turn", value.cast("long")) for o, t in self.tables.items()}

    def collected(self) -> dict[str, list[dict]]:
        """Rows by table, for small worlds and tests."""
        return {o: [r.asDict() for r in t.orderBy("world_id", "part_id").collect()] for o, t in self.tables.items()}


def _both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a.unionByName(b) if a is not None and b is not None else None


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir, or one set here where it is unset and all executors are on
    this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found or DEFAULT_SHARED)
    return found or DEFAULT_SHARED


def written(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder.

    A checkpoint keeps the size that the planner estimated, which joins multiply. Of a table that is made of itself
    again and again the size's digits would double each time until the driver has no room for the number, so a size
    beyond a long is dropped with the plan that has it.
    """
    df = df.checkpoint()
    ran = df._jdf.queryExecution()
    if ran.optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(ran.toRdd(), df._jdf.schema(), False), spark)


def make(spark: SparkSession, schema: Schema, rows: dict[str, list[dict]], worlds: list[int] | None = None) -> World:
    """A batch from rows by table; world_id is 0 where a row has none, and part ids count from 1."""
    tables, seen = {}, set(worlds or [])
    for o in schema.obs:
        struct = schema.struct(o)
        given = []
        count: dict[int, int] = {}
        for r in rows.get(o, []):
            w = r.get("world_id", 0)
            count[w] = count.get(w, 0) + 1
            seen.add(w)
            given.append(tuple(w if n == "world_id" else r.get("part_id", count[w]) if n == "part_id" else r.get(n) for n in struct.names))
        tables[o] = spark.createDataFrame(given, struct)
    ids = spark.createDataFrame([(w,) for w in sorted(seen or {0})], "world_id bigint")
    return World(schema, tables, ids, one_world=len(seen) <= 1)


def repeated(world: World, n: int) -> World:
    """n copies of a single world, with ids 0 .. n - 1."""
    ids = world.spark.range(n).select(F.col("id").alias("world_id"))
    return replace(world, tables={o: t.drop("world_id").crossJoin(ids).select(*world.schema.struct(o).names) for o, t in world.tables.items()}, ids=ids, one_world=n == 1)


def graph_rows(vertices: int, edges: list[tuple[int, int]], **attrs: list[Any]) -> dict[str, list[dict]]:
    """Rows of a directed graph; attrs: values by vertex."""
    return {"V": [{k: v[i] for k, v in attrs.items()} for i in range(vertices)], "E": [{"src": a, "tgt": b} for a, b in edges]}
