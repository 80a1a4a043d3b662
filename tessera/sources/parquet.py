"""Worlds from files: one table a source, with natural keys as part ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import Schema, reflect
from tessera.world import World


def keyed(df: DataFrame, key: str | None, homs: Iterable[str] = (), world: int = 0) -> DataFrame:
    """world_id, part_id and all columns. key: the column of natural keys, or None for a hash of the whole row.

    Keys and foreign keys become BIGINT once, here, so that joins compare equal types. The key column stays.
    """
    part = F.col(key).cast("long") if key else F.xxhash64(*df.columns)
    homs = set(homs)
    return df.select(F.lit(world).cast("long").alias("world_id"), part.alias("part_id"), *[F.col(c).cast("long").alias(c) if c in homs else F.col(c) for c in df.columns])


def from_tables(tables: dict[str, tuple[DataFrame, str | None]], homs: dict[str, tuple[str, str]], checked: bool = False) -> World:
    """One world of DataFrames with the names of their key columns."""
    made = {o: keyed(df, key, [h for h, (a, _) in homs.items() if a == o]) for o, (df, key) in tables.items()}
    spark = next(iter(made.values())).sparkSession
    return World(reflect(made, homs), made, spark.range(1).select(F.col("id").alias("world_id")), one_world=True, checked=checked)


#: Keys and foreign keys of the driver's tables.
TABLE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "labels": None}
TABLE_HOMS = {
    "n_regionkey": ("nation", "region"), "c_nationkey": ("customer", "nation"), "s_nationkey": ("supplier", "nation"), "o_custkey": ("orders", "customer"), "l_orderkey": ("lineitem", "orders"),
    "l_partkey": ("lineitem", "part"), "l_suppkey": ("lineitem", "supplier"), "user_id": ("events", "customer"),
}


def star_world(spark: SparkSession, sf_dir: str, obs: Iterable[str] = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) -> World:
    """The star schema of a folder as a world; its foreign keys are sound."""
    obs = tuple(obs)
    tables = {o: (spark.read.parquet(f"{sf_dir}/{o}.parquet"), TABLE_KEYS[o]) for o in obs}
    return from_tables(tables, {h: (a, b) for h, (a, b) in TABLE_HOMS.items() if a in obs and b in obs}, checked=True)


def read(spark: SparkSession, schema: Schema, folder: str, fmt: str = "parquet", **options) -> World:
    """A batch that write() has left in a folder."""
    tables = {o: spark.read.format(fmt).options(**options).schema(schema.struct(o)).load(f"{folder}/{o}") for o in schema.obs}
    return World(schema, tables, spark.read.format(fmt).options(**options).schema("world_id bigint").load(f"{folder}/_worlds"))


def write(world: World, folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """All tables of a batch below a folder."""
    for o, t in world.tables.items():
        t.write.format(fmt).mode(mode).save(f"{folder}/{o}")
    world.ids.write.format(fmt).mode(mode).save(f"{folder}/_worlds")
