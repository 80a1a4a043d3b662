"""Streams of row changes: a table and the matches of a rule that follow it, micro-batch by micro-batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.incremental import MatchCache
from tessera.operators.rewriting import Change
from tessera.rule import Rule
from tessera.world import World, shared


class Maintained:
    """A world and a match table that changes of one table are applied to.

    Changes are rows of the table with `change` (add, update, delete) and `seq`; of several for one row in a batch
    the last counts. Batches are numbered, and one that comes again after a failure is passed over.
    """

    def __init__(self, world: World, rule: Rule, ob: str):
        shared(world.spark)
        self.world, self.rule, self.ob = world, rule, ob
        self.cache = MatchCache.fresh(rule, world)
        self.last = -1

    @property
    def matches(self) -> DataFrame:
        return self.cache.legal(self.world)

    def take(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        names = self.world.schema.struct(self.ob).names
        row = F.max_by(F.struct("change", *names), "seq").alias("row")
        rows = batch.groupBy("world_id", "part_id").agg(row).select("row.*").checkpoint()
        keys = ["world_id", "part_id"]
        table = self.world.table(self.ob)
        there = table.join(rows.select(*keys), keys, "left_semi").select(*keys)
        fresh = rows.where("change <> 'delete'").select(*names)
        after = self.world.with_tables(**{self.ob: table.join(rows.select(*keys), keys, "left_anti").unionByName(fresh).checkpoint()})
        change = Change(after, {self.ob: there}, {self.ob: fresh}, {}, rows)
        self.cache = self.cache.updated(self.world, change).cut()
        self.world, self.last = replace(after), number


def follow(stream: DataFrame, state: Maintained, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of changes; trigger: as of DataStreamWriter.trigger, e.g. availableNow=True."""
    writer = stream.writeStream.foreachBatch(lambda df, n: state.take(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
