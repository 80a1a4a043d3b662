"""Trajectories: measures of experience tables, and their Arrow and Parquet forms."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the interchange form.
COLUMNS = ("player", "turn", "action_rule_name", "done", "winner")
NOTHING = "nothing"


def win_rate(experiences: DataFrame, player: str) -> DataFrame:
    """One row, `win_rate`: of decisions that ended a world, the share that the player won; draws count, 0.0 if none."""
    won = F.col("winner").eqNullSafe(F.lit(player)).cast("double")
    return experiences.where("done").agg(F.coalesce(F.avg(won), F.lit(0.0)).alias("win_rate"))


def win_rates(experiences: DataFrame, by: list[Column | str], winner: str = "winner") -> DataFrame:
    """by, winner, wins, ended and win_rate of every winner."""
    ended = experiences.where("done")
    total = ended.groupBy(*by).agg(F.count(F.lit(1)).alias("ended"))
    wins = ended.where(F.col(winner).isNotNull()).groupBy(*by, winner).agg(F.count(F.lit(1)).alias("wins"))
    found = wins.join(total, list(by)) if by else wins.crossJoin(total)
    return found.withColumn("win_rate", F.col("wins") / F.col("ended"))


def episode_length(experiences: DataFrame) -> DataFrame:
    """world_id, length."""
    return experiences.groupBy("world_id").agg(F.count(F.lit(1)).alias("length"))


def action_counts(experiences: DataFrame) -> DataFrame:
    """action, n; decisions without an action are passes."""
    return experiences.groupBy(F.coalesce("action", F.lit("pass")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def summary(experiences: DataFrame) -> DataFrame:
    """One row for a batch: episodes, wins of each winner as a map, draws, mean length."""
    last = experiences.groupBy("world_id").agg(F.count(F.lit(1)).alias("length"), F.max(F.struct("step", "done", "winner")).alias("last")).select("length", "last.done", "last.winner")
    each = last.groupBy(F.when(F.col("done"), F.coalesce("winner", F.lit("draw"))).otherwise("open").alias("end")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    return each.agg(F.sum("n").alias("episodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("end", "n")))).alias("ends"), (F.sum("total") / F.sum("n")).alias("mean_length"))


def interchange(experiences: DataFrame) -> DataFrame:
    """The columns of the interchange form; missing values are the text "nothing"."""
    action = "action" if "action" in experiences.columns else "action_rule_name"
    return experiences.select(
        F.col("player").cast("string").alias("player"), F.col("turn").cast("int").alias("turn"), F.coalesce(F.col(action).cast("string"), F.lit(NOTHING)).alias("action_rule_name"), "done", F.coalesce(F.col("winner").cast("string"), F.lit(NOTHING)).alias("winner")
    )


def write_arrow(experiences: DataFrame, path: str) -> None:
    """One Arrow IPC file, written by the driver in record batches as partitions arrive; for trajectories that fit one
    file. Large ones go to write_parquet()."""
    import pyarrow as pa

    rows = interchange(experiences)
    schema = pa.schema([("player", pa.string()), ("turn", pa.int32()), ("action_rule_name", pa.string()), ("done", pa.bool_()), ("winner", pa.string())])
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema) as out:
        held: list = []
        for r in rows.toLocalIterator():
            held.append(r.asDict())
            if len(held) == 50_000:
                out.write_batch(pa.RecordBatch.from_pylist(held, schema))
                held = []
        if held:
            out.write_batch(pa.RecordBatch.from_pylist(held, schema))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an Arrow IPC file, as written: "nothing" stays."""
    import pyarrow as pa

    with pa.memory_map(path) as f:
        return spark.createDataFrame(pa.ipc.open_file(f).read_all())


def write_parquet(experiences: DataFrame, path: str) -> None:
    """All columns, by the executors."""
    experiences.write.parquet(path)


def restored(rows: DataFrame) -> DataFrame:
    """The interchange form with "nothing" as NULL."""
    return rows.withColumns({c: F.when(F.col(c) != NOTHING, F.col(c)) for c in ("action_rule_name", "winner")})


@dataclass(frozen=True, eq=False)
class Span:
    """Tables over the steps first .. last, in which rows of one table go: marked has them all, and _until is the step
    that deletes a row, NULL if none does."""

    tables: Mapping[str, DataFrame]
    ob: str
    marked: DataFrame
    first: int
    last: int


class After(Mapping):
    """The tables after a step of a span; each is made when it is asked for."""

    def __init__(self, span: Span, step: int):
        self.span, self.step = span, step

    def __getitem__(self, ob: str) -> DataFrame:
        if ob != self.span.ob:
            return self.span.tables[ob]
        return self.span.marked.where(F.col("_until").isNull() | (F.col("_until") > self.step)).drop("_until")

    def __iter__(self):
        return iter(self.span.tables)

    def __len__(self) -> int:
        return len(self.span.tables)


def reconstructed(events: DataFrame, snapshots: list[tuple[int, Mapping[str, DataFrame]]], ob: str) -> DataFrame:
    """Events that fired with the table `ob` as it was after their step; a span is one join for all its steps."""
    from functools import reduce

    fired = events.where("fired")
    if not snapshots:
        return fired.limit(0)
    found, single, steps = [], [], {}
    for step, t in snapshots:
        if isinstance(t, After):
            steps.setdefault(t.span, []).append(step)
        else:
            single.append(t[ob].withColumn("step", F.lit(step).cast("long")))
    if single:
        found.append(fired.join(reduce(DataFrame.unionByName, single), ["world_id", "step"]))
    for span, held in steps.items():
        rows = span.marked if span.ob == ob else span.tables[ob].withColumn("_until", F.lit(None).cast("long"))
        own = F.col("step").between(span.first, span.last) if len(held) == span.last - span.first + 1 else F.col("step").isin(held)
        both = fired.where(own).join(rows.withColumnRenamed("world_id", "_w"), (F.col("world_id") == F.col("_w")) & (F.col("_until").isNull() | (F.col("_until") > F.col("step"))))
        # the columns as a join by name gives them
        found.append(both.select("world_id", "step", *[c for c in fired.columns if c not in ("world_id", "step")], *[c for c in rows.columns if c not in ("world_id", "_until")]))
    return reduce(DataFrame.unionByName, found)
