"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

Every row gets a global number, the permutation moves it to a place, and place % shards and place // shards are its
shard and slot. Shard and slot of any row number can so be computed without reading the data, and shards differ by
one row at most. All of it is column expressions.

Nulls: a null text counts as empty and a null id is a key like any other. Repeated rows get numbers of their own.
An empty table gives an empty result. Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows are numbered bucket by bucket. The table of buckets is broadcast, so their number is fixed.
BUCKETS = 8192
#: Steps of a cycle walk. The domain has at most one row of the square more than there are numbers, so a step
#: leaves it again with a probability of 1 - 1/sqrt(n); where n is small there are fewer places than steps.
WALK = 64
ROUNDS = 4
#: Rows that one task makes of a group of equal rows.
CHUNK = 10_000


def _network(place: Column, width: Column, height: Column, seed: int) -> Column:
    """A Feistel network on pairs (left < width, right < height); a bijection for any round function."""
    start = F.struct((place / height).cast("long").alias("l"), (place % height).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), width)) % width
        right = (s["r"] + F.pmod(F.xxhash64(F.lit(seed + 1), i, left), height)) % height
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * height + s["r"])


def permuted(number: Column, total: Column, seed: int = 1) -> Column:
    """The place in [0, total) of a row number in [0, total)."""
    width = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    height = F.ceil(total / width).cast("long")
    once = _network(number, width, height, seed)
    # few rows land outside; only those walk on
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda p, _: F.when(p < total, p).otherwise(_network(p, width, height, seed)))
    return F.when(once < total, once).when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows of `keys` and `count` with `first`, the global number of a group's first row, and `total`.

    Numbers follow (bucket of the keys' hash, keys), so they depend on the values alone and not on how the table is
    dealt out. Two small shuffles; only the sums by bucket pass through one task.
    """
    placed = groups.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    sums = placed.groupBy("bucket").agg(F.sum(count).alias("held"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(whole).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    # at most BUCKETS rows
    return within.join(F.broadcast(sums), "bucket").withColumn("first", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def shard(docs: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is `rows`.

    Rows that are equal in id, size and checksum are counted before the shuffle, so a value that a third of all rows
    share is one row until it is dealt out again in chunks.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    keys = ["doc_id", "size", "text_crc32"]
    groups = numbered(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), keys, "copies")
    chunks = groups.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    each = chunks.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("copies")) - 1)))
    placed = each.select(*keys, permuted(F.col("first") + F.col("nth"), F.col("total"), seed).alias("place"))
    return placed.select(
        *keys, F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
