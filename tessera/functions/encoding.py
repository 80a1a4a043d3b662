"""Codes of attribute values: ranks of ordered values, numbers of others, or a caller's own pair of functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbering import ranked


def ordinal(df: DataFrame, attr: str) -> DataFrame:
    """(value, code): distinct set values, 1 for the least."""
    return ranked(df.where(F.col(attr).isNotNull()).select(F.col(attr).alias("value")).distinct(), ["value"], "code")


def nominal(df: DataFrame, attr: str, seen: list[str]) -> DataFrame:
    """(value, code): distinct set values in the order in which they are first seen, by the columns `seen`."""
    first = df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("value")).agg(F.min(F.struct(*seen)).alias("at"))
    return ranked(first, ["at", "value"], "code").select("value", "code")


def extended(codes: DataFrame, values: DataFrame, ordered: bool) -> DataFrame:
    """A dictionary with more values: ranks shift, numbers are appended."""
    both = codes.select("value").unionByName(values.select("value")).where("value is not null").distinct()
    if ordered:
        return ranked(both, ["value"], "code")
    new = both.join(codes, "value", "left_anti")
    top = codes.agg(F.coalesce(F.max("code"), F.lit(0)).alias("top"))
    return codes.unionByName(ranked(new, ["value"], "after").crossJoin(top).select("value", (F.col("top") + F.col("after")).alias("code")))


def encode(df: DataFrame, attr: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """The code of each value under `name`; 0 for unset and unknown values."""
    c = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(c, F.col(attr) == F.col("_value"), "left").withColumn(name or f"{attr}_code", F.coalesce("_code", F.lit(0))).drop("_value", "_code")


def decode(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    """The value of each code under `name`; NULL for 0 and unknown codes."""
    c = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(c, F.col(code) == F.col("_code"), "left").withColumn(name, F.col("_value")).drop("_value", "_code")


@dataclass(frozen=True)
class Discretizer:
    """A caller's encoding and decoding; codes start at 1, and 0 stands for unset."""

    enc: Callable[[Column], Column]
    dec: Callable[[Column], Column]

    def encode(self, value: Column) -> Column:
        return F.when(value.isNull(), 0).otherwise(self.enc(value)).cast("long")

    def decode(self, code: Column) -> Column:
        return F.when(code != 0, self.dec(code))


def bins(cuts: list[float]) -> Discretizer:
    """Codes 1 .. len(cuts) + 1 by ascending cuts; a code decodes to its lower cut, the first to the first cut."""
    edges = F.array(*[F.lit(float(c)) for c in cuts])

    def enc(v: Column) -> Column:
        return 1 + F.size(F.filter(edges, lambda c: c <= v))

    return Discretizer(enc, lambda code: F.element_at(edges, F.greatest(code - 1, F.lit(1)).cast("int")))
