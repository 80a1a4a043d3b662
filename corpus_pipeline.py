"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept. A stage's result has to be written before the next stage
is called, since that first deletes the tables which its predecessor left in the shared folder; run() does so, and
so does whoever walks STAGES. Tables of other queries stay.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, ngram_join, packing, pii, quality_classifier
from tessera.llm.common import forget, new_folder, owned_by, table

#: Tables that the latest stage has left in the shared folder.
_LEFT: list[str] = []


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _LEFT)
        with owned_by(_LEFT):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.good(docs, table(spark, sf_dir, "labels"))


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redacted(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs)


STAGES = [("quality_classifier", classify), ("ngram_join", deduplicate), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]

#: The stages hold a trained model, a trie join and a packing plan: nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written to the shared folder and read again."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}", owned=False)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        forget(spark, read)
        read.append(path)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # packing has written the pieces, and reads nothing else
    forget(spark, read)
    return packed
