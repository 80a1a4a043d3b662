"""Best-fit packing into sequences of a fixed length, with exact complements first.

Documents are tokenised, end with token 0, and only those that are longer than a sequence are cut. How many pieces
there are of each length is all that the plan needs: at most SEQUENCE counts, whatever the corpus. An index tells for
each sum whether single lengths, pairs and triples that still have pieces add up to it. From the longest length down,
the gap that a length leaves is filled exactly by one, two or three others; where none do, the length that fits the gap
best goes there, which is the one that leaves the least, and the search goes on for what it leaves. A layout is used as
often as its pieces are there. The plan is a short list of layouts with a multiplicity. Pieces are
then numbered within their length, and number n of a length stands at a place of the layouts that n alone decides.

Ties: pieces of one length are interchangeable, and are numbered by lot, id, piece and row.
Nulls: a null text is empty, which is the one end token; a null id is kept. Repeated rows are pieces of their own.
Very long documents are cut, never dropped. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import in_arrow, written

SEQUENCE = 2048
END = 0
#: Pieces of one length are numbered in so many lots, so that a length that many pieces share is no single task.
LOTS = 256


@lru_cache(maxsize=2)
def _fast(name: str):
    """The file's vocabulary as ranks, whose ids are the tokenizer's and which is faster, and its special tokens.

    The tokenizers library takes special tokens out of a text; texts that hold one go to it.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=2)
def _exact(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, name: str = "byte_bpe_50k") -> list[int]:
    fast, special = _fast(name)
    if any(s in text for s in special):
        return _exact(name).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cut(ids: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces; only the first is shorter than size, and only of documents above it."""
    n = len(ids)
    if n <= size:
        return [(0, ids)]
    edges = [0, *range(n % size or size, n + 1, size)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:])]


class Sums:
    """An index of sums: how many lengths, pairs and triples of lengths add up to each sum, as far as there are pieces.

    Three pieces of a length are all that a combination can hold, so the index changes only where a count passes 3, 2
    or 1: `pairs` and `triples` then lose or win what holds so many of the length, a shift of the table below.
    """

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE):
        self.left = np.zeros(size + 1, np.int64)
        self.size, self.lengths = size, []
        self.at = np.zeros(size + 1, np.int64)  # 1 where there is a piece
        self.pairs, self.triples = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for k, n in counts.items():
            self.add(k, n)

    def _shift(self, table: np.ndarray, by: int, sign: int, to: np.ndarray) -> None:
        if by <= self.size:
            to[by:] += sign * table[: self.size + 1 - by]

    def _turn(self, x: int, copies: int, sign: int) -> None:
        """Combinations that hold so many of x come (1) or go (-1); x itself isn't in the tables that are shifted."""
        if copies == 1:
            self.at[x] = 0
            if sign < 0:
                self._shift(self.at, x, sign, self.pairs)
                self._shift(self.pairs, x, sign, self.triples)
                del self.lengths[bisect.bisect_left(self.lengths, x)]
            else:
                self._shift(self.pairs, x, sign, self.triples)
                self._shift(self.at, x, sign, self.pairs)
                self.at[x] = 1
                bisect.insort(self.lengths, x)
        elif copies == 2:
            self.at[x] = 0
            if 2 * x <= self.size:
                self.pairs[2 * x] += sign
            self._shift(self.at, 2 * x, sign, self.triples)
            self.at[x] = 1
        elif copies == 3 and 3 * x <= self.size:
            self.triples[3 * x] += sign

    def add(self, x: int, n: int) -> None:
        for copies in range(int(self.left[x]) + 1, min(3, int(self.left[x]) + n) + 1):
            self._turn(x, copies, 1)
        self.left[x] += n

    def take(self, x: int, n: int = 1) -> None:
        for copies in range(min(3, int(self.left[x])), max(0, int(self.left[x]) - n), -1):
            self._turn(x, copies, -1)
        self.left[x] -= n

    def _has(self, *wanted: int) -> bool:
        return all(self.left[x] >= wanted.count(x) for x in wanted)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, longest first, or None: the index says which of them there are."""
        if self.at[gap]:
            return (gap,)
        if self.pairs[gap]:
            for a in reversed(self.lengths[: bisect.bisect_left(self.lengths, gap)]):
                if self._has(a, gap - a):
                    return a, gap - a
        if self.triples[gap]:
            for a in reversed(self.lengths[: bisect.bisect_left(self.lengths, gap)]):
                rest = gap - a
                if rest < 2 or not self.pairs[rest]:
                    continue
                for b in reversed(self.lengths[: bisect.bisect_right(self.lengths, min(a, rest - 1))]):
                    if rest - b > b:
                        break
                    if self._has(a, b, rest - b):
                        return a, b, rest - b
        return None

    def largest(self, gap: int) -> int | None:
        """The length that leaves the least of the gap."""
        i = bisect.bisect_right(self.lengths, gap)
        return self.lengths[i - 1] if i else None


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Layouts (lengths in order) and how many sequences have each; together they hold every piece once.

    A layout is repeated as often as its pieces allow, so a plan has a few layouts for each length, not for each
    piece.
    """
    sums = Sums({k: n for k, n in counts.items() if n}, size)
    found: list[tuple[tuple[int, ...], int]] = []
    while sums.lengths:
        head = sums.lengths[-1]
        layout, gap = (head,), size - head
        sums.take(head)  # the head isn't there to fill its own gap
        while gap:
            # where nothing fills the gap, the length that fits it best, and then exactly what it leaves
            rest = sums.exact(gap) or ((x,) if (x := sums.largest(gap)) is not None else ())
            if not rest:
                break
            for x in rest:
                sums.take(x)
                gap -= x
            layout += rest
        used = Counter(layout)
        more = min(int(sums.left[x]) // n for x, n in used.items())
        for x, n in used.items():
            if more:
                sums.take(x, n * more)
        found.append((layout, 1 + more))
    return found


def placed(layouts: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, first sequence, offset, times): numbers first .. first + times - 1 of the length go to
    consecutive sequences, at that offset."""
    rows, seen, sequence = [], defaultdict(int), 0
    for layout, times in layouts:
        offset = 0
        for x in layout:
            rows.append((x, seen[x], sequence, offset, times))
            seen[x] += times
            offset += x
        sequence += times
    return rows


def pieces(docs: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, cols = [], ([], [], [], [])
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*token_ids(text or "", name), END], dtype="<u4")
                for k, (start, part) in enumerate(cut(ids)):
                    at.append(i)
                    for c, v in zip(cols, (k, start, len(part), crc32(part.tobytes()))):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def packed(docs: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    # the lot is part of the table: numbers within a length follow from it and stay what they are
    cut_up = written(pieces(docs, name).withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(LOTS)).cast("int")).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    lots = cut_up.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lots.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = placed(plan(counts))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    base = lots.select("length", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most SEQUENCE * LOTS rows, and at most SEQUENCE lengths of layouts
    numbered = cut_up.withColumn("inside", F.row_number().over(Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "row")) - 1)
    numbered = numbered.join(base, ["length", "lot"]).withColumn("n", F.col("base") + F.col("inside"))
    runs = defaultdict(list)
    for length, first, sequence, offset, times in rows:
        runs[length].append((first, sequence, offset, times))
    table = spark.createDataFrame([(k, v) for k, v in sorted(runs.items())], "length bigint, runs array<struct<first:bigint,sequence:bigint,offset:bigint,times:bigint>>")
    hit = F.filter("runs", lambda r: (r["first"] <= F.col("n")) & (F.col("n") < r["first"] + r["times"]))[0]
    return numbered.join(F.broadcast(table), "length").withColumn("hit", hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("hit.sequence") + F.col("n") - F.col("hit.first")).alias("sequence_id"), F.col("hit.offset").alias("offset")
    )
