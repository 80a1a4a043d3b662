"""Language-model scores from a log-bilinear model.

Tokens of a text are its words, A-Z in lower case, and one end. The model predicts units: the commonest WORDS words,
the end, and BUCKETS classes of the other words by their last three bytes. The log-probability of a unit is bilinear
in a vector of the unit before it and a vector of its own, plus a bias, and normalised over all units. A word in a
class gets the class's probability times its smoothed share of the class, with one share for unseen words, so the
score is the log10 of a proper probability of the whole text.

All counts are taken over all training documents: words, and pairs of units. The vectors are trained in numpy by
noise-contrastive estimation on the table of pairs, which has UNITS**2 rows at most: each of SHARDS tasks holds the
contexts that hash to it, tells the pairs from unigram noise (the noise term is summed over all units, not sampled,
as batched matrix products), and the shards' output vectors are averaged after each round. Counts of the KNOWN commonest words are broadcast, which bounds the broadcast;
rarer words of a text are looked up by joining 64-bit hashes.

Nulls: a null text is empty, which is the end alone; a null id counts as the empty text in the fold. Repeated rows
are learned from and scored as often as they occur. With no training documents every token is unseen. An empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import crc_of_id, in_arrow, text_bytes, written

WORDS, BUCKETS = 7168, 1023
#: Unit 0 is the end, and what comes before the first word.
UNITS = 1 + WORDS + BUCKETS
KNOWN = 1 << 17
#: Longer words are held by a digest.
LONGEST = 64
SHARDS, ROUNDS, EPOCHS, DIM, NOISE = 8, 3, 8, 32, 4.0
LN10 = float(np.log(10))


def bucket(word: bytes) -> int:
    return 1 + WORDS + crc32(word[-3:]) % BUCKETS


def held_as(word: bytes) -> bytes:
    """What a word is told by in the tables: itself, or a digest behind a byte that no text holds."""
    if len(word) <= LONGEST:
        return word
    from xxhash import xxh3_128_digest

    return b"\xff" + xxh3_128_digest(word)


def signed(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _word_counts(docs: DataFrame) -> DataFrame:
    """hash, word, bucket, n of the words of the texts."""

    def run(batches):
        import pyarrow as pa

        def out(count):
            items = iter(count.items())
            while part := list(islice(items, 100_000)):
                words = [w for w, _ in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signed(w) for w in words], pa.int64()), pa.array([held_as(w) for w in words], pa.binary()), pa.array([bucket(w) for w in words], pa.int32()), pa.array([n for _, n in part], pa.int64())],
                    names=["hash", "word", "bucket", "n"],
                )

        count: Counter = Counter()
        for b in batches:
            for raw in text_bytes(b):
                count.update((raw or b"").lower().split())
                if len(count) > 400_000:
                    yield from out(count)
                    count.clear()
        yield from out(count)

    return in_arrow(docs.select("text"), run, "hash bigint, word binary, bucket int, n bigint")


def _pair_counts(docs: DataFrame, units) -> DataFrame:
    """pair (before * UNITS + unit) and n over the texts."""

    def run(batches):
        import pyarrow as pa

        get = units.value.get
        held, size = [], 0

        def out():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(pair), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 200_000].astype(np.int64)), pa.array(n[i : i + 200_000].astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for raw in text_bytes(b):
                ids = [get(w if len(w) <= LONGEST else held_as(w)) or bucket(w) for w in (raw or b"").lower().split()]
                seq = np.array([0, *ids, 0], np.int64)
                held.append((seq[:-1] * UNITS + seq[1:]).astype(np.int32))
                size += len(seq)
                if size > 8_000_000:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return in_arrow(docs.select("text"), run, "pair bigint, n bigint")


def train_shard(before: np.ndarray, after: np.ndarray, n: np.ndarray, h: np.ndarray, q: np.ndarray, b: np.ndarray, noise: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Noise-contrastive estimation over the contexts `before`, with Adagrad steps on batches of contexts.

    h, q, b: vectors of contexts and of units, and biases. noise: the units' unigram shares. Gives the contexts, their
    vectors, q and b.
    """
    contexts, row = np.unique(before, return_inverse=True)
    h, q, b = h[contexts].copy(), q.copy(), b.copy()
    total = np.bincount(row, weights=n, minlength=len(contexts)).astype(np.float32)
    order = np.argsort(row, kind="stable")
    row, after, n = row[order], after[order], n[order].astype(np.float32)
    edge = np.searchsorted(row, np.arange(len(contexts) + 1))
    shift = np.log(NOISE * np.maximum(noise, 1e-12)).astype(np.float32)
    share = noise.astype(np.float32)
    # how much a context weighs: damped, so that rare contexts learn too
    weight = np.sqrt(total) / max(1e-9, float(np.sqrt(total).mean()))
    gh, gq, gb = np.full_like(h, 1e-6), np.full_like(q, 1e-6), np.full_like(b, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(contexts)), max(1, len(contexts) // 64)):
            seen = np.zeros((len(part), len(b)), np.float32)
            for i, c in enumerate(part):
                s = slice(edge[c], edge[c + 1])
                seen[i, after[s]] = n[s] / total[c]
            hp = h[part]
            # P(pair, not noise); its derivative by the score is seen * (1 - p) - NOISE * share * p
            p = 1 / (1 + np.exp(-np.clip(hp @ q.T + b - shift, -30, 30)))
            d = (seen * (1 - p) - NOISE * share * p) * weight[part, None]
            for value, grad, held, at in ((h, d @ q - 1e-4 * hp, gh, part), (q, d.T @ hp - 1e-5 * q, gq, slice(None)), (b, d.sum(axis=0), gb, slice(None))):
                held[at] += grad**2
                value[at] += 0.1 * grad / np.sqrt(held[at])
    return contexts, h, q, b


class Model:
    """Vectors, biases and normalisers; log-probabilities of units are natural."""

    def __init__(self, share: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h = rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32)
        self.b = np.log(np.maximum(share, 1e-12)).astype(np.float32)

    def normalise(self) -> None:
        self.log_z = np.empty(UNITS, np.float64)
        for i in range(0, UNITS, 512):
            s = (self.h[i : i + 512] @ self.q.T + self.b).astype(np.float64)
            top = s.max(axis=1)
            self.log_z[i : i + 512] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))

    def log_p(self, before: np.ndarray, units: np.ndarray) -> float:
        """Sum over the pairs."""
        total = 0.0
        for i in range(0, len(units), 50_000):
            a, c = before[i : i + 50_000], units[i : i + 50_000]
            total += float(np.einsum("ij,ij->i", self.h[a], self.q[c]).sum(dtype=np.float64) + self.b[c].sum(dtype=np.float64) - self.log_z[a].sum())
        return total


def _trained(pairs: DataFrame, share: np.ndarray, seed: int = 1) -> Model:
    spark = pairs.sparkSession
    model = Model(share, seed)
    if pairs.isEmpty():
        model.normalise()
        return model
    dealt = pairs.select((F.col("pair") / UNITS).cast("long").cast("int").alias("before"), (F.col("pair") % UNITS).cast("int").alias("after"), "n").withColumn("shard", F.pmod(F.hash("before"), F.lit(SHARDS)))
    dealt = written(dealt.repartition(SHARDS, "shard"), "lm-pairs")
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.h, model.q, model.b))

        def one(key, t):
            import pyarrow as pa

            before, after, n = (t.column(c).to_numpy() for c in ("before", "after", "n"))
            contexts, h, q, b = train_shard(before, after, n.astype(float), *sent.value, share, EPOCHS, seed + turn)
            blob = [x.tobytes() for x in (contexts.astype(np.int32), h.astype(np.float32), q.astype(np.float32), b.astype(np.float32))]
            return pa.table({k: pa.array([v], pa.binary()) for k, v in zip(("contexts", "h", "q", "b"), blob)} | {"weight": pa.array([float(n.sum())])})

        # a shard has a fixed part of UNITS**2 pairs at most
        rows = dealt.groupBy("shard").applyInArrow(lambda key, t: one(key, t), "contexts binary, h binary, q binary, b binary, weight double").collect()
        total = sum(r["weight"] for r in rows)
        model.q, model.b = np.zeros_like(model.q), np.zeros_like(model.b)
        for r in rows:
            model.h[np.frombuffer(r["contexts"], np.int32)] = np.frombuffer(r["h"], np.float32).reshape(-1, DIM)
            model.q += np.frombuffer(r["q"], np.float32).reshape(-1, DIM) * np.float32(r["weight"] / total)
            model.b += np.frombuffer(r["b"], np.float32) * np.float32(r["weight"] / total)
        sent.unpersist()
    model.normalise()
    return model


def _parts(docs: DataFrame, shared) -> DataFrame:
    """What the broadcast tables say of each text, and the hashes and counts of its other words."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        import pyarrow as pa

        model, code, unit_of, log_c, log_share, end_log, end_seen, log_n = shared.value
        get = code.get
        for b in batches:
            cols = ([], [], [], [], [], [])
            for raw in text_bytes(b):
                words = (raw or b"").lower().split()
                codes = np.fromiter((get(w if len(w) <= LONGEST else held_as(w), -1) for w in words), np.int64, len(words))
                other = codes < 0
                units = unit_of[codes]
                rare: Counter = Counter()
                for i in np.flatnonzero(other):
                    units[i] = bucket(words[i])
                    rare[signed(words[i])] += 1
                seq = np.concatenate([units, [0]])
                # log10 of counts of known words; in a class, a word's share needs the class's size as well
                known = float(log_c[codes[~other]].sum()) + end_log
                inside = float(log_c[codes[~other & (units > WORDS)]].sum()) - float(log_share[units[units > WORDS] - 1 - WORDS].sum())
                score = model.log_p(np.concatenate([[0], units]), seq) / LN10 + inside
                for c, v in zip(cols, (len(seq), int((~other).sum()) + end_seen, known - len(seq) * log_n, score, list(rare), list(rare.values()))):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=schema.names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def _commonest(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most KNOWN words with their counts, commonest first: those above a count that a histogram gives, and as many
    as there is room for of those at it, by a hash.

    A histogram has a few thousand bins whatever the corpus, and only the chosen words leave the executors.
    """
    size = F.floor(64 * F.log2("n")).cast("int")
    bins = sorted(counts.groupBy(size.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)
    room, chosen = KNOWN, F.lit(False)
    for r in bins:
        if r["words"] > room:
            share = min(1.0, room / r["words"])
            chosen = chosen | ((size == r["bin"]) & (F.xxhash64("word") <= min(2**63 - 1, int(share * 2**64) - 2**63)))
            break
        room, chosen = room - r["words"], size >= r["bin"]
    # in Arrow: as rows of Python objects they would be many times larger
    top = counts.where(chosen).select("word", "n").toArrow()
    top = top.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, KNOWN)
    return top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    held = crc_of_id(F.col("doc_id")) % 10 == 0
    train = docs.where(~held).select("text")
    counted = _word_counts(train).groupBy("hash", "bucket").agg(F.sum("n").alias("n"), F.max("word").alias("word"))
    counts = written(counted, "lm-words")
    ends = train.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    words, times = _commonest(counts)
    unit = {w: i + 1 for i, w in enumerate(words[:WORDS])}
    classes = counts.join(F.broadcast(spark.createDataFrame([(k,) for k in unit] or [(b"\x00",)], "word binary")), "word", "left_anti").groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    in_class, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in classes:
        in_class[r["bucket"] - 1 - WORDS], kinds[r["bucket"] - 1 - WORDS] = r["n"], r["v"]
    seen = np.concatenate([[ends], times[:WORDS], np.zeros(WORDS - len(unit)), in_class]) + 0.1
    pairs = written(_pair_counts(train, spark.sparkContext.broadcast(unit)).groupBy("pair").agg(F.sum("n").alias("n")), "lm-pair-counts")
    model = _trained(pairs, seen / seen.sum())

    code = {w: i for i, w in enumerate(words)}
    bucket_of = {r["word"]: r["bucket"] for r in counts.where(F.octet_length("word") == 17).where(F.substring("word", 1, 1) == F.lit(b"\xff")).join(F.broadcast(spark.createDataFrame([(w,) for w in words if w[:1] == b"\xff"] or [(b"",)], "word binary")), "word").select("word", "bucket").collect()}
    del words
    unit_of = np.array([unit.get(w) or bucket_of.get(w) or bucket(w) for w in code] + [0], np.int64)
    log_c = np.log10(np.append(times, 0.0) + 0.1)
    log_share = np.log10(in_class + 0.1 * (kinds + 1))
    shared = spark.sparkContext.broadcast((model, code, unit_of, log_c, log_share, float(np.log10(ends + 0.1)), int(ends > 0), float(np.log10(total + 0.1 * (distinct + 1)))))
    parts = written(_parts(docs, shared).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    each = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    # none of these words is common, so neither side has a hot key
    found = each.join(counts.groupBy("hash").agg(F.sum("n").alias("n")), "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return parts.join(rare, "row", "left").select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score")
    )
