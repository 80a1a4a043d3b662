"""N-gram Jaccard join on prefix trees.

Documents become sets of word shingles in one global order, rare shingles first. Two sets whose similarity reaches
the threshold share shingles in a short prefix of that order, so candidates meet by prefix; their whole sets are then
stored in a trie, which the probing set descends once, sharing the overlap of common beginnings and leaving a subtree
as soon as the words that remain can't reach the threshold. What survives is a link, and linked documents form
components.

How it stays whole and even at any size:
* Equal sets are one class from the start, told by a 64-bit digest, so copies never meet one another.
* The order needs only rough counts: a sketch of 2**SKETCH_BITS counters over all shingles of all documents. A
  wrong count costs time, never a link.
* A prefix is longer than it has to be, so that a pair must share needed() prefix shingles; a set that has fewer in
  common with all others together is out, which chance meetings don't survive.
* Every prefix shingle names as its hub the set that is most in touch with others, and all sets that have the shingle
  belong to that hub's region. Any two sets that share a shingle are so in one region. A region's sets are joined in
  one trie: the hub probes first, and then only sets that are not yet in the hub's component, so a large group of
  near copies costs a few probes and not all pairs.
* A region of more than LANE_KEYS keys is spread over lanes; what is outside of the hub's component after that also
  probes the other lanes.
* The sketch tells which shingles are in very many sets; these are dealt to several tasks by a salt.
* Copies are counted before they meet classes, and classes of more than a thousandth of all documents meet them by a
  broadcast of less than a thousand rows.

Nulls, empty texts and texts without words have an empty set, are linked with nothing, and their component is their
own id. A text of fewer words than a shingle is one shingle of all its words. Null ids are ignored by the minimum and
get the component of their texts; it is null where a component has no id. Repeated rows are kept. An empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import in_arrow, text_bytes, unused, written

SKETCH_BITS = 24
LANE_KEYS = 1 << 21
#: Sets with one shingle that one task takes.
HOT = 1 << 10
#: Digests that a task remembers, so that copies in it are sent once.
REMEMBERED = 200_000

_U = np.uint64


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    return np.fromiter(map(xxh64_intdigest, words), _U, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; one of the whole sequence where it is shorter; of none, none."""
    with np.errstate(over="ignore"):
        w = word_hashes(raw or b"")
        if len(w) == 0:
            return w
        width = min(n, len(w))
        k = np.full(len(w) - width + 1, _U(width))
        for j in range(width):
            k = _mix(k + w[j : len(w) - width + 1 + j] + _U(0x9E3779B97F4A7C15))
        return np.unique(k)


def digest(keys: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed integer."""
    from xxhash import xxh3_64_intdigest

    d = xxh3_64_intdigest(keys.tobytes())
    return d - (1 << 64) if d >= 1 << 63 else d


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set of a similarity of percent / 100 or more."""
    return (percent * n + 99) // 100


def needed(n: int, percent: int) -> int:
    """Prefix shingles that a set of n shares with any similar set that is as large or larger."""
    return min(2 + -(-(100 - percent) * n // 400), least_shared(n, percent))


def ordered(keys: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The keys of a set in global order: the sketch's rank in the upper 6 bits, 58 bits of the hash below."""
    with np.errstate(over="ignore"):
        rank = sketch[(keys >> _U(64 - int(len(sketch)).bit_length() + 1)).astype(np.int64)].astype(_U)
        return np.sort((rank << _U(58)) | (_mix(keys) >> _U(6)))


class Trie:
    """Ordered sets under their common beginnings; edges hold runs of keys."""

    def __init__(self):
        # by the first key: [run, trie below, most and least keys of a set from the run's start on]
        self.edges: dict[int, list] = {}
        self.ends: list[int] = []

    def add(self, keys: np.ndarray, name: int) -> None:
        node = self
        while len(keys):
            edge = node.edges.get(int(keys[0]))
            if edge is None:
                edge = node.edges[int(keys[0])] = [keys, Trie(), len(keys), len(keys)]
            run = edge[0]
            m = min(len(run), len(keys))
            differ = np.flatnonzero(run[:m] != keys[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):
                middle = Trie()
                middle.edges[int(run[same])] = [run[same:], edge[1], edge[2] - same, edge[3] - same]
                edge[0], edge[1] = run[:same], middle
            edge[2], edge[3] = max(edge[2], len(keys)), min(edge[3], len(keys))
            keys, node = keys[same:], edge[1]
        node.ends.append(name)

    def probe(self, keys: np.ndarray, percent: int):
        """Names of the stored sets with 100 * intersection >= percent * union."""
        n = len(keys)
        todo = [(self, 0, 0, 0)]  # node, keys stored on the way, shared of them, probe keys passed
        while todo:
            node, depth, shared, passed = todo.pop()
            if 100 * shared >= percent * (n + depth - shared):
                yield from node.ends
            for run, below, longest, shortest in node.edges.values():
                hits, at, high = shared, passed, longest
                for i in range(0, len(run), 64):
                    # at best all that remains of the shorter side is shared
                    most = hits + min(high, n - at)
                    if 100 * most < percent * max(n, depth + shortest, n + depth + shortest - most):
                        break
                    piece = run[i : i + 64]
                    place = at + np.searchsorted(keys[at:], piece)
                    hits += int(np.count_nonzero(keys[np.minimum(place, n - 1)] == piece))
                    at += int(np.searchsorted(keys[at:], piece[-1], side="right"))
                    high -= len(piece)
                else:
                    todo.append((below, depth + len(run), hits, at))


def _sets_and_sketch(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, doc_key, n_shingles, sig) and rows with counters of what a task has read."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("doc_key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        held = np.zeros(1 << bits, np.uint16)
        arrow = None
        for b in batches:
            ids, texts = b.column(0), text_bytes(b)
            arrow = ids.type
            sizes, sigs, shift = [], [], _U(64 - bits)
            for raw in texts:
                k = shingle_set(raw, n)
                sizes.append(len(k))
                sigs.append(digest(k))
                at = (k >> shift).astype(np.int64)
                held[at] = np.minimum(held[at], 65534) + 1
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([ids, b.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=schema.names)
        if arrow is not None:
            pieces = np.split(held, PARTS)
            used = [i for i, p in enumerate(pieces) if p.any()]
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, arrow), *[pa.nulls(m, pa.int64())] * 3, pa.array(used, pa.int32()), pa.array([zlib.compress(pieces[i].tobytes(), 1) for i in used], pa.binary())], names=schema.names)

    return in_arrow(docs.select("doc_id", "text", doc_key(docs).alias("doc_key")), run, schema)


def doc_key(docs: DataFrame) -> Column:
    """Tells rows of different ids or texts apart."""
    return F.xxhash64(docs["doc_id"], docs["text"])


#: Pieces of a sketch, each summed by itself.
PARTS = 64
#: Sketches are summed in two steps where more tasks than this have one.
ONE_STEP = 256


class Ranks:
    """The sketch as one byte a counter, a logarithm of the count, and how many counts a counter has on average."""

    def __init__(self, sums: np.ndarray):
        self.typical = max(1.0, float(sums.mean()))
        # third steps of log2: fine enough to tell one from two where counters are seldom shared
        self.table = np.clip(np.floor(3 * np.log2(sums.astype(np.float32) / np.float32(self.typical) + 1)), 0, 62).astype(np.uint8)

    def salts(self) -> list[int]:
        """By rank, among how many tasks the sets with such a shingle are dealt: HOT each, what other shingles may
        have added to the counter left aside."""
        return [max(1, math.ceil(self.typical * (2 ** ((r + 1) / 3) - 3) / HOT)) for r in range(63)]


def _ranks(seen: DataFrame, bits: int) -> Ranks:
    """2**bits counters at any input."""

    def add(key, table):
        import pyarrow as pa

        total = np.zeros((1 << bits) // PARTS, np.int64)
        for raw in table.column("counts"):
            raw = zlib.decompress(raw.as_py())
            # those of a single task have two bytes a counter
            total += np.frombuffer(raw, np.uint16 if len(raw) * PARTS == 2 << bits else np.uint32)
        raw = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([raw], pa.binary())})

    parts = seen.where("part is not null").select("part", "counts")
    tasks = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    if tasks > ONE_STEP:
        parts = parts.withColumn("lane", F.pmod(F.xxhash64("counts"), F.lit(math.isqrt(tasks)))).groupBy("part", "lane").applyInArrow(lambda key, table: add(key, table), "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(lambda key, table: add(key, table), "part int, counts binary").collect()
    sums = np.zeros(1 << bits, np.uint32)
    wide = (1 << bits) // PARTS
    for r in rows:
        sums[r["part"] * wide : (r["part"] + 1) * wide] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return Ranks(sums)


def _prefixes(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(token, sig, size): the prefix of each set."""

    def run(batches):
        import pyarrow as pa

        ranks, known = sketch.value, set()
        for texts in map(text_bytes, batches):
            tokens, sigs, sizes = [], [], []
            for raw in texts:
                k = shingle_set(raw, n)
                d = digest(k)
                if len(k) == 0 or d in known:
                    continue
                if len(known) == REMEMBERED:
                    known.clear()
                known.add(d)
                o = ordered(k, ranks)[: len(k) - least_shared(len(k), percent) + needed(len(k), percent)]
                tokens.append(o.view(np.int64))
                sigs.append(np.full(len(o), d, np.int64))
                sizes.append(np.full(len(o), len(k), np.int32))
            for i in range(0, len(tokens), 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[i : i + 500])) for x in (tokens, sigs, sizes)], names=["token", "sig", "size"])

    return in_arrow(docs.select("text"), run, "token bigint, sig bigint, size int")


def _chosen_sets(docs: DataFrame, n: int, sketch, bloom) -> DataFrame:
    """(sig, keys): ordered sets of the documents whose digest the filter may hold, copies included."""

    def run(batches):
        import pyarrow as pa

        ranks, bits, known = sketch.value, bloom.value, set()
        for texts in map(text_bytes, batches):
            sigs, keys = [], []
            for raw in texts:
                k = shingle_set(raw, n)
                d = digest(k)
                if d in known or not _hold(bits, np.array([d]))[0]:
                    continue
                if len(known) == REMEMBERED:
                    known.clear()
                known.add(d)
                sigs.append(d)
                keys.append(ordered(k, ranks).tobytes())
                if len(sigs) == 200:
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(keys, pa.binary())], names=["sig", "keys"])
                    sigs, keys = [], []
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(keys, pa.binary())], names=["sig", "keys"])

    return in_arrow(docs.select("text"), run, "sig bigint, keys binary")


#: Bits of a filter of digests, at most: 16 MB whatever the input. A filter may only let too many pass, and an exact
#: join follows.
MOST_BITS = 1 << 27


def _places(u: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of `size` bits, a power of two, for each digest."""
    return u & _U(size - 1), (u >> _U(32)) & _U(size - 1) ^ (u >> _U(59))


def _hold(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of the digests the filter may hold."""
    a, b = _places(digests.view(_U), len(bits) * 8)
    return (bits[a >> _U(3)] >> (a & _U(7)).astype(np.uint8) & bits[b >> _U(3)] >> (b & _U(7)).astype(np.uint8) & 1).astype(bool)


def _filter(digests: DataFrame, column: str) -> np.ndarray:
    """A filter over a column of digests, united from one for each of 8 slices: 16 bits a digest up to MOST_BITS."""
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * digests.count()).bit_length()))

    def make(frames):
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for b in frames:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U), size):
                bits[at.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in in_arrow(digests.select(column).coalesce(8), make, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


def _passed(docs: DataFrame, bits, hit: bool) -> DataFrame:
    """The rows whose doc_key the filter may hold, or can't hold: texts that are sure of their fate needn't be
    shuffled to learn it."""
    at = len(docs.columns)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = _hold(bits.value, b.column(at).to_numpy()) == hit
            yield pa.RecordBatch.from_arrays(b.columns[:at], names=b.schema.names[:at]).filter(pa.array(keep))

    return in_arrow(docs.withColumn(unused(docs, "key"), doc_key(docs)), run, docs.schema)


def _links(groups: DataFrame, percent: int, join) -> DataFrame:
    """What join(rows) says of each group (hub, lane); groups: hub, lane, sig, probe, keys."""

    def run(frames):
        import pyarrow as pa

        def out(found):
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "lane"])

        now, rows = None, []
        for b in frames:
            found = []
            for hub, lane, sig, probe, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (hub, lane) != now:
                    if rows:
                        found += join(now, rows)
                    now, rows = (hub, lane), []
                rows.append((sig, probe, np.frombuffer(raw, _U)))
            yield out(found)
        if rows:
            yield out(join(now, rows))

    dealt = groups.select("hub", "lane", "sig", "probe", "keys").repartition("hub", "lane").sortWithinPartitions("hub", "lane")
    return dealt.mapInArrow(run, "a bigint, b bigint, lane int")


def _probed(percent: int):
    """Rows marked as probes against the other rows of their group."""

    def join(now, rows):
        trie, found = Trie(), []
        for sig, probe, keys in rows:
            if not probe:
                trie.add(keys, sig)
        for sig, probe, keys in rows:
            if probe:
                found += [(sig, name, -1) for name in trie.probe(keys, percent) if name != sig]
        return found

    return join


def _spanned(percent: int):
    """Links that span the components of a group, and (hub, sig, lane) of sets that are outside of the hub's."""

    def join(now, rows):
        hub, lane = now
        sets = {sig: keys for sig, _, keys in rows}
        if len(sets) < 2:
            return []
        trie = Trie()
        for sig, keys in sets.items():
            trie.add(keys, sig)
        parent = {sig: sig for sig in sets}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # those that share most with the others first: they link most
        every = np.concatenate(list(sets.values()))
        kinds, times = np.unique(every, return_counts=True)
        touch = {sig: float(times[np.searchsorted(kinds, keys)].mean()) for sig, keys in sets.items()}
        found = []
        for sig in [hub, *sorted(sets, key=lambda x: (-touch[x], x))]:
            if sig == hub and found or sig not in sets or (sig != hub and top(sig) == top(hub)):
                continue
            for name in trie.probe(sets[sig], percent):
                x, y = top(sig), top(name)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((sig, name, -1))
        return found + [(hub, sig, lane) for sig in sets if top(sig) != top(hub)]

    return join


def _with_sets(df: DataFrame, sets: DataFrame) -> DataFrame:
    return df.join(sets.withColumnRenamed("sig", "_sig"), F.col("sig") == F.col("_sig")).drop("_sig")


def _region_links(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within regions (hub, sig, size), each hub being in its own. sets: (sig, keys), one row for each sig."""
    lanes = regions.groupBy("hub").agg(F.ceil(F.sum("size") / LANE_KEYS).cast("int").alias("lanes"))
    placed = regions.join(lanes, "hub").withColumn("lane", F.pmod(F.xxhash64("sig"), F.col("lanes")).cast("int"))
    hubs = lanes.select("hub", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("hub").alias("sig"))
    rows = placed.where("sig <> hub").select("hub", "lane", "sig", "lanes").unionByName(hubs.withColumn("lanes", F.lit(0)))
    wide = written(lanes.where("lanes > 1"), "ngram-wide")
    # sets go to their regions as they are read, unless they are needed again
    again = not wide.isEmpty()
    sets = written(sets, "ngram-sets") if again else sets
    found = written(_links(_with_sets(rows.withColumn("probe", F.lit(False)), sets), percent, _spanned(percent)), "ngram-region-links")
    if not again:
        return found.where("lane < 0").select("a", "b")
    # sets outside of their hub's component probe the region's other lanes
    rest = found.where("lane >= 0").select(F.col("a").alias("hub"), F.col("b").alias("sig"), F.col("lane").alias("own")).join(wide, "hub")
    probes = rest.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).where("lane <> own").select("hub", "lane", "sig", F.lit(True).alias("probe"))
    members = placed.join(wide.select("hub"), "hub", "left_semi").where("sig <> hub").select("hub", "lane", "sig", F.lit(False).alias("probe"))
    across = written(_links(_with_sets(members.unionByName(probes), sets), percent, _probed(percent)), "ngram-wide-links")
    return found.where("lane < 0").select("a", "b").unionByName(across.select("a", "b"))


def components(links: DataFrame, name: str = "ngram-components") -> DataFrame:
    """(sig, root): the least sig that is reachable by links, for each sig that has a link.

    Least labels spread over the links, and each round also takes the label of the label, so that chains halve.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    roots = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "sig")
    roots = written(roots, name)
    while True:
        near = both.join(roots, F.col("b") == F.col("sig")).groupBy(F.col("a").alias("sig")).agg(F.min("root").alias("near"))
        step = roots.join(near, "sig").select("sig", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("sig").alias("next"), F.col("root").alias("far"))
        step = written(step.join(jump, "next").select("sig", "root", F.least("next", "far").alias("next")), name)
        if step.where("root <> next").isEmpty():
            return roots
        roots = step.select("sig", F.col("next").alias("root"))


def _with_root(df: DataFrame, roots: DataFrame, key: str = "sig", name: str = "root") -> DataFrame:
    r = roots.select(F.col("sig").alias("_sig"), F.col("root").alias("_root"))
    return df.join(r, F.col(key) == F.col("_sig"), "left").withColumn(name, F.coalesce("_root", key)).drop("_sig", "_root")


def _in_touch(every: DataFrame, percent: int, salts: list[int]) -> DataFrame:
    """(token, salt, sig, size, touch) of the prefix shingles that may lead to a link.

    Counting takes turns between shingles and sets, and each turn is one shuffle: windows count where the rows lie.
    """
    many = F.element_at(F.array(*map(F.lit, salts)), F.shiftrightunsigned("token", 58).cast("int") + 1)
    rows = every.withColumn("salt", F.when(many > 1, F.pmod(F.xxhash64("sig"), many)).otherwise(0).cast("int"))
    by_token, by_sig = Window.partitionBy("token", "salt"), Window.partitionBy("sig")
    # a similar set is no smaller than this one's least overlap with it
    least = F.ceil(F.col("size") * percent / 100).cast("int")
    enough = F.least(2 + F.ceil((100 - percent) * least / 400).cast("int"), least)
    # copies that other tasks have seen as well
    rows = rows.withColumn("before", F.lag("sig").over(by_token.orderBy("sig"))).where("before is null or before <> sig").drop("before")
    for _ in range(2):
        rows = rows.withColumn("sets", F.count(F.lit(1)).over(by_token)).where((F.col("sets") > 1) | (many > 1))
        rows = rows.withColumn("shares", F.count(F.lit(1)).over(by_sig)).where(F.col("shares") >= enough).drop("shares")
    # a salted shingle is in more sets than one task counts; hubs need no more than a rough number
    rows = rows.withColumn("sets", F.count(F.lit(1)).over(by_token)).where((F.col("sets") > 1) | (many > 1)).withColumn("sets", F.col("sets") * many)
    return rows.withColumn("touch", F.sum(F.log2("sets")).over(by_sig)).select("token", "salt", many.alias("salts"), "sig", "size", "touch")


def classes(docs: DataFrame, n: int, percent: int, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc_key, n_shingles, sig) for each document, and the roots of the classes that are linked with another."""
    spark = docs.sparkSession
    seen = written(_sets_and_sketch(docs, n, bits), "ngram-seen")
    ranks = _ranks(seen, bits)
    sketch = spark.sparkContext.broadcast(ranks.table)
    live = written(_in_touch(_prefixes(docs, n, percent, sketch), percent, ranks.salts()), "ngram-live")
    best = live.groupBy("token").agg(F.max(F.struct("touch", "sig")).alias("best"), F.first("salts").alias("salts"))
    best = best.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("best.sig").alias("hub"))
    regions = live.select("token", "salt", "sig", "size").join(best, ["token", "salt"]).select("hub", "sig", "size").distinct()
    regions = written(regions, "ngram-regions")
    chosen = spark.sparkContext.broadcast(_filter(regions.select("sig").distinct(), "sig"))
    sets = _chosen_sets(docs, n, sketch, chosen).dropDuplicates(["sig"])
    roots = components(_region_links(regions, sets, percent))
    # what they were made for is written
    sketch.destroy()
    chosen.destroy()
    return seen.where("part is null").select("doc_id", "doc_key", "n_shingles", "sig"), roots


def linked(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), and sig, the digest of the set."""
    rows, roots = classes(docs, n, percent)
    full, empty = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    # copies are counted before they are joined with the components
    ids = written(_with_root(full.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), roots), "ngram-ids")
    least = ids.groupBy("root").agg(F.min("least").alias("component_id")).join(ids.select("sig", "root", "copies"), "root").select(F.col("sig").alias("_sig"), "component_id", "copies")
    least = written(least, "ngram-least")
    # fewer than a thousand classes can hold a thousandth of the documents each
    share = (least.agg(F.sum("copies")).first()[0] or 0) / 1000
    heavy, light = F.broadcast(least.where(F.col("copies") > share)), least.where(F.col("copies") <= share)
    same = F.col("sig") == F.col("_sig")
    found = full.join(heavy, same).unionByName(full.join(heavy, same, "left_anti").join(light, same))
    return found.select("doc_id", "n_shingles", "component_id", "sig").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sig"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of each component only one: that with the least id, nulls last.

    Documents with an empty set are linked with nothing and stay.
    """
    spark = docs.sparkSession
    rows, roots = classes(docs, n, percent)
    rows = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key")).alias("best")
    kept = _with_root(rows.groupBy("sig").agg(first), roots).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.doc_key").alias("best_key"))
    same = (F.col("doc_key") == F.col("best_key")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    # written, so that the joins' strategy follows the size of the tables
    gone = written(rows.join(kept, same, "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key")).distinct(), "ngram-gone")
    again = rows.groupBy("doc_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("doc_key")
    touched = written(gone.select(F.col("gone_key").alias("doc_key")).unionByName(again), "ngram-touched")
    if touched.isEmpty():
        return docs
    bits = spark.sparkContext.broadcast(_filter(touched, "doc_key"))
    key = unused(docs, "key")
    maybe = _passed(docs, bits, True)
    maybe = maybe.withColumn(key, doc_key(maybe))
    left = maybe.join(gone, (F.col(key) == gone["gone_key"]) & maybe["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
    # rows that are repeated with id and text
    return _passed(docs, bits, False).unionByName(left.dropDuplicates([key, "doc_id"]).drop(key))
