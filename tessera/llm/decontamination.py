"""Benchmark decontamination on templates.

Numbers, names and units of documents and benchmark items become typed placeholders, so that a question whose
figures or persons were exchanged keeps its template. Windows of template words are hashed and joined by hash, and
windows with a placeholder also by their values, since those with fewer than LITERALS other words are no evidence as
templates, and with the names alone by value, since only capitals tell names: so a copy is found whatever its case
and line breaks. New names are found only where they are capitalised. The names in the slots of each matched passage must agree: a name of the item stands for one name of the
document throughout, and the other way round; windows that hold a name which doesn't are left out. Numbers and units
need not agree, since figures drawn anew coincide by chance. A document is contaminated by an item of whose windows
it holds the share `least_share`.

Only column expressions are used. The items' windows are joined as they come: Catalyst broadcasts them below its
size threshold and shuffles both sides by hash above it. Windows that documents share with items are written once, and
all that follows reads them: pairs of a document and an item are made only where it holds one of the item's key
windows, those that the fewest items share, one of which the least share implies.

Ties: items that a document holds to the same share are all named.

Nulls: null and empty texts hold no window and are clean; items with such a text match nothing. Items shorter than a
window are one window; those of fewer than LITERALS words with a placeholder among them (such as a lone number) match
only where they are the whole document. Repeated rows get the same verdict each, and a null id is kept. Empty tables:
with no documents nothing is returned, with no items every document is clean. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ASCII_SPACE, written

WINDOW = 8
#: Words of a window joined as a template that must not be placeholders.
LITERALS = 4
#: Places in `ways`: words with placeholders, those with names by value, words by value.
TYPED, NAMED, EXACT = range(3)
#: Units that become a placeholder where they follow a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr "
    "hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents usd eur gbp degree degrees kb mb gb tb hz khz mhz ghz w kw mw v a j kj mol"
).split()


#: What a word begins with that stands for a number, a name, a unit.
NUMBER, NAME, UNIT, WORD = "\u0001", "\u0002", "\u0003", "\u0004"


def _words(text: Column) -> Column:
    """Lower-case words without marks; numbers, names and units carry their mark in front of the value."""
    # a capitalised word within a sentence; the first word of a sentence is capitalised anyway
    named = F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}]+", " "), r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{Ll}'-]+", f"{NAME}$0")
    plain = F.regexp_replace(named, rf"[^\p{{L}}\p{{N}}{NAME}{ASCII_SPACE}.,:/]+|[.,:/](?![0-9])", "")
    digits = F.regexp_replace(plain, rf"(?<![^{ASCII_SPACE}])[.,:/]*(?=[0-9])", NUMBER)
    units = F.regexp_replace(digits, rf"(?<=[0-9] )(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"{UNIT}$0")
    return F.filter(F.split(F.lower(units), f"[{ASCII_SPACE}]+"), lambda w: w != "")


def templates(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """`key`, `slots` (pos, value, name) of the placeholders, and `ways`: hashes of the template's words, with names by value, and of all values."""
    # the words stand in a column of their own, so that each text is cut once
    words = df.select(*key, _words(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    value = lambda w: F.substring(w, 2, 1 << 30)
    typed = F.transform("words", lambda w: F.xxhash64(F.when(w < WORD, F.substring(w, 1, 1)).otherwise(w)))
    named = F.transform("words", lambda w: F.xxhash64(F.when(w.startswith(NAME), value(w)).when(w < WORD, F.substring(w, 1, 1)).otherwise(w)))
    exact = F.transform("words", lambda w: F.xxhash64(F.when(w < WORD, value(w)).otherwise(w)))
    slots = F.filter(F.transform("words", lambda w, i: F.when(w < WORD, F.struct(i.cast("int").alias("pos"), value(w).alias("value"), w.startswith(NAME).alias("name")))), lambda s: s.isNotNull())
    return words.select(*key, F.array(typed, named, exact).alias("ways"), slots.alias("slots"))


def _windows(df: DataFrame, widths: list[int], place: str, *columns: str) -> DataFrame:
    """`columns`, `place` of each window of each width and its `hash`, which tells widths apart. The rows are made
    before the hashes, so that these are compiled."""
    n = F.size("hashes")
    starts = F.when(n >= widths[0], F.sequence(F.lit(0), n - widths[0])).otherwise(F.array().cast("array<int>"))
    each = df.select(*columns, "hashes", F.explode(starts).alias(place))
    found = [F.when(F.col(place) + w <= n, F.xxhash64(F.lit(w), *[F.get("hashes", F.col(place) + j) for j in range(w)])) for w in widths]
    return each.select(*columns, place, (found[0] if len(found) == 1 else F.explode(F.array(*found))).alias("hash")).where("hash is not null")


def _inside(slots: Column, start: Column, width: Column) -> Column:
    return F.filter(slots, lambda s: (s["pos"] >= start) & (s["pos"] < start + width))


def _items(benchmark: DataFrame, window: int, least_share: float) -> tuple[DataFrame, list[int]]:
    """(item_id, n_windows, item_pos, hash, width, way, item_values, key) of the items' windows, and the widths there are.

    key: so many of an item's windows, those that the fewest items share, that whoever holds the share holds one.
    """
    items = templates(benchmark.select("item_id", "text").dropDuplicates(), ["item_id"]).withColumnRenamed("slots", "item_slots")
    items = written(items.withColumn("width", F.least(F.size(F.get("ways", F.lit(TYPED))), F.lit(window))).where("width > 0"), "benchmark-templates")
    found = None
    # at most `window` widths: that of the windows and those of shorter items
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    for width in widths:
        own = items.where(F.col("width") == width).select("item_id", "item_slots", "width", F.posexplode("ways").alias("way", "hashes"))
        own = _windows(own.withColumn("n_windows", F.size("hashes") - width + 1), [width], "item_pos", "item_id", "n_windows", "item_slots", "width", "way")
        own = own.withColumn("item_values", _inside(F.col("item_slots"), F.col("item_pos"), F.lit(width))).drop("item_slots")
        n_slots, n_names = F.size("item_values"), F.size(F.filter("item_values", lambda s: s["name"]))
        n_words = width - n_slots + F.when(F.col("way") == NAMED, n_names).otherwise(0)
        # a way that reads as the one before it adds nothing
        own = own.where(F.when(F.col("way") == EXACT, n_slots > 0).otherwise((n_words >= min(LITERALS, width)) & ((F.col("way") == TYPED) | (n_names > 0))))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return items, widths
    found = written(found, "benchmark-windows")
    shared = found.groupBy("hash").agg(F.count(F.lit(1)).alias("shared"))
    # an item's windows are no more than its words
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("shared", "item_pos"))
    places = found.join(shared, "hash").groupBy("item_id", "item_pos", "n_windows").agg(F.sum("shared").alias("shared")).withColumn("rank", rank)
    keys = places.where(F.col("rank") <= F.col("n_windows") - F.greatest(F.lit(1), F.ceil(F.col("n_windows") * least_share)) + 1).select("item_id", "item_pos", F.lit(True).alias("key"))
    return written(found.join(keys, ["item_id", "item_pos"], "left").withColumn("key", F.coalesce("key", F.lit(False))), "benchmark-keys"), widths


def matches(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """doc_key, doc_id, item_id, share, reparameterised for each document and item at or above the share.

    doc_key is a hash of the document's id and text. Texts are read once. A window that many documents and items share
    makes a row for each document, and for pairs only of those that hold one of the item's key windows.
    """
    own, widths = _items(benchmark, window, least_share)
    ids = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    if not widths:
        return docs.sparkSession.createDataFrame([], f"doc_key bigint, {ids}, share double, reparameterised boolean")
    # a text without placeholders reads the same all ways
    texts = templates(docs.select(doc_key(), "doc_id", "text"), ["doc_key", "doc_id"]).select("doc_key", "doc_id", "slots", F.explode(F.array_distinct("ways")).alias("hashes")).withColumn("n_words", F.size("hashes"))
    met = _windows(texts, widths, "pos", "doc_key", "doc_id", "slots", "n_words").join(own.select("hash").distinct(), "hash", "left_semi")
    # a window's own slots: no more than the widest window holds
    met = met.withColumn("slots", _inside(F.col("slots"), F.col("pos"), F.lit(widths[-1])))
    met = written(met, "decontamination-hits")
    document = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key"))
    pairs = met.join(own.where("key"), "hash").select(F.col("doc_key").alias("_key"), F.col("doc_id").alias("_id"), F.col("item_id").alias("_item")).distinct()
    found = met.join(pairs, document).join(own.drop("key"), ["hash"]).where("item_id <=> _item").drop("_key", "_id", "_item")
    found = found.where((F.col("width") >= LITERALS) | (F.col("way") != EXACT) | (F.col("n_words") == F.col("width")))
    shift = F.col("pos") - F.col("item_pos")
    # of windows met by value, a word may be a slot on one side only
    filled = F.transform(_inside(F.col("slots"), F.col("pos"), F.col("width")), lambda d: F.struct(F.get(F.filter("item_values", lambda i: i["pos"] + shift == d["pos"]), F.lit(0)).alias("slot"), d["value"].alias("value")))
    taken = F.transform(F.filter(filled, lambda f: f["slot"].isNotNull()), lambda f: F.struct(f["slot"]["value"].alias("of_item"), f["value"].alias("of_doc"), f["slot"]["name"].alias("name")))
    hits = found.select("doc_key", "doc_id", "item_id", "n_windows", "item_pos", shift.alias("shift"), taken.alias("pairs"))
    # one passage: the windows of an item at one shift; no more of them than the item has
    keys = ["doc_key", "doc_id", "item_id", "n_windows"]
    passages = hits.groupBy(*keys, "shift").agg(F.collect_set(F.struct("item_pos", "pairs")).alias("held"))
    names = F.filter(F.array_distinct(F.flatten(F.transform("held", lambda h: h["pairs"]))), lambda p: p["name"])
    clashing = F.filter("names", lambda p: F.exists("names", lambda q: (p["of_item"] == q["of_item"]) != (p["of_doc"] == q["of_doc"])))
    # a column before the rows are made, so that a passage's names are compared once
    each = passages.withColumn("names", names).withColumn("clashing", clashing).select(*keys, "clashing", F.explode("held").alias("held"))
    sound = each.where(~F.arrays_overlap("held.pairs", "clashing")).withColumn("changed", F.exists("held.pairs", lambda p: p["of_item"] != p["of_doc"]))
    covered = sound.groupBy(*keys, F.col("held.item_pos").alias("item_pos")).agg(F.max("changed").alias("changed"))
    shares = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("reparameterised"))
    return shares.select("doc_key", "doc_id", "item_id", (F.col("n") / F.col("n_windows")).alias("share"), "reparameterised").where(F.col("share") >= least_share)


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("doc_key")


def verdicts(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), best_share, reparameterised for every document."""
    found = matches(docs, benchmark, least_share, window).groupBy("doc_key", "doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("best_share"), F.max("reparameterised").alias("reparameterised"))
    found = found.withColumnsRenamed({"doc_key": "_key", "doc_id": "_id"})
    none = F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")
    return docs.select("doc_id", doc_key()).join(found, (F.col("doc_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("best_share").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised")
    )


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    # written first, so that the join's strategy follows the size of the table
    bad = written(matches(docs, benchmark, least_share, window).select(F.col("doc_key").alias("bad_key"), F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(bad, (F.xxhash64(docs["doc_id"], docs["text"]) == bad["bad_key"]) & docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
