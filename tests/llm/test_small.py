"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from tessera.llm import chat_format, decontamination, lm_scoring, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, warc

DOCS = "doc_id bigint, text string, lang string, sig int, n bigint, hash string, token string"
LONG = " ".join(f"word{i} and" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "h", "t") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (None, None), (5, LONG), (6, "Naïve café line. " * 60), (7, "a@b.co 4111111111111111 or +1 (222) 555-0100 or 10.0.0.1"), (8, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word1 and word2 and word3 and word4 and word5 and"), (4, "12")], "item_id bigint, text string")


def test_sharding(odd, none):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == len(ODD)
    places = sorted((r["shard"], r["slot"]) for r in rows)
    assert len(set(places)) == len(rows)
    assert sharding.shard(none).count() == 0


def test_quality_rules(odd, none):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.verdicts(odd).collect()}
    assert rows[1, 0]["base_failed"] and not rows[1, 0]["kept"]
    assert rows[5, 60_000]["n_words"] == 60_000
    assert quality_rules.verdicts(none).count() == 0


def test_quality_classifier(odd, none, labels):
    rows = quality_classifier.scored(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert quality_classifier.scored(none, labels).count() == 0
    assert quality_classifier.scored(odd, labels.limit(0)).count() == len(ODD)
    assert quality_classifier.good(odd, labels).columns == odd.columns


def test_decontamination(odd, none, items):
    rows = {r["doc_id"]: r["contaminated"] for r in decontamination.verdicts(odd, items).collect()}
    assert rows[5] and not rows[1] and not rows[4]
    assert decontamination.verdicts(odd, items).count() == len(ODD)
    assert decontamination.verdicts(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontamination.verdicts(odd, items.limit(0)).collect())
    assert decontamination.clean(odd, items).columns == odd.columns


def test_pii(odd, none):
    rows = {(r["doc_id"], r["spans"]): r for r in pii.found(odd).collect()}
    hit = next(r for (i, _), r in rows.items() if i == 7)
    assert (hit["n_email"], hit["n_card"], hit["n_phone"], hit["n_ip"]) == (1, 1, 1, 1)
    assert pii.found(none).count() == 0
    after = pii.redacted(odd)
    assert after.columns == odd.columns and after.count() == len(ODD)
    assert after.where("doc_id = 7").first()["text"] == "<EMAIL> <CARD> or <PHONE> or <IP>"
    assert after.where("doc_id = 1").first()["text"] is None


def test_packing(odd, none):
    rows = packing.packed(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    assert packing.packed(none).count() == 0


def test_ngram_join(odd, none):
    rows = ngram_join.linked(odd, 3, 90).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[4] == (1, 4)
    assert next(r for r in rows if r["doc_id"] is None and r["n_shingles"] == 1)["component_id"] is None
    assert ngram_join.linked(none).count() == 0
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns and left.where("doc_id = 4").count() == 1 and left.count() == len(ODD) - 1


def test_lm_scoring(odd, none):
    rows = lm_scoring.scored(odd).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert lm_scoring.scored(none).count() == 0


def test_warc(spark):
    same = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://A.example/x?b=1&a=2", same), (2, None, same), (None, "http://a.example/", same), (3, "no url\r\nat all", None), (4, "http://a.example/", "short"), (5, "http://a.example/", "short"), (2, None, same)], "page_id bigint, url string, html string")
    rows = warc.archived(pages).collect()
    assert len(rows) == 7
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] > 1000)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 1000)
    assert warc.archived(pages.limit(0)).count() == 0


def test_chat_format(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", None), (None, None, None, None), (2, 0, "bot", "x"), (2, 0, "bot", "x"), (3, 0, "assistant", "late")], "conv_id bigint, turn bigint, role string, text string")
    rows = chat_format.formatted(turns).orderBy("conv_id", "seq").collect()
    assert len(rows) == 6
    text = "".join(r["fragment"] for r in rows if r["conv_id"] == 3)
    assert text == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert chat_format.formatted(turns.limit(0)).count() == 0


def test_further_columns_of_the_other_tables(spark, odd):
    """Columns of pages, conversations, labels and benchmark under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "time", "digest", "refers_to", "payload", "size", "first", "n", "hash", "width", "ways", "slots", "doc_key", "sig", "part", "seq", "salt", "fragment", "page", "quality_probability", "row", "lot"]

    def more(df):
        return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])

    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (None, None, None)], "page_id bigint, url string, html string")
    assert sorted(map(str, warc.archived(more(pages)).drop("range", "place").collect())) == sorted(map(str, warc.archived(pages).drop("range", "place").collect()))
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, None)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(str, chat_format.formatted(more(turns)).collect())) == sorted(map(str, chat_format.formatted(turns).collect()))
    items = spark.createDataFrame([(3, "word1 and word2 and word3 and word4 and word5 and")], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontamination.verdicts(more(odd), more(items)).collect() if r["contaminated"]} == {5}
    marked = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.scored(more(odd), more(marked)).count() == len(ODD)
    assert ngram_join.linked(more(odd)).count() == packing.packed(more(odd)).where("piece = 0").count() == len(ODD)
    assert ngram_join.one_of_each(more(odd)).columns == more(odd).columns
