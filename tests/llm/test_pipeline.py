"""The pipeline's stages against brute force, on a small folder of tables; what they leave behind."""

import random
from pathlib import Path

import pytest

from tests.llm.test_methods import brute_components
from tessera.llm import common, packing, pii, quality_classifier

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, sig string, hash bigint"
ITEM = "If Anna buys 12 apples and sells 5 apples to Omar how many apples does Anna have at the end of the day"


def rows_of():
    rng = random.Random(31)

    def prose(n):
        return " ".join(f"w{rng.randrange(2000)}" for _ in range(n)) + "."

    texts = [prose(rng.randrange(60, 200)) for _ in range(40)]
    near = texts[0].split()
    near[7] = "other"
    texts += [texts[0], " ".join(near), texts[1].upper(), prose(100) + " mail me at some.one@example.org or +1 (222) 555-0100", prose(80) + " " + ITEM + " " + prose(80)]
    texts += [" ".join(["spam", "spam", "ham"] * rng.randrange(30, 60)) + f" {i}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, None), (900, None), (901, ""), (None, texts[9] + " end")]
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = rows_of()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 0 if (t or "").startswith("spam") else 1, 0) for i, t, *_ in rows if i is not None and i < 65 and i % 4]
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM, "k"), (2, None, "k")], "item_id bigint, text string, doc_id string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def stage_results(spark, folder):
    docs, found = common.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = common.new_folder(spark, f"test-{name}", owned=False)
        stage(spark, docs, folder).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    found = stage_results(spark, folder)
    rows = {name: sorted(map(tuple, df.collect()), key=str) for name, df in found.items()}
    for name in list(found)[:-1]:
        assert found[name].columns == docs.columns, name

    # 1: what the classifier accepts
    labels = common.table(spark, folder, "labels")
    said = quality_classifier.scored(docs, labels)
    assert len(rows["quality_classifier"]) == said.where("predicted = 1").count()
    assert not any((r[1] or "").startswith("spam") for r in rows["quality_classifier"]) and sum(r[1] is not None and r[1].startswith("w") for r in rows["quality_classifier"]) == 46

    # 2: the least id of each component; rows without words stay
    texts = dict(enumerate(r[1] or "" for r in rows["quality_classifier"]))
    group = {}
    for at, (size, top) in brute_components(texts, 5, 80).items():
        group.setdefault((top, at if size == 0 else -1), []).append(rows["quality_classifier"][at])
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, str(r))) for g in group.values()]
    assert [r[:2] for r in rows["ngram_join"]] == sorted((r[:2] for r in want), key=str)

    # 3 and 4: no benchmark item, no personal data
    assert [r[:2] for r in rows["decontamination"]] == [r[:2] for r in rows["ngram_join"] if ITEM not in (r[1] or "")] != [r[:2] for r in rows["ngram_join"]]
    field = pii.trained(found["decontamination"])
    masked = {r[0]: None if r[1] is None else pii.masked(r[1], pii.all_spans(r[1], field)) for r in rows["decontamination"]}
    for r in rows["pii"]:
        assert r[1] == masked[r[0]] or r[0] is None
        assert r[4] == (None if r[1] is None else len(r[1]))
    assert any("<EMAIL>" in (r[1] or "") and "<PHONE>" in r[1] for r in rows["pii"])

    # 5: all tokens, in sequences that hold them
    assert sum(r["length"] for r in found["packing"].collect()) == sum(len(packing.token_ids(r[1] or "")) + 1 for r in rows["pii"])


def test_run_is_its_stages_and_leaves_only_the_last_ones_tables(spark, folder):
    base = common.shared_dir(spark).removeprefix("file://")
    before = {p.name for p in Path(base, "tessera").glob("*")} if Path(base, "tessera").exists() else set()
    got = corpus_pipeline.run(spark, folder)
    want = stage_results(spark, folder)["packing"]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, want.select(*cols).collect())) != []
    left = {p.name for p in Path(base, "tessera").glob("*")} - before
    assert not any(n.startswith("stage-") for n in left)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.columns == again.columns


@pytest.mark.parametrize("part", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, folder, tmp_path, part):
    for name in ("documents", "labels", "benchmark"):
        t = common.table(spark, folder, name)
        (t.limit(0) if name == part else t).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (rows == 0) == (part == "documents")


def test_tables_belong_to_who_asked(spark):
    own: list[str] = []
    with common.owned_by(own):
        a = common.written(spark.range(3).toDF("x"), "test-own")
    b = common.written(spark.range(4).toDF("x"), "test-other")
    assert len(own) == 1 and a.count() == 3
    common.forget(spark, own)
    assert own == [] and b.count() == 4


def test_a_cluster_has_to_name_its_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
