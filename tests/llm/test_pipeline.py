import re

import corpus_pipeline
import pytest
from folia.llm import common, ngram_join

from .conftest import words
from .test_dedup_join import brute_components
from .test_tokens_packing import check_packed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, d, texts, labels, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_stages_decide(spark, tmp_path):
    texts = [(i, " ".join(words(1000 + i, 90, 3000) + (["vile"] * 3 if i % 6 == 0 else []))) for i in range(240)]
    near = texts[1][1].split()
    near[40] = "changed"
    item = " ".join(words(9999, 30, 3000))
    texts += [(300, " ".join(near)), (301, "word before " + item + " word after"), (302, texts[3][1] + " me.1@mail.example.com"), (303, None), (304, ""), (305, texts[5][1])]
    d = str(tmp_path)
    write(spark, d, texts, [(i, 1, int(i % 6 == 0)) for i in range(200)], [(0, item)])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["toxicity"] == {i for i, _ in texts} - {i for i in range(240) if i % 6 == 0}
    assert ids["near_duplicates"] == {i for i, _, c in brute_components([x for x in texts if x[0] in ids["toxicity"]], 5, 80) if i == c}
    assert 300 not in ids["near_duplicates"] and 305 not in ids["near_duplicates"] and {303, 304} <= ids["near_duplicates"]
    assert ids["decontamination"] == ids["near_duplicates"] - {301}
    after = {r.doc_id: r.text for r in seen["pii"]}
    for r in seen["decontamination"]:
        if r.text is None or "@" not in r.text:
            assert after[r.doc_id] == r.text
        else:
            assert "me.1@mail" not in after[r.doc_id] and re.search(r"\S+@\S+", after[r.doc_id])
    check_packed(seen["packing"], [(i, t) for i, t in after.items()])
    whole = corpus_pipeline.run(spark, d)
    assert whole.count() == len(seen["packing"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    write(spark, d, [], [], [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_join_boundary_follows_cost():
    assert ngram_join.boundary({}, 90) == 0
    assert ngram_join.boundary({5: 1000}, 90) >= 5


def test_stages_give_memory_back_first(spark, monkeypatch):
    class Begun(Exception):
        pass

    def begun(spark):
        raise Begun

    monkeypatch.setattr(common, "give_back", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def test_give_back_shrinks_a_grown_heap(spark):
    gateway, heap = spark.sparkContext._gateway, spark._jvm.java.lang.Runtime.getRuntime()
    common.give_back(spark)
    large = [gateway.new_array(spark._jvm.long, 30_000_000) for _ in range(6)]
    grown = heap.totalMemory()
    for x in large:
        gateway.detach(x)
    common.give_back(spark)
    assert heap.totalMemory() < 0.6 * grown


def test_memory_is_given_back_between_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", seen.append)
    monkeypatch.setattr(common, "GIVE_BACK_S", 0)
    common.materialize(spark.range(3), "plain")
    assert not seen
    with common.giving_back(spark):
        assert len(seen) == 1
        assert common.materialize(spark.range(3), "lean").count() == 3
        assert len(seen) == 2
    common.materialize(spark.range(3), "plain")
    assert len(seen) == 2
