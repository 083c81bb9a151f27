"""The pipeline on a small folder of tables, against what each stage must do to planted documents."""

import random

import pytest

from test_models import VOICES, document, sentence

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    good = {i: document(rnd, True) for i in range(150)}
    bad = {1000 + i: document(rnd, False) for i in range(60)}
    item = " ".join(f"bench{k}" for k in range(20))
    near = {}
    for k in range(10):
        lines = [[VOICES[(7 * j + 3 * i + k) % 35] + VOICES[(5 * i + j * k) % 35] for j in range(14)] for i in range(6)]
        near[2000 + k] = "\n".join(" ".join(w).capitalize() + "." for w in lines)
        near[2100 + k] = "\n".join(" ".join(["New", *w[1:-1], "words."]) for w in lines)  # two words of each line
    shared = "All rights in this little text are reserved by its owners."
    extra = {3000: f"{good[3]}\n{shared}", 3001: f"{sentence(rnd)} Mine.\n{shared}", 3002: f"{sentence(rnd)} and {item} {sentence(rnd)}", 3003: good[7]}
    texts = good | bad | near | extra
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(4000, None, None, None, None), (4001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000)) for i in [*range(60), *range(1000, 1040)]], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["quality_crf"]
    assert sum(i in first for i in good) >= 148 and sum(i in first for i in bad) <= 4 and not {4000, 4001} & set(first)
    second = kept["line_dedup"]
    assert 3003 not in second and second[3001].text.endswith("Mine.") and second[3000].text == shared
    assert second[3001].n_chars == len(second[3001].text) and sum(i in second for i in good if i in first) >= 140
    third = kept["jaccard_join"]
    assert all(2000 + k in third and 2100 + k not in third for k in range(10))
    assert set(second) - set(third) <= set(near)
    fourth = kept["decontaminate"]
    assert set(third) - set(fourth) == {3002}
    result = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(result) == set(fourth) and all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in result.values())


def test_odd_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows = [(i, document(rnd, True), None, None, None) for i in range(20)] + [(None, document(rnd, True), "en", "s", 3), (30, None, None, None, 1), (3, None, "en", None, 1), (31, " \n ", "en", "s", 3)]
    rows += [(32, "\n".join(sentence(rnd) for _ in range(20_000)), "en", "s", 1)] + [rows[0]] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("quality", "gone", "row", "id", "home", "bucket", "tokens", "ids", "item_id", "kind"):
        docs = docs.withColumn(c, F.lit("own"))
    spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "x"), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = stage(spark, docs, str(tmp_path)).cache()
        if name != "bpe":
            assert out.columns == docs.columns and {r["home"] for r in out.collect()} == {"own"}
        assert {None, 0, 32} <= {r.doc_id for r in out.collect()}, name
    assert pipeline.run(spark, str(tmp_path)).collect() == []
