import numpy as np
from pyspark.sql import functions as F

from annalist.llm import quality
from annalist.llm.queries import QUERIES


def test_shapes():
    assert [quality.shape(w) for w in ("word", "Word.", "NOISE!!!!", "a1b22", "x###")] == ["a", "Aa.", "AA!!", "a0a00", "a##"]


def test_votes_against_brute_force():
    random = np.random.default_rng(1)
    counts = random.poisson(0.05, (200, quality.TERMS)).astype(np.float32)
    model = quality.Model(counts, random.integers(0, 2, 200))
    asked = random.poisson(0.05, (20, quality.TERMS)).astype(np.float32)
    for row, score in zip(model.latent(asked), model.scores(asked)):
        cosines = [float(v @ row) for v in model.vectors]
        near = sorted(range(200), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        weights = [max(0.0, cosines[i]) ** quality.SHARPNESS for i in near]
        assert abs(score - sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights)) < 1e-4


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_edge_cases(spark, documents, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (8, 0), (10, 0), (2, 0), (2, 1), (99, 1), (6, None), (None, 1), (7, 3)], "doc_id bigint, quality int")
    model = quality.fit(documents, labels)
    assert sorted(model.labels) == [0, 0, 0, 1, 1, 1]
    rows = quality.score(documents, model, keys=("doc_id", "row")).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(nothing, model).count() == 0
    untrained = quality.fit(documents, labels.filter(F.lit(False)))
    assert untrained is None and {r.score for r in quality.score(documents, untrained).collect()} == {0.5}


def test_whole_words_have_a_shape():
    long = "a" * 40 + "1234!"
    assert quality.shape(long) == "a00!" and quality.shape("a1" * 30) == "a0" * 30
    same, other = ("word " * 20 + w for w in ("ab1-" * 15 + "x!", "ab1-" * 15 + "x?"))
    words = quality.WordTerms()
    assert (quality.term_counts(same, words) != quality.term_counts(other, words)).any()
    assert set(words) == {"word"} | {w for w in words if len(w) <= quality.REMEMBERED}


def test_texts_of_one_key_in_any_order(spark):
    docs = spark.createDataFrame([(1, "Plain words here."), (1, "NOISE!! ### 99"), (2, "Other words.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    orders = (docs.orderBy("text").coalesce(1), docs.orderBy(F.desc("text")).coalesce(1), docs.repartition(3))
    models = [quality.fit(d, labels) for d in orders]
    assert all((m.vectors == models[0].vectors).all() for m in models)
