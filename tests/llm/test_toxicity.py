import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from annalist.llm import toxicity
from annalist.llm.common import crc_bucket
from annalist.llm.queries import QUERIES


def code(part):
    return xxhash.xxh32_intdigest(part) % toxicity.FEATURES


def brute_features(text):
    words = toxicity.WORDS.findall(text.lower())
    kinds = {}
    for w in set(words):
        for part in {w + "$", *(w[:n] for n in range(toxicity.SHORTEST, min(toxicity.LONGEST, len(w)) + 1))}:
            kinds.setdefault(code(part), []).append(w)
    dense = [k + toxicity.FEATURES for k, own in kinds.items() if len(set(own)) > 1 and sum(words.count(w) for w in own) * toxicity.DENSE >= len(words)]
    return sorted([*kinds, *dense])


def test_features_against_brute_force(monkeypatch):
    texts = ["", "12 !!", "Word word words wordy", "ab abc abcd abcde", "stemone stemtwo " + "other " * 300, "a" * 3000 + " " + "a" * 2999, "Grüße straßen 日本語"]
    codes = toxicity.WordCodes()
    for text in texts:
        assert toxicity.features(text, codes).tolist() == brute_features(text)
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)  # words are forgotten again
    small = toxicity.WordCodes()
    for text in texts[:4]:
        assert set(toxicity.features(text, small)) <= set(brute_features(text)) | {f + toxicity.FEATURES for f in brute_features(text)}
        assert set(x for x in toxicity.features(text, small) if x < toxicity.FEATURES) == set(x for x in brute_features(text) if x < toxicity.FEATURES)


def test_slopes_against_differences():
    random = np.random.default_rng(1)
    clipped = 0
    for shift in (-4, 0, 4):
        toxic, unlabelled = random.normal(2, 2, 7), random.normal(shift, 2, 9)
        value = lambda p, u: (lambda r: r[0] + max(0, r[1]))(toxicity.risk(p, u, 0.3))
        clipped += toxicity.risk(toxic, unlabelled, 0.3)[1] < 0
        up, down = toxicity.slopes(toxic, unlabelled, 0.3)
        for n in range(7):
            step = np.eye(7)[n] * 1e-6
            assert math.isclose(up[n], (value(toxic + step, unlabelled) - value(toxic - step, unlabelled)) / 2e-6, abs_tol=1e-6)
        for n in range(9):
            step = np.eye(9)[n] * 1e-6
            assert math.isclose(down[n], (value(toxic, unlabelled + step) - value(toxic, unlabelled - step)) / 2e-6, abs_tol=1e-6)
    assert 0 < clipped < 3


def test_learns_without_clean_labels():
    """Unlabelled sets hold toxic ones too; these must not count as clean."""
    random = np.random.default_rng(2)
    sets = lambda n, toxic: [np.unique(np.append(random.integers(100, 3000, 40), random.integers(0, 8, 3) if toxic else [])).astype(np.int32) for _ in range(n)]
    model = toxicity.Model(sets(150, True), sets(120, True) + sets(880, False), 0.12)
    assert set(range(8)) <= set(model.used)
    assert np.mean([model.score(s) >= 0.5 for s in sets(200, True)]) > 0.95
    assert np.mean([model.score(s) >= 0.5 for s in sets(500, False)]) < 0.02


def test_copies_are_one_witness():
    base = np.arange(50, dtype=np.int32)
    near = [np.unique(np.append(base[2:], 1000 + n)).astype(np.int32) for n in range(20)]
    other = np.arange(200, 260, dtype=np.int32)
    empty = np.zeros(0, np.int32)
    assert [len(s) for s in toxicity.different([base, *near, other, empty, empty])] == [50, 60, 0, 0]


def test_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op11_toxicity"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) > 0.8
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 0]) < 0.01
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_edge_cases(spark, documents, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (8, 0), (10, 0), (2, 1), (2, 0), (99, 1), (6, None), (None, 1), (7, 3)], "doc_id bigint, toxic int")
    every = F.col("doc_id").isNotNull()
    model = toxicity.fit(documents, labels, every)
    rows = toxicity.score(documents, model, keys=("doc_id", "row")).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    for untrained in (toxicity.fit(documents, labels.filter("toxic = 0"), every), toxicity.fit(nothing, labels, every), toxicity.fit(documents, labels, F.lit(False))):
        assert untrained is None and {r.score for r in toxicity.score(documents, untrained).collect()} == {0.0}


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and text {'insult' if i % 5 == 0 else 'plain'} here") for i in range(200)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    usable = crc_bucket("doc_id", 5) != 0
    first = toxicity.fit(docs, labels, usable)
    changed = docs.withColumn("text", F.when(usable, F.col("text")).otherwise("something else insult"))
    turned = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    second = toxicity.fit(changed, turned, usable)
    assert (first.weights == second.weights).all() and first.bias == second.bias
