import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"
def is_query():
    return F.col("vec_id") % 10 == 0


def brute(rows, k):
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == len(rows[0][1])}
    out = {}
    for q, x in kept:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((np.float32(y).astype(float) - np.float32(x).astype(float)) ** 2).sum())), i) for i, y in kept if i != q)
            out[q] = near[:k]
    return out


def found(spark, scratch, rows, k=5):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in forest.nearest(table, is_query(), scratch, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_tables_are_searched_whole(spark, scratch):
    random = np.random.default_rng(1)
    rows = [(i, random.standard_normal(8).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # a vector that many rows share
    rows += [(3, rows[3][1]), (350, None), (360, [0.0] * 8), (370, [float("nan")] * 8), (380, [None] * 8), (390, [1.0] * 7), (None, rows[5][1])]
    expected, got = brute(rows, 5), found(spark, scratch, rows)
    assert got.keys() == expected.keys()
    for q, near in expected.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=0, atol=1e-12)


def test_few_candidates(spark, scratch):
    assert found(spark, scratch, [(0, [1.0, 2.0]), (1, [1.0, 0.0])]) == {0: [(2.0, 1)]}
    assert found(spark, scratch, []) == {}
    assert found(spark, scratch, [(10, None)]) == {}


def test_recall(spark, scratch, monkeypatch):
    monkeypatch.setattr(forest, "LEAST", 500)
    random = np.random.default_rng(3)
    centres = random.standard_normal((40, 16)) * 3
    rows = [(i, (centres[i % 40] + random.standard_normal(16)).tolist()) for i in range(4000)]
    expected, got = brute(rows, 5), found(spark, scratch, rows)
    hits = [len({i for _, i in got[q]} & {i for _, i in near}) / 5 for q, near in expected.items()]
    assert np.mean(hits) >= 0.9


def test_recall_on_the_given_table(spark, scratch, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    hits = []
    for r in forest.nearest(table, is_query(), scratch, k=10).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        near = sorted((((x - rows[r.query_id]) ** 2).sum(), i) for i, x in rows.items() if i != r.query_id)[:10]
        hits.append(len({i for _, i in near} & set(r.ids)) / 10)
    assert len(hits) == sum(i % 10 == 0 for i in rows) and np.mean(hits) >= 0.9


@pytest.mark.parametrize("bits", [4, 48])
def test_medians_balance_the_bits(bits):
    sample = np.random.default_rng(5).standard_normal((1000, 6))
    planes, medians = forest.directions(sample, 3, bits)
    assert np.abs((sample.astype(np.float32) @ planes > medians).mean(axis=0) - 0.5).max() < 0.01
