import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import language
from annalist.llm.common import crc_bucket
from annalist.llm.queries import QUERIES


def test_gradients_against_differences():
    network = language.Network(3)
    data, used, _ = language.segments([b"some text", "größer".encode(), b"abc" * 20])
    labels = np.array([0, 1, 2])

    def loss():
        scores, _, _ = network.scores(data)
        scores = scores - scores.max(axis=1, keepdims=True)
        logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return -(logs[:, labels, np.arange(3)] * used).sum() / used.sum()

    for parameter, gradient in zip(network.parameters(), network.gradients(data, used, labels)):
        at = np.unravel_index(np.abs(gradient).argmax(), parameter.shape)
        value, width = parameter[at], 1e-2
        parameter[at] = value + width
        more = loss()
        parameter[at] = value - width
        less = loss()
        parameter[at] = value
        assert gradient[at] == pytest.approx((more - less) / (2 * width), rel=0.02, abs=1e-4)


def test_segments_cover_whole_texts():
    texts = [b"", b"a" * 96, b"b" * 97, b"c"]
    data, used, owner = language.segments(texts)
    assert used.sum() == sum(map(len, texts)) and owner.tolist() == [1, 2, 2, 3]


def by_position(model, text):
    """Probabilities of one text, one byte, one direction and one unit after the other."""
    net, h = model.network, model.network.hidden
    size = language.SEGMENT
    total = np.zeros(len(model.languages))

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def states(direction, data):
        state, out = [0.0] * h, []
        for byte in data:
            kept = [sum(float(net.recurrent[direction, g, j]) * state[j] for j in range(h)) for g in range(3 * h)]
            read = [float(net.inputs[direction, g, byte]) for g in range(3 * h)]
            update = [sigmoid(read[i] + kept[i]) for i in range(h)]
            reset = [sigmoid(read[h + i] + kept[h + i]) for i in range(h)]
            new = [np.tanh(read[2 * h + i] + reset[i] * kept[2 * h + i]) for i in range(h)]
            state = [u * s + (1 - u) * n for u, s, n in zip(update, state, new)]
            out.append(state)
        return out

    for start in range(0, len(text), size):
        part = text[start : start + size]
        padded = part + bytes(size - len(part))
        ahead, back = states(0, padded), states(1, padded[::-1])[::-1]
        for t in range(len(part)):
            scores = net.output[0].astype(float) @ ahead[t] + net.output[1].astype(float) @ back[t] + net.bias[:, 0]
            shares = np.exp(scores - scores.max())
            total += shares / shares.sum()
    return total / len(text)


def test_pooled_probabilities_against_one_position_at_a_time(spark):
    texts = ["a", "größer als " * 15, "x" * 96, "été " * 40 + "\0 end"]
    model = language.Model(["de", "en", "fr"], language.train([t.encode() for t in texts[:3]], [0, 1, 2], 3))
    expected = [by_position(model, t.encode()) for t in texts]
    assert np.allclose(model.predict([t.encode() for t in texts]), expected, atol=1e-4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in language.predict(docs, model).collect():
        best = expected[row.doc_id].argmax()
        assert row.lang_pred == model.languages[best] and row.score == pytest.approx(expected[row.doc_id][best], abs=1e-4)


def test_a_dirty_column_of_languages_is_bounded(spark, monkeypatch):
    """100,000 different values: those with most rows are learned."""
    monkeypatch.setattr(language, "STEPS", 20)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    dirty = spark.range(100_000).selectExpr("id as doc_id", "concat('word ', id) as text", "concat('x', id) as lang")
    clean = spark.range(30).selectExpr("-1 - id as doc_id", "concat('text ', id) as text", "element_at(array('fr', 'en', 'de'), cast(id % 3 as int) + 1) as lang")
    assert language.fit(dirty.unionByName(clean), F.lit(True)).languages == ["de", "en", "fr"]
    assert language.fit(dirty, F.lit(True)).languages == ["x0", "x1", "x10"]


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(documents, nothing):
    model = language.fit(documents, crc_bucket("doc_id", 5) != 9)
    assert model.languages == ["de", "en", "fr"]
    rows = language.predict(documents, model, keys=("doc_id", "row")).select("doc_id", "lang_pred").collect()
    assert len(rows) == documents.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {1, 2, 3, 8}
    empty = language.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in language.predict(documents, empty).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


def test_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 90)
    chance = random.Random(3)
    letters = {f"l{n:02}": chance.sample("abcdefghijklmnopqrstuvwxyz", 6) for n in range(44)}
    text = lambda name: "".join(chance.choice(letters[name] + [" "]) for _ in range(180))
    rows = [(n * 44 + i, text(name), name) for n in range(6) for i, name in enumerate(letters)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    model = language.fit(docs, F.lit(True))
    assert model.languages == sorted(letters)
    found = model.predict([text(name).encode() for name in letters]).argmax(axis=1)
    assert np.mean([model.languages[best] == name for best, name in zip(found, letters)]) > 0.9
