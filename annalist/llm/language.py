"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in segments, forwards and backwards, and gives every
position a probability for each language; a document's are the means over its positions.
It is trained here, in numpy, by back-propagation through time.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches, smallest

HIDDEN, SEGMENT = 8, 96
#: training reads at most this many texts of each language, and this many segments of each text
TEXTS, SEGMENTS_OF_TEXT = 150, 4
STEPS, BATCH, RATE = 260, 160, 0.02
#: languages that are learned at most, those with most rows: bounds the sample to LANGUAGES * TEXTS texts
LANGUAGES = 512
#: a step reads segments of this many languages; steps grow with their number, features with its
#: root, and fewer segments of longer lists of languages are scored at once
TOGETHER, SCORED = 32, 4096
UNKNOWN = "und"


class Network:
    """Parameters; index 0 of the first axis reads forwards, 1 backwards. Arrays are (.., features, batch)."""

    def __init__(self, classes: int, seed: int = 4):
        random = np.random.default_rng(seed)
        h = self.hidden = HIDDEN * max(1, math.ceil((classes / TOGETHER) ** 0.5))
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        self.inputs = normal(2, 3 * h, 256, scale=0.3)
        self.recurrent = normal(2, 3 * h, h, scale=h**-0.5)
        self.output = normal(2, classes, h, scale=h**-0.5)
        self.bias = np.zeros((classes, 1), np.float32)

    def parameters(self):
        return [self.inputs, self.recurrent, self.output, self.bias]

    def step(self, state, data):
        """One time step of both directions; ``data`` holds their bytes, (2, batch)."""
        h = self.hidden
        read = np.stack([self.inputs[0].take(data[0], axis=1), self.inputs[1].take(data[1], axis=1)])
        kept = np.matmul(self.recurrent, state)
        gates = read[:, : 2 * h]
        gates += kept[:, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5  # sigmoid; update gates, then reset gates
        update, reset = gates[:, :h], gates[:, h:]
        candidate = read[:, 2 * h :]
        candidate += reset * kept[:, 2 * h :]
        np.tanh(candidate, out=candidate)
        return candidate + update * (state - candidate), update, reset, candidate, kept[:, 2 * h :]

    def scores(self, data):
        """Sums of both directions' scores, (time, classes, batch), and what training needs."""
        time, batch = data.shape
        both = np.stack([data, data[::-1]], axis=1)
        state = np.zeros((2, self.hidden, batch), np.float32)
        out = np.empty((2, time, self.output.shape[1], batch), np.float32)
        trace = []
        for t in range(time):
            before = state
            state, *gates = self.step(state, both[t])
            trace.append((before, state, *gates))
            scores = np.matmul(self.output, state)
            out[0, t], out[1, time - 1 - t] = scores[0], scores[1]
        return out[0] + out[1] + self.bias, both, trace

    def probabilities(self, data, used):
        """Mean probabilities over the used positions of segments, (classes, batch); keeps no trace."""
        time, batch = data.shape
        state = np.zeros((2, self.hidden, batch), np.float32)
        out = np.zeros((time, self.output.shape[1], batch), np.float32)
        for t in range(time):
            state = self.step(state, np.stack([data[t], data[time - 1 - t]]))[0]
            scores = np.matmul(self.output, state)
            out[t] += scores[0]
            out[time - 1 - t] += scores[1]
        out += self.bias
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return (out * used[:, None, :]).sum(axis=0)

    def gradients(self, data, used, labels):
        """Of the mean cross-entropy over used positions, by back-propagation through time."""
        h, (time, batch) = self.hidden, data.shape
        scores, both, trace = self.scores(data)
        wrong = np.exp(scores - scores.max(axis=1, keepdims=True))
        wrong /= wrong.sum(axis=1, keepdims=True)
        wrong[:, labels, np.arange(batch)] -= 1
        wrong *= (used / used.sum())[:, None, :]
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[3] += wrong.sum(axis=(0, 2))[:, None]
        back = np.zeros((2, h, batch), np.float32)
        transposed, out_transposed = self.recurrent.transpose(0, 2, 1), self.output.transpose(0, 2, 1)
        steps = np.empty((time, 2, 3 * h, batch), np.float32)
        for t in range(time - 1, -1, -1):
            before, state, update, reset, candidate, kept = trace[t]
            error = np.stack([wrong[t], wrong[time - 1 - t]])
            grads[2] += np.matmul(error, state.transpose(0, 2, 1))
            back = back + np.matmul(out_transposed, error)
            d_candidate = back * (1 - update) * (1 - candidate**2)
            d_update = back * (before - candidate) * update * (1 - update)
            d_reset = d_candidate * kept * reset * (1 - reset)
            d_read = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_kept = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            grads[1] += np.matmul(d_kept, before.transpose(0, 2, 1))
            back = back * update + np.matmul(transposed, d_kept)
            steps[t] = d_read
        for way in range(2):
            codes = both[:, way].ravel()
            for feature in range(3 * h):
                grads[0][way, feature] = np.bincount(codes, steps[:, way, feature].ravel(), 256)
        return grads


def segments(texts: list[bytes]):
    """Texts cut into segments: bytes and used positions, (SEGMENT, n), and each one's text."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts])
    data = np.zeros(counts.sum() * SEGMENT, np.uint8)
    used = np.zeros(len(data), bool)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
        used[at : at + len(text)] = True
        at += count * SEGMENT
    shape = (-1, SEGMENT)
    return data.reshape(shape).T.copy(), used.reshape(shape).T.astype(np.float32), np.repeat(np.arange(len(texts)), counts)


def train(texts: list[bytes], labels: list[int], classes: int) -> Network:
    network, random = Network(classes), np.random.default_rng(40)
    chosen, wanted = [], []
    for text, label in zip(texts, labels):
        starts = np.linspace(0, max(0, len(text) - SEGMENT), SEGMENTS_OF_TEXT).astype(int)
        for start in sorted(set(starts.tolist())):
            chosen.append(text[start : start + SEGMENT])
            wanted.append(label)
    data, used, _ = segments(chosen)
    wanted = np.array(wanted)
    by_class = [np.flatnonzero(wanted == c) for c in range(classes)]
    first, second = ([np.zeros_like(p) for p in network.parameters()] for _ in range(2))
    together = min(classes, TOGETHER)
    steps, turn = STEPS * math.ceil(classes / TOGETHER), list(range(classes))
    for step in range(1, steps + 1):
        rows = np.concatenate([random.choice(by_class[c], BATCH // together) for c in turn[:together]])
        if classes > TOGETHER:  # all in turn, in a new order each time
            turn = turn[TOGETHER:]
            if len(turn) < TOGETHER:
                turn += random.permutation(classes).tolist()
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        grads = network.gradients(data[:, rows], used[:, rows], wanted[rows])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        for p, g, m, v in zip(network.parameters(), grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


class Model:
    def __init__(self, languages: list[str], network: Network | None):
        self.languages, self.network = languages, network

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of every language over all positions of each non-empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        data, used, owner = segments(texts)
        width = max(1, SCORED * TOGETHER // max(TOGETHER, len(self.languages)))
        for start in range(0, data.shape[1], width):
            part = slice(start, start + width)
            found = self.network.probabilities(data[:, part], used[:, part])
            np.add.at(out, owner[part], found.T)
        return out / np.array([max(1, len(t)) for t in texts])[:, None]


def fit(docs: DataFrame, usable, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns the languages of the ``usable`` rows with a text and a language: all of them, or
    of a column with more than ``LANGUAGES`` values those with most rows, ties to the name that
    sorts first.

    Of each the ``TEXTS`` rows with the smallest hash of key and text, so that the sample is
    the same on every run and bounded by ``LANGUAGES * TEXTS`` rows.
    """
    rows = docs.filter(usable & F.col(text).isNotNull() & (F.col(text) != "") & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("order"), F.col(text).alias("text"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    rows = rows.join(F.broadcast(common), "lang", "left_semi")
    narrow = rows.select("lang", "order").distinct()
    chosen = smallest(narrow, "lang", "order", TEXTS)
    # only bytes near the segments that training reads
    spots = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS_OF_TEXT - 1)), lambda i: (i * F.greatest(F.length("text") - SEGMENT, F.lit(0)) / max(1, SEGMENTS_OF_TEXT - 1)).cast("int") + 1)
    parts = F.transform(spots, lambda at: F.substr("text", at, F.lit(SEGMENT)))
    sample = rows.join(F.broadcast(chosen), ["lang", "order"]).select("lang", "order", F.explode(F.array_distinct(parts)).alias("part"))
    picked = sorted((r["lang"], r["order"], r["part"]) for r in sample.distinct().collect())
    if not picked:
        return Model([], None)
    languages = sorted({r[0] for r in picked})
    number = {name: n for n, name in enumerate(languages)}
    return Model(languages, train([r[2].encode() for r in picked], [number[r[0]] for r in picked], len(languages)))


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model, keys=("doc_id",), text: str = "text") -> DataFrame:
    """``keys, lang_pred, score`` of every whole text, row by row, without a shuffle.

    ``score`` is the mean probability of the predicted language over all positions; ties go
    to the language that sorts first. NULL texts and those without a letter get ``und`` and
    0, and so does every text when there was nothing to learn from. Very long texts are read
    in blocks of segments. Columns other than ``keys`` and ``text`` are not read.
    """
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*keys, F.when(has_letter, F.col(text)).alias("_text"))

    def run(batches):
        once_per_process("language", object)  # drops what other operators keep
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            where = [i for i, t in enumerate(texts) if t is not None and model.languages]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if where:
                found = model.predict([texts[i].encode() for i in where])
                for i, best, p in zip(where, found.argmax(axis=1).tolist(), found.max(axis=1).tolist()):
                    names[i], scores[i] = model.languages[best], min(1.0, p)
            made = record_batch(PREDICTED, names, scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*batch.schema.names[:-1], *PREDICTED.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_text").schema)
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double")
