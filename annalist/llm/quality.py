"""Quality classifier: votes of the most similar labelled documents in a latent space.

A document's terms describe how it is written: shapes of its words and of neighbouring
words, repeated words, how varied its words are, and its words themselves. A sample of
labelled documents spans the latent space (weighted term counts, singular vectors). Every
document is compared with all labelled vectors by exact cosine products, and its nearest
neighbours vote with weights by similarity.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches, smallest

#: hashed terms: word shapes, pairs of shapes, words, summaries
SHAPES, PAIRS, WORDS, SUMMARIES = 256, 768, 1024, 64
TERMS = SHAPES + PAIRS + WORDS + SUMMARIES
#: the sample holds at most this many documents of each label (those of smallest hash)
SAMPLE = 1_500
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 25, 4


def shape(word: str) -> str:
    """Classes of the characters of a whole word, runs shortened: ``Word!!`` -> ``Aa!!``, ``NO.`` -> ``AA.``."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        limit = 1 if kind == "a" else 2
        if out[-limit:] != [kind] * limit:
            out.append(kind)
    return "".join(out)


#: longer words are not kept from one occurrence to the next
REMEMBERED = 64


class WordTerms(dict):
    """Word -> its shape, hashed, times 2^32 plus its own hash."""

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh32_intdigest(shape(word)) << 32) | xxhash.xxh32_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) >= 300_000:
                self.clear()
            self[word] = value
        return value


def _level(share: float) -> int:
    return min(15, int(16 * share))


def term_counts(text: str, words: WordTerms) -> np.ndarray:
    """Counts of a whole text's terms; all zero without words."""
    parts = text.split()
    if not parts:
        return np.zeros(TERMS, np.float32)
    codes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    shapes, own = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    pairs = (shapes[:-1] * np.uint64(31) + shapes[1:]) % np.uint64(PAIRS)
    n = len(parts)
    again = int((codes[1:] == codes[:-1]).sum())
    varied = len(np.unique(own)) / n**0.85
    letters = np.isin(shapes, PLAIN).sum() / n
    lines = text.count("\n") + 1
    summary = [_level(again / n), 16 + _level(min(1.0, varied)), 32 + _level(letters), 48 + min(15, int(np.log2(1 + n / lines)))]
    out = np.bincount(np.concatenate([shapes % np.uint64(SHAPES), pairs + np.uint64(SHAPES), own % np.uint64(WORDS) + np.uint64(SHAPES + PAIRS)]).astype(np.int64), minlength=TERMS)
    out = out.astype(np.float32)
    # a summary counts as much as a term that every second word has
    out[[SHAPES + PAIRS + WORDS + s for s in summary]] = max(1, n // 2)
    return out


#: shapes of ordinary words
PLAIN = np.array([xxhash.xxh32_intdigest(s) for s in ("a", "Aa", "A", "a.", "a,", "Aa.", "Aa,")], np.uint64)


def singular_directions(rows: np.ndarray, count: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration, without a square matrix of terms."""
    basis = np.random.default_rng(5).standard_normal((rows.shape[1], count + 16)).astype(np.float32)
    for _ in range(12):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :count]


class Model:
    """Weights, latent directions, labelled vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        present = (counts > 0).sum(axis=0)
        weights = np.log((1 + len(counts)) / (1 + present)) + 0.3
        # terms of every kind get the same say
        kinds = np.repeat([1.0, 1.0, 0.3, 1.5], [SHAPES, PAIRS, WORDS, SUMMARIES])
        self.weights = (weights * kinds).astype(np.float32)
        rows = self._weighted(counts)
        self.directions = singular_directions(rows, DIMENSIONS)
        self.vectors = self.latent(counts)

    def _weighted(self, counts):
        rows = np.log1p(counts) * self.weights
        return rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))

    def latent(self, counts):
        rows = self._weighted(counts) @ self.directions
        return rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors.

        All cosines are computed. Vectors without a positive cosine to any neighbour, as of
        empty texts, get the sample's mean label.
        """
        cosines = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weights.sum(axis=1)
        voted = (weights * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, self.labels.mean()), 0, 1)


def _counts(rows: DataFrame, text: str) -> DataFrame:
    """Term counts as bytes, in place of the text column, which is the last."""

    def run(batches):
        words = once_per_process("quality words", WordTerms)
        for batch in small_batches(batches):
            made = [term_counts(t, words).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "counts"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(text).schema)
    return rows.mapInArrow(run, f"{kinds}, counts binary")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Learns from ``labels (key, label)``: at most ``SAMPLE`` documents of label 0 and of label 1.

    The sample has the labelled keys of smallest hash, the same on every run. Rows with a
    NULL or other label and those without a document are left out; None without any left.
    Of several documents with one key the text of smallest hash counts, whatever their order.
    """
    usable = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("label in (0, 1) and key is not null").distinct()
    chosen = smallest(usable.withColumn("order", F.xxhash64("key")), "label", "order", SAMPLE).drop("order")
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    single = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(single.alias("first")).select("key", "label", "first.text")
    found = sorted((r["key"], r["label"], bytes(r["counts"])) for r in _counts(rows, "text").collect())
    if not found:
        return None
    counts = np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(len(found), TERMS)
    return Model(counts, np.array([r[1] for r in found]))


SCORED = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model | None, keys=("doc_id",), text: str = "text") -> DataFrame:
    """``keys, score, predicted`` of every whole text, row by row, without a shuffle.

    ``score`` is between 0 and 1, higher when label 1 is likelier; ``predicted`` is 1 from 0.5
    on. NULL counts as empty. Without a model every score is 0.5. The labelled vectors, at
    most 2 * SAMPLE, are sent to every executor. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        words = once_per_process("quality words", WordTerms)
        fitted = shared.value
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = fitted.scores(np.stack([term_counts(t, words) for t in texts])) if fitted else np.full(len(texts), 0.5)
            made = record_batch(SCORED, found, (found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*batch.schema.names[:-1], *SCORED.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_text").schema)
    return source.mapInArrow(run, f"{kinds}, score double, predicted int")
