"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labelled; all other text is unlabelled and may be toxic
too. With the share ``prior`` of toxic documents in unlabelled text, the risk of a score g is

    prior * E_toxic[loss(g)] + max(0, E_unlabelled[loss(-g)] - prior * E_toxic[loss(-g)])

The second term estimates the risk on clean text without a clean example. Where a batch
makes it negative, which shows overfitting, it counts as 0.

A document's features are its distinct words and their beginnings, hashed, and those
beginnings that are dense in it, as stems with many endings are. What one word says counts
in full however long the text around it is, so only features take part whose share in toxic
text is well above that in clean text, which the prior gives too: (share in unlabelled -
prior * share in toxic) / (1 - prior). Else long texts would be learned by heart.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches, smallest

#: hashed words and beginnings, of so many letters; as many again for dense ones
FEATURES = 1 << 22
SHORTEST, LONGEST, DENSE = 4, 8, 128
#: the sample holds at most this many toxic and this many unlabelled documents (smallest hashes)
TOXIC, UNLABELLED = 1_500, 6_000
#: classifiers, each trained on batches and a start of its own; their scores are averaged
MEMBERS = 3
STEPS, BATCH, RATE = 1_500, 1_024, 0.03
#: penalty of squared weights, which keeps features that few documents have from deciding alone
RIDGE = 2e-4
#: pull of the bias towards the log odds of the prior
PULL = 0.03
#: a feature takes part if its share in toxic text is, against chance (likelihood ratio), above that in
#: unlabelled text, and so many times that in clean text
EVIDENCE, LIFT = 20.0, 3.0
WORDS = regex.compile(r"[\p{L}\p{M}]+")
#: words whose codes are kept from one occurrence to the next
REMEMBERED = 200_000


class WordCodes(dict):
    """Lower-case word -> its row in ``table``: codes of the whole word and of its beginnings."""

    def __init__(self):
        self.table = np.empty((REMEMBERED, 2 + LONGEST - SHORTEST), np.int32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        self.table[row] = xxhash.xxh32_intdigest(word + "$") % FEATURES
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            self.table[row, 1 + n - SHORTEST] = xxhash.xxh32_intdigest(word[:n]) % FEATURES
        self[word] = row
        return row


def features(text: str, codes: WordCodes) -> np.ndarray:
    """Sorted features of a whole text: its words and their beginnings, and once more, shifted by
    ``FEATURES``, those beginnings that several of its words share and at least every ``DENSE``-th has."""
    words = WORDS.findall(text.lower())
    made = []
    for start in range(0, len(words), REMEMBERED):  # as many as there is room for
        part = Counter(words[start : start + REMEMBERED])
        if len(codes) + len(part) > REMEMBERED:
            codes.clear()
        rows = np.fromiter(map(codes.__getitem__, part), np.int64, len(part))
        found = codes.table[rows]
        # a word's row repeats the code of the word where it is too short for a beginning
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :1]
        often = np.repeat(np.fromiter(part.values(), np.int64, len(part))[:, None], found.shape[1], axis=1)
        made.append((found[fresh], often[fresh]))
    if not made:
        return np.zeros(0, np.int32)
    found, often = (np.concatenate(c) for c in zip(*made))
    kinds, which, forms = np.unique(found, return_inverse=True, return_counts=True)
    total = np.bincount(which, often)
    dense = kinds[(forms > 1) & (total * DENSE >= len(words))]
    return np.concatenate([kinds, dense + np.int32(FEATURES)]).astype(np.int32)


class Rows:
    """Sets of features, one after another, as a matrix of zeros and ones."""

    def __init__(self, sets: list[np.ndarray]):
        self.columns = np.concatenate([*sets, np.zeros(0, np.int32)])
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)

    def __len__(self):
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the chosen rows, and for each the row's place among the chosen."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        place = np.repeat(np.arange(len(rows)), lengths)
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.columns[np.repeat(self.starts[rows], lengths) + offset], place


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk of scores under logistic loss: on toxic text, and on clean text,
    which may come out negative."""
    positive = prior * np.logaddexp(0, -toxic).mean()
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, toxic).mean()
    return float(positive), float(negative)


def slopes(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the risk for the scores of both; of its first term only, where the second is negative."""
    positive = -prior * sigmoid(-toxic) / len(toxic)
    if risk(toxic, unlabelled, prior)[1] < 0:
        return positive, np.zeros(len(unlabelled))
    return positive - prior * sigmoid(toxic) / len(toxic), sigmoid(unlabelled) / len(unlabelled)


class Member:
    """A linear classifier of features."""

    def __init__(self, size: int):
        self.weights, self.bias = np.zeros(size), 0.0

    def scores(self, columns: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
        return np.bincount(place, self.weights[columns], count) + self.bias

    def train(self, toxic: Rows, unlabelled: Rows, prior: float, seed: int) -> "Member":
        random = np.random.default_rng(seed)
        start = self.bias = math.log(prior / (1 - prior))
        moments = [np.zeros(len(self.weights)), np.zeros(len(self.weights)), 0.0, 0.0]
        size = len(self.weights)
        for step in range(1, STEPS + 1):
            chosen = [random.choice(len(rows), min(len(rows), BATCH), replace=False) for rows in (toxic, unlabelled)]
            p, u = toxic.take(chosen[0]), unlabelled.take(chosen[1])
            up, down = slopes(self.scores(*p, len(chosen[0])), self.scores(*u, len(chosen[1])), prior)
            gradient = np.bincount(p[0], up[p[1]], size) + np.bincount(u[0], down[u[1]], size) + RIDGE * self.weights
            # where the second term counts as 0, nothing would hold the bias
            bias = up.sum() + down.sum() + PULL * (self.bias - start)
            self._step(gradient, bias, moments, step, RATE * (1 - (step - 1) / STEPS))
        return self

    def _step(self, gradient, bias, moments, step, rate):
        first, second, b1, b2 = moments
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient * gradient - second)
        b1, b2 = b1 + 0.1 * (bias - b1), b2 + 0.001 * (bias * bias - b2)
        moments[2:] = [b1, b2]
        fix, spread = 1 - 0.9**step, 1 - 0.999**step
        self.weights -= rate * (first / fix) / (np.sqrt(second / spread) + 1e-8)
        self.bias -= rate * (b1 / fix) / (math.sqrt(b2 / spread) + 1e-8)


def different(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets without those that share half of their elements, as 32 minimum hashes tell, with an
    earlier one: a text that was copied often is one witness."""
    factors, offsets = np.random.default_rng(3).integers(1, 1 << 63, (2, 32), dtype=np.uint64) | np.uint64(1)
    hashes = lambda s: ((s.astype(np.uint64)[:, None] * factors + offsets) >> np.uint64(20)).min(axis=0)
    sketches = np.array([hashes(s) if len(s) else np.full(32, n, np.uint64) for n, s in enumerate(sets)])
    kept = []
    for n, sketch in enumerate(sketches):
        if not kept or ((sketches[kept] == sketch).sum(axis=1) < 16).all():
            kept.append(n)
    return [sets[n] for n in kept]


def telling(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Features that toxic text has more often than chance and clean text allow."""
    kinds, of_toxic = np.unique(np.concatenate(toxic), return_counts=True)
    of_all = np.zeros(len(kinds), np.int64)
    for columns in unlabelled if len(kinds) else ():
        at = np.minimum(np.searchsorted(kinds, columns), len(kinds) - 1)
        of_all[at[kinds[at] == columns]] += 1
    share = of_toxic / len(toxic)
    clean = np.maximum(of_all / len(unlabelled) - prior * share, 0) / (1 - prior)
    by_chance = len(toxic) * (of_all + 1) / (len(unlabelled) + 1)
    ratio = 2 * (of_toxic * np.log(np.maximum(of_toxic, 1) / by_chance) - (of_toxic - by_chance))
    return kinds[(of_toxic > by_chance) & (ratio >= EVIDENCE) & (share >= LIFT * clean)]


class Model:
    """Averaged members, over the telling features."""

    def __init__(self, toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float):
        self.prior = min(max(prior, 1e-4), 0.9)
        self.used = telling(different(toxic), unlabelled, self.prior)
        sets = [Rows([self._inner(s) for s in group]) for group in (toxic, unlabelled)]
        self.members = [Member(len(self.used)).train(*sets, self.prior, seed) for seed in range(MEMBERS)]
        # one matrix product serves all members
        self.weights = np.mean([m.weights for m in self.members], axis=0)
        self.bias = float(np.mean([m.bias for m in self.members]))

    def _inner(self, columns: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.used, columns)
        at[at == len(self.used)] = 0
        return at[self.used[at] == columns] if len(self.used) else columns[:0]

    def score(self, columns: np.ndarray) -> float:
        return float(sigmoid(np.array(self.weights[self._inner(columns)].sum() + self.bias)))


def _features(rows: DataFrame) -> DataFrame:
    """``toxic, features`` as bytes of ``toxic, text``."""

    def run(batches):
        codes = once_per_process("toxicity words", WordCodes)
        for batch in small_batches(batches):
            made = [features(t, codes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.binary())], names=["toxic", "features"])

    return rows.mapInArrow(run, "toxic int, features binary")


def fit(docs: DataFrame, labels: DataFrame, usable, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Learns from confirmed toxic documents of ``labels (key, label)`` and unlabelled text.

    ``usable`` is a condition on ``key``: labels and texts of other rows are not learned from.
    Of the keys with label 1 at most ``TOXIC``, and of all usable documents without regard to
    labels at most ``UNLABELLED``, those of smallest hash, so that the sample is the same on
    every run. The prior is the share of label 1 among all usable labels. Rows with a NULL or
    other label or key do not count; of several texts of one key each is a document; equal
    ones count once. None without a toxic or without an unlabelled document.
    """
    known = labels.filter(usable).select(F.col(key).alias("key"), F.col(label).alias("label")).filter("label in (0, 1) and key is not null").distinct()
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return None
    texts = docs.filter(usable).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("order", F.xxhash64("key", "text"))
    marked = known.filter("label = 1").select("key", F.xxhash64("key").alias("order"), F.lit(1).alias("toxic"))
    confirmed = smallest(marked, "toxic", "order", TOXIC)
    toxic = smallest(texts.join(F.broadcast(confirmed.select("key", "toxic")), "key").select("toxic", "order").distinct(), "toxic", "order", TOXIC)
    open_ = texts.select(F.lit(0).alias("toxic"), "order").distinct().orderBy("order").limit(UNLABELLED)
    # two small tables of hashes, at most TOXIC + UNLABELLED rows
    chosen = F.broadcast(toxic.select("toxic", "order").unionByName(open_.select("toxic", "order")))
    rows = texts.join(chosen, "order").select("toxic", "order", "text").dropDuplicates(["toxic", "order"])
    found = sorted((r["toxic"], bytes(r["features"])) for r in _features(rows.select("toxic", "text")).collect())
    sets = [[np.frombuffer(f, np.int32) for t, f in found if t == kind] for kind in (1, 0)]
    return Model(*sets, prior) if all(sets) else None


SCORED = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model | None, keys=("doc_id",), text: str = "text") -> DataFrame:
    """``keys, score, predicted`` of every whole text, row by row, without a shuffle.

    ``score`` is between 0 and 1, higher when label 1 is likelier; ``predicted`` is 1 from 0.5
    on. NULL counts as empty, whose score is that of a text without a telling word. Without a
    model every score is 0. The model, at most ``2 * FEATURES`` weights, is sent to every executor.
    Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        codes = once_per_process("toxicity words", WordCodes)
        fitted = shared.value
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [fitted.score(features(t, codes)) if fitted else 0.0 for t in texts]
            made = record_batch(SCORED, found, [int(s >= 0.5) for s in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*batch.schema.names[:-1], *SCORED.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_text").schema)
    return source.mapInArrow(run, f"{kinds}, score double, predicted int")
