"""Lempel-Ziv phrase fingerprints: texts that compress well together look alike.

A text is parsed into phrases, each the longest known one and one more character. The set
of phrases is hashed into a minimum-hash signature; the share of equal registers estimates
how many phrases two texts have in common.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import record_batch, small_batches

REGISTERS = 64
EMPTY = np.uint32(0xFFFFFFFF)
#: stands for a NULL key in the order of documents
LOWEST = -(1 << 63)


def parse(text: str, phrases: set[str], rest: str = "") -> tuple[list[str], str]:
    """New phrases of ``text`` in order, added to ``phrases``, and the known end that is left."""
    new = []
    for character in text:
        rest += character
        if rest not in phrases:
            phrases.add(rest)
            new.append(rest)
            rest = ""
    return new, rest


def signature(phrases: list[str], size: int = REGISTERS) -> np.ndarray:
    """Smallest hash in each of ``size`` ranges of a 64-bit hash's upper half."""
    out = np.full(size, EMPTY, np.uint32)
    if phrases:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
        hashes.sort()
        bucket = ((hashes >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(size)))
        # the lower half orders within a bucket, so registers do not depend on its range
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out[bucket[first].astype(np.intp)] = np.minimum(np.minimum.reduceat(low, first), EMPTY - 1)
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Share of equal registers among those that either text fills; 1 for two empty texts."""
    filled = (left != EMPTY) | (right != EMPTY)
    return float((left == right)[filled].mean()) if filled.any() else 1.0


def fingerprint(registers: np.ndarray) -> str:
    return registers.astype(">u4").tobytes().hex()


def text_signature(text: str) -> np.ndarray:
    return signature(parse(text, set())[0])


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the following text, or all."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def both_signatures(text: str, following: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a text and its edited text; their common part is parsed once."""
    tail = len(text) // 4
    phrases: set[str] = set()
    new, rest = parse(text[: len(text) - tail], phrases)
    common = signature(new)
    own, _ = parse(text[len(text) - tail :], phrases, rest)
    phrases.difference_update(own)
    other, _ = parse(following[:tail], phrases, rest)
    return np.minimum(common, signature(own)), np.minimum(common, signature(other))


COMPARED = pa.schema(
    [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [(n, pa.float64()) for n in ("near_edited", "near_next")]
)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of every whole text, row by row; NULL counts as empty."""
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches):
        for batch in small_batches(batches):
            made = [fingerprint(text_signature(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["_key", "fingerprint"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, fingerprint string").withColumnRenamed("_key", key)


def _with_following(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt to ranges of (key, hash of the text), sorted, each range followed by the next
    one's first row.

    The number of ranges follows the session's shuffle partitions; the driver gets the first
    key and hash of each, and tasks look rows up in that list. So rows of one key spread over
    many ranges; only rows equal in key and text stay together. A range's ``_guest`` rows equal
    the first of the next range, at most one from each task that reads such rows.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(LOWEST)).alias("_order")
    value = F.coalesce(F.col(text), F.lit("")).alias("_text")
    source = docs.select(F.col(key).alias("_key"), order, value).withColumn("_hash", F.xxhash64("_text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = source.select("_order", "_hash").repartitionByRange(ranges, "_order", "_hash")
    first = cut.groupBy(F.spark_partition_id()).agg(F.min(F.struct("_order", "_hash")).alias("head"))
    heads = sorted(tuple(row["head"]) for row in first.collect())

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The row's range and, for a range's first row, the one before, the last before the first."""
        sent = set()
        for orders, hashes in batches:
            out = []
            for pair in zip(orders.tolist(), hashes.tolist()):
                place = bisect_right(heads, pair) - 1
                if heads[place] == pair and place not in sent:
                    sent.add(place)
                    out.append([place, (place - 1) % len(heads)])
                else:
                    out.append([place])
            yield pd.Series(out)

    # which of several equal rows is sent depends on the task, so it must be asked once only
    to = F.posexplode(places.asNondeterministic()("_order", "_hash")).alias("_guest", "_range")
    dealt = source.select("_key", "_text", "_order", "_hash", to).withColumn("_guest", F.col("_guest") == 1)
    return dealt.repartition(ranges, "_range").sortWithinPartitions("_range", "_guest", "_order", "_hash")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next larger integer key, after the last the first;
    a single row follows itself. NULL keys come first; rows with equal keys follow each other
    in the order of their texts' hashes. NULL texts count as empty; an empty text's edited
    text is empty. Each text is shuffled once.
    """
    source = _with_following(docs, key, text)
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches):
        out = []
        waiting = None  # (key, text, signature, edited signature, edited text) without the next one's signature
        now = None  # (range, key, text) that has not met its next text
        followed = None  # range whose end has been seen

        def emit(row, following):
            row_key, value, own, changed, edited = row
            digest = hashlib.sha256(edited.encode()).hexdigest()
            out.append((row_key, len(value), digest, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, following)))

        def step(following):
            nonlocal waiting
            _, row_key, value = now
            own, changed = both_signatures(value, following)
            if waiting:
                emit(waiting, own)
            waiting = (row_key, value, own, changed, edited_text(value, following))

        for batch in small_batches(batches):
            columns = [batch.column(n).to_pylist() for n in ("_range", "_guest", "_key", "_text")]
            for place, guest, row_key, value in zip(*columns):
                if guest:
                    if now is not None and now[0] == place and followed != place:
                        step(value)
                        emit(waiting, text_signature(value))
                        waiting, now, followed = None, None, place
                    continue
                if now is not None:
                    step(value)
                now = (place, row_key, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.schema.field("_key").type), pa.array([r[1] for r in out], pa.int64()),
                 *record_batch(COMPARED, *([list(c) for c in zip(*[r[2:] for r in out])] or [[]] * 5)).columns],
                names=["_key", "n_chars", *COMPARED.names],
            )
            out.clear()

    kinds = f"_key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return source.mapInArrow(run, kinds).withColumnRenamed("_key", key)
