"""Near-duplicate documents: HyperMinHash signatures, bands, exact confirmation of links.

Each shingle falls in one bucket by its hash. A bucket keeps its smallest second hash as a
16-bit register: 6 bits for the leading zeros and 10 bits of mantissa. Buckets without a
shingle copy the register of a filled bucket in an order that depends on the bucket alone,
so registers of similar small sets agree too. Bands of registers propose candidates, the
collision-corrected share of equal registers drops the hopeless ones, and links are
confirmed on whole shingle sets.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import ASCII_LOWER, once_per_process, record_batch, small_batches
from annalist.llm.components import components
from annalist.operators.lineage import Scratch

ROWS, BANDS = 5, 40
REGISTERS = ROWS * BANDS
MANTISSA_BITS = 10
#: a link of similarity s is lost with probability (1 - s ** ROWS) ** BANDS by the bands
#: (1.2e-7 at 0.8); the estimate may be this much too low, five standard errors
ESTIMATE_MARGIN = 0.145
#: sets compared with each other in one task come from two blocks of about this many
BLOCK = 192
#: constant of the expected number of register collisions, from the published estimator
COLLISION = 0.169919487159739093975315012348

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """Word -> 64-bit hash; words are hashed when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles (see ``near_duplicates``)."""
    parts = text.encode().translate(ASCII_LOWER).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    size = min(width, len(parts))
    # sequences of different lengths must differ
    total = np.full(len(parts) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            multiplier = _MULTIPLIERS[k % len(_MULTIPLIERS)] + np.uint64(2 * (k // len(_MULTIPLIERS)))
            total += hashes[k : len(parts) - size + 1 + k] * multiplier
            total ^= total >> np.uint64(29)
        return np.unique(mixed(total))


def _fill_order() -> np.ndarray:
    """For every bucket a random rank of all buckets: an empty one copies the filled one of lowest rank."""
    random = np.random.default_rng(20)
    return np.argsort(random.random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)


def registers(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set of hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(REGISTERS)))
    with np.errstate(over="ignore"):
        least = np.minimum.reduceat(mixed(hashes * np.uint64(0x9E3779B97F4A7C15)), first)
    zeros = np.clip(64 - np.frexp(least.astype(np.float64))[1], 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    values = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    filled = bucket[first].astype(np.intp)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = values
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = values[np.argmin(order[np.ix_(empty, filled)], axis=1)]
    return out


def estimated_similarity(equal, n_left, n_right):
    """Jaccard similarity from the share of equal registers, less those that agree by chance."""
    ratio = np.maximum(n_left, n_right) / np.maximum(1, np.minimum(n_left, n_right))
    chance = COLLISION * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - chance) / (1 - chance), 0, 1)


SIGNATURES = pa.schema([("set_id", pa.int64()), ("n_shingles", pa.int64()), ("registers", pa.binary())])
SETS = pa.schema([("set_id", pa.int64()), ("shingles", pa.binary())])


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key, set_id, n_shingles, registers`` row by row; NULL registers for empty sets."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        words = once_per_process("minhash words", WordHashes)
        order = once_per_process("minhash order", _fill_order)
        for batch in small_batches(batches):
            rows = []
            for value in batch.column(1):
                hashes = shingle_set(value.as_py(), width, words)
                rows.append((_set_id(hashes), len(hashes), registers(hashes, order).tobytes() if len(hashes) else None))
            made = record_batch(SIGNATURES, *zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=["_key", *SIGNATURES.names])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, set_id bigint, n_shingles bigint, registers binary")


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``set_id, shingles`` (sorted 64-bit hashes) row by row."""

    def run(batches):
        words = once_per_process("minhash words", WordHashes)
        for batch in small_batches(batches):
            sets = [shingle_set(value.as_py(), width, words) for value in batch.column(0)]
            yield record_batch(SETS, [_set_id(s) for s in sets], [s.tobytes() for s in sets])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "set_id bigint, shingles binary")


def _cells(members: DataFrame, group: str, blocks) -> DataFrame:
    """Deals the members of a group to cells of two blocks, ``_low <= _high``, so that any two
    members meet in a cell. One block is one cell; more blocks get a cell for every two."""
    dealt = members.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("set_id", group), "_blocks"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    return dealt.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other")).drop("_other", "_blocks")


def _spanning(left, right, n):
    """Pairs of a spanning forest of the graph on 0..n-1, in one pass."""
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            yield a, b


def _similar_registers(share):
    """Spanning edges of estimated similarity >= share in one cell of an open bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id")
        table = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(len(pdf), REGISTERS)
        n, ids = pdf["n_shingles"].to_numpy(), pdf["set_id"].to_numpy()
        cluster = pdf["cluster"].to_numpy()
        left, right = [], []
        for a in range(len(pdf) - 1):
            equal = (table[a + 1 :] == table[a]).mean(axis=1)
            close = (estimated_similarity(equal, n[a], n[a + 1 :]) >= share) & (cluster[a + 1 :] != cluster[a])
            found = np.flatnonzero(close) + a + 1
            left.append(np.full(len(found), a))
            right.append(found)
        if not left:
            return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
        pairs = [(ids[a], ids[b]) for a, b in _spanning(np.concatenate(left), np.concatenate(right), len(pdf))]
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    return run


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def _common(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, in bounded memory."""
    total = np.zeros((len(rows), len(others)), np.int64)
    if not rows or not others:
        return total
    hashes, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    against, whose = np.concatenate(others), np.repeat(np.arange(len(others)), [len(r) for r in others])
    shared = np.intersect1d(np.unique(hashes), np.unique(against), assume_unique=True)
    if not len(shared):
        return total
    place, there = np.searchsorted(shared, hashes), np.searchsorted(shared, against)
    here = shared[np.minimum(place, len(shared) - 1)] == hashes
    found = shared[np.minimum(there, len(shared) - 1)] == against
    place, which, there, whose = place[here], which[here], there[found], whose[found]
    for start in range(0, len(shared), 8192):
        width = min(8192, len(shared) - start)
        a, b = np.zeros((len(rows), width), np.float32), np.zeros((len(others), width), np.float32)
        now = (place >= start) & (place < start + width)
        a[which[now], place[now] - start] = 1
        now = (there >= start) & (there < start + width)
        b[whose[now], there[now] - start] = 1
        total += (a @ b.T).astype(np.int64)
    return total


def _confirmed(percent: int):
    """Spanning edges of the exact links in one cell of a cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id")
        ids, open_ = pdf["set_id"].to_numpy(), ~pdf["linked"].to_numpy(dtype=bool)
        sets = _sets(pdf["shingles"])
        sizes = np.array([len(s) for s in sets])
        rows = np.flatnonzero(open_)
        both = _common([sets[r] for r in rows], sets)
        union = sizes[rows][:, None] + sizes[None, :] - both
        left, right = np.nonzero(100 * both >= percent * union)
        left = rows[left]
        pairs = [(ids[a], ids[b]) for a, b in _spanning(left, right, len(pdf)) if a != b]
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    return run


def _is_link(percent: int):
    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(_sets(left), _sets(right)):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return linked


def _estimate():
    @F.pandas_udf("double")
    def estimate(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(left), np.uint16).reshape(len(left), REGISTERS)
        b = np.frombuffer(b"".join(right), np.uint16).reshape(len(right), REGISTERS)
        return pd.Series(estimated_similarity((a == b).mean(axis=1), n_left.to_numpy(), n_right.to_numpy()))

    return estimate


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A text's
    set holds its distinct shingles of ``width`` words; fewer words make one shingle; NULL
    texts and those without words have the empty set, which is linked with nothing. Two
    texts are linked when 100 * common >= ``percent`` * united; the bands are made for 80 and more. ``component_id`` is the smallest
    key reachable over links (own key included) and ``kept`` says that it is the row's own.
    Repeated rows and equal sets are one class. NULL keys count after all others and get the
    component of their class, NULL when it has no other key. Other columns are not read.

    Equal sets are collapsed first, so groups of exact copies cost one row. Candidates then
    go from cheap to exact, with rows in proportion to documents throughout:

    1. each band's bucket links its members to its smallest one, if the registers' estimate allows;
    2. buckets whose members are still in different clusters compare all their members'
       registers, in cells of two blocks, and hand on a spanning forest of what is similar;
    3. in each cluster every member is checked exactly against the best connected member;
    4. members without that link are checked exactly against all others of the cluster, in
       cells of two blocks, and hand on a spanning forest of the links.

    Only members that the pivot does not explain are compared with many others.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands find links of 80 to 100 percent")
    share = percent / 100 - ESTIMATE_MARGIN
    rows = scratch.keep(signatures(docs, key, text, width))
    filled = rows.filter("n_shingles > 0")
    sets = filled.groupBy("set_id").agg(F.min("_key").alias("least_key"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    sets = scratch.keep(sets)
    bands = [F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    banded = sets.select("set_id", F.explode(F.array(*bands)).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("set_id").alias("first_id"))
    members = scratch.keep(banded.join(sizes.filter("members > 1"), "bucket"))

    # 1: stars of the buckets
    stars = members.filter("set_id <> first_id").select(F.col("first_id").alias("u"), F.col("set_id").alias("v")).distinct()
    registers_of = sets.select("set_id", "registers", "n_shingles")
    left = registers_of.toDF("u", "registers_u", "n_u")
    right = registers_of.toDF("v", "registers_v", "n_v")
    estimate = _estimate()("registers_u", "registers_v", "n_u", "n_v")
    near = scratch.keep(stars.join(left, "u").join(right, "v").withColumn("share", estimate).filter(F.col("share") >= share).select("u", "v"))
    cluster = scratch.keep(components(near, scratch))

    # 2: buckets that are not yet in one cluster
    label = F.coalesce("component", "set_id").alias("cluster")
    placed = members.join(cluster, members.set_id == cluster.node, "left").select("bucket", "set_id", "members", label)
    open_buckets = placed.groupBy("bucket").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).filter("a <> b").select("bucket")
    placed = placed.join(open_buckets, "bucket").join(registers_of, "set_id")
    cells = _cells(placed, "bucket", F.ceil(F.col("members") / BLOCK))
    more = scratch.keep(
        cells.groupBy("bucket", "_low", "_high")
        .applyInPandas(_similar_registers(share), "u bigint, v bigint")
        .distinct()
    )
    merged = scratch.keep(components(near.unionByName(more), scratch))

    # 3: whole sets of clustered members, against the best connected one
    weight = members.groupBy("set_id").agg(F.sum("members").alias("weight"))
    inside = merged.select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    pivots = inside.join(weight, "set_id").groupBy("cluster").agg(F.max_by("set_id", F.struct("weight", "set_id")).alias("pivot"), F.count(F.lit(1)).alias("size"))
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chosen = inside.join(sets, "set_id").select(F.col("least_key").alias("_chosen")).distinct()
    whole = shingle_sets(source.join(chosen, source._key.eqNullSafe(chosen._chosen), "left_semi"), "_text", width)
    # one row for each set before the join by cluster, which can then split crowded clusters
    whole = whole.join(inside, "set_id").groupBy("set_id").agg(F.first("cluster").alias("cluster"), F.first("shingles").alias("shingles"))
    whole = scratch.keep(whole.join(scratch.keep(pivots), "cluster"))
    pivot_sets = whole.filter("set_id = pivot").select("cluster", F.col("shingles").alias("pivot_shingles"))
    tested = whole.join(pivot_sets, "cluster").withColumn("linked", _is_link(percent)("shingles", "pivot_shingles"))
    tested = scratch.keep(tested.select("cluster", "set_id", "pivot", "size", "linked"))

    # 4: members without a link to the pivot, against all
    rest = tested.groupBy("cluster").agg(F.count(F.when(~F.col("linked"), 1)).alias("open")).filter("open > 0")
    left_over = tested.filter("size > 2").join(rest, "cluster").join(whole.select("cluster", "set_id", "shingles"), ["cluster", "set_id"])
    open_blocks, linked_blocks = F.ceil(F.col("open") / BLOCK), F.ceil((F.col("size") - F.col("open")) / BLOCK)
    among = _cells(left_over.filter("not linked"), "cluster", open_blocks).withColumn("_kind", F.lit(0))
    columns = ["cluster", "set_id", "shingles", "linked", "_low", "_high", "_kind"]
    block = F.pmod(F.xxhash64("set_id", "cluster"), F.when(F.col("linked"), linked_blocks).otherwise(open_blocks))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("linked"), open_blocks).otherwise(linked_blocks) - 1))
    across = left_over.filter("set_id <> pivot").withColumn("_block", block).withColumn("_other", other)
    across = across.withColumn("_low", F.when(F.col("linked"), F.col("_other")).otherwise(F.col("_block")))
    across = across.withColumn("_high", F.when(F.col("linked"), F.col("_block")).otherwise(F.col("_other"))).withColumn("_kind", F.lit(1))
    cells = among.select(*columns).unionByName(across.select(*columns))
    late = cells.groupBy("cluster", "_kind", "_low", "_high").applyInPandas(_confirmed(percent), "u bigint, v bigint")
    links = tested.filter("linked and set_id <> pivot").select(F.col("pivot").alias("u"), F.col("set_id").alias("v")).unionByName(late)
    classes = scratch.keep(components(links, scratch))

    smallest = classes.join(sets.select(F.col("set_id").alias("node"), "least_key"), "node")
    smallest = smallest.groupBy("component").agg(F.min("least_key").alias("component_key"))
    named = sets.select("set_id", "least_key").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").join(smallest, "component", "left")
    named = named.select("set_id", F.coalesce("component_key", "least_key").alias("component_id"))
    found = rows.join(named, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_key"))
    return found.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))
