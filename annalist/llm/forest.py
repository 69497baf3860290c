"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a long hash string: one bit for each random direction, set
above the sample's median. Rows lie in blocks by a prefix of a tree's strings, unsorted and read
from end to end. A query starts at a fixed depth, a few bits past the one that the budget asks
for (about 9 of the 48 bits at 51,282 rows and more), and all trees then ascend together, one level after another, until enough candidates share its prefixes. Candidates
are compared by exact distances on the original vectors.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import small_batches
from annalist.operators.lineage import Scratch

TREES, BITS = 16, 48
#: vectors that directions and medians are fitted on; every vector is indexed
SAMPLE = 5_000
#: candidates of a query, counted once per tree: at least LEAST, and FACTOR * rows ** POWER
LEAST, FACTOR, POWER = 4_000, 2.0, 0.93
#: rows of a block that one task compares with its queries
BLOCK = 2_048


def usable(vector: Column) -> Column:
    """Vectors that are not NULL or zero and hold finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(sample: np.ndarray, trees: int, bits: int):
    """Directions with the sample's covariance, and the medians of its projections on them."""
    random = np.random.default_rng(2)
    centred = sample - sample.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    spread = vectors * np.sqrt(np.maximum(values, 1e-12))
    planes = (spread @ random.standard_normal((sample.shape[1], trees * bits))).astype(np.float32)
    return planes, np.median(sample.astype(np.float32) @ planes, axis=0)


def _codes(planes, medians, trees: int, bits: int, schema: str):
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def run(batches):
        for batch in small_batches(batches, rows=2048):
            column = batch.column("vector")
            matrix = column.flatten().to_numpy().astype(np.float32).reshape(batch.num_rows, -1)
            above = (matrix @ planes > medians).reshape(batch.num_rows, trees, bits)
            codes = (above * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, trees, dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    return run


def _compare(count: int, bits: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            matrix = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            codes, keys, ids = rows["code"].to_numpy(), rows["vector_key"].to_numpy(), rows["ids"].to_numpy()
            first = np.array([x[0] for x in ids])
            for key, code, level, vector in zip(queries["vector_key"], queries["code"], queries["level"], queries["vector"]):
                near = np.flatnonzero((codes ^ code) >> (bits - level) == 0)
                if not len(near):
                    continue
                distance = np.sqrt(((matrix[near] - np.asarray(vector, np.float64)) ** 2).sum(axis=1))
                if len(near) > count:
                    within = distance <= np.partition(distance, count - 1)[count - 1]
                    near, distance = near[within], distance[within]
                for i in np.lexsort((first[near], distance))[:count]:
                    out.append((key, keys[near[i]], distance[i], ids[near[i]]))
        return pd.DataFrame(out, columns=["query_key", "vector_key", "score", "ids"])

    return run


def nearest(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest rows found for each query row.

    Queries are the rows that ``is_query`` holds for. ``score`` is the Euclidean distance in
    double precision; ties go to the smaller key. A row is no candidate of a query with its
    own key. Vectors that are not ``usable``, have a NULL key or not the most frequent number of
    components take no part; equal rows count once. An empty table gives no rows. Other
    columns are not read.

    Equal vectors are one entry with its ``k + 1`` smallest keys, which is all that a query can
    need of them, so a vector that many rows share costs one row. Entries are dealt to blocks
    of their trees by prefix; crowded blocks are split by key. A query visits the blocks that
    its prefixes reach.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    usable_rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), is_query.alias("query")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    widths = usable_rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.orderBy(F.desc("n"), "width").limit(1).collect()
    if not width:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    usable_rows = usable_rows.filter(F.size("vector") == width[0]["width"])
    single = usable_rows.withColumn("vector_key", F.xxhash64("vector")).groupBy("vector_key", "id").agg(F.first("vector").alias("vector"), F.max("query").alias("query"))
    by_vector = Window.partitionBy("vector_key").orderBy("id")
    entries = single.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1)
    entries = entries.groupBy("vector_key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries, n = scratch.counted(entries)
    asked = scratch.keep(single.filter("query").select(F.col("id").alias("query_id"), "vector_key"))

    picked = entries.orderBy(F.xxhash64("vector_key"), "vector_key").limit(SAMPLE).select("vector").collect()
    planes, medians = directions(np.array([r["vector"] for r in picked], np.float64), TREES, BITS)
    schema = f"vector_key bigint, vector {entries.schema['vector'].dataType.simpleString()}, ids array<{kind}>, codes array<bigint>"
    coded = scratch.keep(entries.select("vector_key", "vector", "ids").mapInArrow(_codes(planes, medians, TREES, BITS, schema), schema))

    budget = max(LEAST, FACTOR * n**POWER)
    block_bits = min(BITS, max(0, int(np.ceil(np.log2(max(1, n / BLOCK))))))
    depth = min(BITS, max(block_bits, int(np.ceil(np.log2(max(1, TREES * n / budget)))) + 4))
    tree_and_code = F.posexplode("codes").alias("tree", "code")

    def prefix(code, level):
        return F.expr(f"shiftright({code}, {BITS} - {level})")

    # how many entries share each prefix, for all levels from the deepest one's sums
    deepest = coded.select(tree_and_code).groupBy("tree", prefix("code", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    counts = deepest.select("tree", "prefix", "n", levels).groupBy("tree", "level", F.expr(f"shiftright(prefix, {depth} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts)

    # all trees ascend together: level by level, tree by tree, until the budget is met
    question = coded.join(asked.select("vector_key").distinct(), "vector_key", "left_semi").select("vector_key", "vector", tree_and_code)
    question = scratch.keep(question)
    steps = question.select("vector_key", "tree", "code", levels).withColumn("prefix", prefix("code", "level")).join(counts, ["tree", "level", "prefix"])
    tree_window = Window.partitionBy("vector_key", "tree").orderBy(F.desc("level"))
    gained = steps.withColumn("gain", F.col("n") - F.coalesce(F.lag("n").over(tree_window), F.lit(0)))
    order = Window.partitionBy("vector_key").orderBy(F.desc("level"), "tree").rowsBetween(Window.unboundedPreceding, -1)
    taken = gained.withColumn("so_far", F.coalesce(F.sum("gain").over(order), F.lit(0))).filter(F.col("so_far") < budget)
    reached = taken.groupBy("vector_key", "tree").agg(F.min("level").alias("level"))
    visits = question.join(reached, ["vector_key", "tree"])

    # blocks of one prefix, crowded ones split by key
    sizes = counts.filter(F.col("level") == block_bits).select("tree", F.col("prefix").alias("block"), F.ceil(F.col("n") / (2 * BLOCK)).alias("parts"))
    rows = coded.select("vector_key", "vector", "ids", tree_and_code).withColumn("block", prefix("code", block_bits)).join(sizes, ["tree", "block"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vector_key"), "parts"))
    low = F.expr(f"shiftleft(shiftright(code, {BITS} - least(level, {block_bits})), {block_bits} - least(level, {block_bits}))")
    high = low + F.expr(f"shiftleft(1L, {block_bits} - least(level, {block_bits}))") - 1
    visits = visits.withColumn("block", F.explode(F.sequence(low, high))).join(sizes, ["tree", "block"])
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    place = ["tree", "block", "part"]
    found = (
        rows.select(*place, "code", "vector_key", "vector", "ids")
        .groupBy(*place)
        .cogroup(visits.select(*place, "code", "level", "vector_key", "vector").groupBy(*place))
        .applyInPandas(_compare(k + 1, BITS), f"query_key bigint, vector_key bigint, score double, ids array<{kind}>")
    )
    found = found.groupBy("query_key", "vector_key").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("query_key").orderBy("score", F.col("ids")[0])
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).select(F.col("query_key").alias("vector_key"), "score", F.explode("ids").alias("vec_id"))
    answers = asked.join(found, "vector_key").filter("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
