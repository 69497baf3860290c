"""Small shared helpers of the operators in this folder."""

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A-Z and their lower-case forms; all other letters stay as they are
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def once_per_process(key: str, make):
    """``make()``, computed once in each Python worker and kept across its tasks.

    Workers outlive stages. Keys start with the name of their operator; what another operator
    left is dropped, and its memory given back, so caches of a pipeline's stages do not add up.
    """
    box = sys.modules.setdefault("annalist_llm_kept", types.ModuleType("annalist_llm_kept")).__dict__
    kept = box.setdefault("kept", {})
    if key not in kept:
        operator = key.split()[0]
        others = [k for k in kept if k.split()[0] != operator]
        for other in others:
            del kept[other]
        if others:
            give_back()
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Returns freed memory to the system, which the allocators of Arrow and C else keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_bucket(column: str, modulus: int):
    """crc32 of the column as text, modulo; NULL keys fall in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches, rows: int = 256, size: int = 8_000_000):
    """Record batches cut into slices of few rows and bytes, so that what is made of one stays small."""
    for batch in batches:
        step = max(1, min(rows, int(rows * size / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def smallest(df: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """The ``count`` rows of every group with the smallest ``order``, a hash.

    Rows are cut within tasks, then within 64 shares of a group, before a group meets.
    """
    shares = Window.partitionBy(group, F.pmod(order, F.lit(64))).orderBy(order)
    cut = df.withColumn("_n", F.row_number().over(shares)).filter(F.col("_n") <= count)
    whole = Window.partitionBy(group).orderBy(order)
    return cut.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= count).drop("_n")
