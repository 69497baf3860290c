"""Shared shapes: totals, top rows, exact positions, folding a tail into "Others".

``by`` names the columns of one history (normally ``("repo_id",)``); with the
default ``()`` the whole table is one history. No function here sorts a whole
history inside one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.lineage import Scratch

OTHERS = "Others"


def with_totals(df: DataFrame, totals: DataFrame, by=()) -> DataFrame:
    """Attach per-history totals: an equi join on ``by``, or scalar subqueries when
    there is one history. ``totals`` holds one row per history."""
    by = list(by)
    if by:
        return df.join(totals, by, "left")
    return df.select("*", *[totals.select(name).scalar().alias(name) for name in totals.columns])


def top_rows(df: DataFrame, by, order, limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of every group with their rank from 1.

    Grouped: the rank filter lets Spark keep at most ``limit`` rows per group in every
    task before the shuffle. Ungrouped: a top-k merge, then ranks over ``limit`` rows.
    """
    by = list(by)
    if not by:
        df = df.orderBy(*order).limit(limit)
    # ranks of the ungrouped case run over at most `limit` rows, in one task
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.filter(F.col(rank) <= limit)


def positions(df: DataFrame, by, order, name: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """Exact row numbers from 1 over groups of any size.

    The rows are range-partitioned by group and order, so one large group spreads over
    many tasks; row numbers inside a slice are shifted by the rows in earlier slices.
    The slices are written out because both uses must see the same cut; ``scratch`` owns
    the written table.
    """
    by, scratch = list(by), scratch or Scratch(df.sparkSession)
    keys = [F.col(c) for c in by]
    sliced = scratch.keep(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy(*by, "_slice").count()
    # one row per group and slice: as small as the number of partitions
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(shifts, [*by, "_slice"])
        .withColumn(name, F.col("_inside") + F.col("_shift"))
        .drop("_slice", "_inside", "_shift")
    )


def ranked(df: DataFrame, by, order, limit: int | None = None, rank: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """Ranks inside groups; all rows when ``limit`` is absent, through a table that ``scratch`` owns."""
    if limit is None:
        return positions(df, by, order, rank, scratch)
    return top_rows(df, by, order, limit, rank)


def leaders(df: DataFrame, by, label: str, order, limit: int, slack: int = 0) -> DataFrame:
    """Labels kept by name when the rest is folded: the first ``limit``, or every label
    when a history has at most ``limit + slack`` of them. ``df`` has one row per label."""
    by = list(by)
    if not slack:
        return top_rows(df, by, order, limit).select(*by, label, "rank")
    # one row more than may be kept tells whether the history has more
    first = top_rows(df, by, order, limit + slack + 1)
    last = F.max("rank").over(Window.partitionBy(*by))
    return (
        first.withColumn("_last", last)
        .filter((F.col("rank") <= limit) | (F.col("_last") <= limit + slack))
        .select(*by, label, "rank")
    )


def name_others(df: DataFrame, kept: DataFrame, by, label: str) -> DataFrame:
    """Rename labels outside ``kept`` to ``Others`` and add their ``rank``.

    ``is_others`` tells the folded label from a real one of that name; its rank is NULL.
    """
    named = df.join(kept.withColumn("_kept", F.lit(True)), [*by, label], "left")
    is_others = F.col("_kept").isNull()
    return (
        named.withColumn("is_others", is_others)
        .withColumn(label, F.when(is_others, F.lit(OTHERS)).otherwise(F.col(label)))
        .drop("_kept")
    )


def fold_others(df: DataFrame, kept: DataFrame, by, label: str, value: str) -> DataFrame:
    """Sum ``value`` per kept label and over all others."""
    by = list(by)
    return (
        name_others(df, kept, by, label)
        .groupBy(*by, "rank", label, "is_others")
        .agg(F.sum(value).alias(value))
        .orderBy(*by, F.asc_nulls_last("rank"))
    )


def fill_cells(counted: DataFrame, by, cell: str, value: str, first: int, last: int) -> DataFrame:
    """Rows for every integer cell from ``first`` to ``last``, 0 where nothing was counted.

    The cells of one history (at most ``last - first + 1``) meet in one map, so the counts
    are neither computed twice nor joined.
    """
    cells = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(cell, value))).alias("_cells"))
    every = F.explode(F.sequence(F.lit(first), F.lit(last)))
    spread = cells.select(*by, "_cells", every.alias(cell))
    return spread.select(*by, cell, F.coalesce(F.col("_cells")[F.col(cell)], F.lit(0)).cast("long").alias(value))
