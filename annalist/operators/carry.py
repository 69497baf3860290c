"""Running values over very long ordered rows.

Rows are cut into chunks of consecutive order values. Each chunk is a window of its
own; what earlier chunks hand over is computed on one row per chunk and joined back.
So no history, however long, is ordered inside one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.scalars import integer_div

CHUNK = 100_000


def running_max(df: DataFrame, by, position: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Replace ``value`` by its maximum over all rows up to ``position``; NULLs count as nothing.

    Rows with equal positions may see each other or not.
    """
    by = list(by)
    cut = df.withColumn("_chunk", integer_div(position, chunk))
    ends = cut.groupBy(*by, "_chunk").agg(F.max(value).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_chunk", F.max("_end").over(before).alias("_carry"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = cut.withColumn(value, F.max(value).over(inside)).join(ends, [*by, "_chunk"], "left")
    return ran.select(*[F.greatest(value, "_carry").alias(value) if c == value else c for c in df.columns])


def carry(df: DataFrame, by, position: str, sums=(), fills=(), chunk: int = CHUNK) -> DataFrame:
    """Replace ``sums`` by their sum over all rows up to ``position``, and NULLs in
    ``fills`` by the last value at a lower ``position``. Positions are unique.

    ``df`` is read twice: whole, and the columns named here for one row per chunk. Fills
    that are not numbers are taken to be sparse or to repeat: their values are keys of a
    first aggregation that hashes numbers only, so each task hands on one row per chunk
    and different value.
    """
    by, sums, fills = list(by), list(sums), list(fills)
    numbers = [c for c in fills if isinstance(df.schema[c].dataType, T.NumericType)]
    marks = [c for c in fills if c not in numbers]
    cut = df.withColumn("_chunk", integer_div(position, chunk))

    def place(c):
        return F.max(F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_at_{c}")

    def latest(c, at):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_end_{c}")

    totals = [F.sum(c).alias(f"_end_{c}") for c in sums]
    if marks:
        runs = cut.groupBy(*by, "_chunk", *marks).agg(
            *totals, *[latest(c, position) for c in numbers], *[place(c) for c in fills]
        )
        ends = runs.groupBy(*by, "_chunk").agg(
            *[F.sum(f"_end_{c}").alias(f"_end_{c}") for c in sums],
            *[F.max_by(f"_end_{c}", f"_at_{c}").alias(f"_end_{c}") for c in numbers],
            *[latest(c, f"_at_{c}") for c in marks],
        )
    else:
        ends = cut.groupBy(*by, "_chunk").agg(*totals, *[latest(c, position) for c in numbers])
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *by,
        "_chunk",
        *[F.sum(f"_end_{c}").over(before).alias(f"_carry_{c}") for c in sums],
        *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in fills],
    )
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ran = cut.select(
        *[c for c in cut.columns if c not in (*sums, *fills)],
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in sums],
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in fills],
    ).join(carried, [*by, "_chunk"], "left")

    def joined(name):
        if name in sums:
            return (F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))).alias(name)
        if name in fills:
            return F.coalesce(F.col(name), F.col(f"_carry_{name}")).alias(name)
        return F.col(name)

    return ran.select(*[joined(c) for c in df.columns])
