"""Time series: period aggregation, gap filling, running values."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.periods import Sampling
from annalist.operators import carry
from annalist.operators.grouping import with_totals

#: periods laid out by one row of the calendar before it is split again
SPINE_BLOCK = 10_000


def aggregate_periods(df: DataFrame, index, sampling: Sampling, by, keys, sums) -> DataFrame:
    """Sum columns per period (and key). Single periods are summed first; multiples are
    merged on that much smaller result, whose lowest index anchors them. Rows without a
    time belong to no period."""
    by, keys = list(by), list(keys)

    def add(rows):
        return rows.groupBy(*by, "_index", *keys).agg(*[F.sum(c).alias(c) for c in sums])

    single = add(df.withColumn("_index", index).filter(F.col("_index").isNotNull()))
    if sampling.multiple == 1:
        return single
    if keys or sampling.is_clock:
        lowest = single.groupBy(*by).agg(F.min("_index").alias("_lowest"))
        anchored = with_totals(single, lowest, by)
    else:
        # one row per day or longer period, few enough for a window
        anchored = single.withColumn("_lowest", F.min("_index").over(Window.partitionBy(*by)))
    return add(anchored.withColumn("_index", sampling.merged("_index", sampling.origin("_lowest"))))


def calendar(series: DataFrame, sampling: Sampling, by, labels=None) -> DataFrame:
    """Every period from the first (``_from``) to the last with data, per history.

    ``labels`` adds one calendar per label of the history (a small, already folded set).
    Long calendars are laid out in blocks, so no row holds more than a block of periods.
    """
    by = list(by)
    # the maxima read every column of the series, so that Spark finds the same shuffle here
    # and on the other side of the join and runs it once; the condition on them always holds
    rest = [c for c in series.columns if c not in (*by, *(labels or []), "_index")]
    some = F.concat_ws("", *[F.max(c).cast("string") for c in rest]) if rest else F.lit("")
    span = [F.min("_index").alias("_from"), F.max("_index").alias("_to"), some.alias("_some")]
    if labels:
        span.append(F.collect_set(F.struct(*labels)).alias("_labels"))
    step = F.lit(sampling.multiple).cast("long")
    blocks = series.groupBy(*by).agg(*span).filter(F.col("_from").isNotNull() & (F.length("_some") >= 0))
    if labels:
        blocks = blocks.withColumn("_label", F.explode("_labels")).select(
            *by, "_from", "_to", *[F.col(f"_label.{c}").alias(c) for c in labels]
        )
    blocks = blocks.withColumn(
        "_block", F.explode(F.sequence(F.col("_from"), F.col("_to"), step * SPINE_BLOCK))
    )
    if sampling.is_clock:
        blocks = blocks.repartition(*by, "_block")
    inside = F.sequence(F.col("_block"), F.least(F.col("_to"), F.col("_block") + step * (SPINE_BLOCK - 1)), step)
    return blocks.select(*by, *(labels or []), F.explode(inside).alias("_index"), "_from")


def fill_gaps(series: DataFrame, sampling: Sampling, by, zeros, labels=None) -> DataFrame:
    """Add the periods without data, with 0 in the columns of ``zeros``."""
    keys = [*by, *(labels or []), "_index"]
    spine = calendar(series, sampling, by, labels)
    if labels is None:
        spine = spine.drop("_from")
    return spine.join(series, keys, "left").fillna(0, subset=list(zeros))


def running(series: DataFrame, sampling: Sampling, by, sums=(), fills=()) -> DataFrame:
    """Running sums and forward fills along the periods.

    Date periods number a few ten thousand at most, so a plain window serves; periods
    below a day can be billions and go through chunks.
    """
    by = list(by)
    if sampling.is_clock:
        return carry.carry(series, by, "_index", sums, fills)
    window = Window.partitionBy(*by).orderBy("_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.select(
        *[
            F.sum(c).over(window).alias(c)
            if c in sums
            else F.last(c, ignorenulls=True).over(window).alias(c)
            if c in fills
            else F.col(c)
            for c in series.columns
        ]
    )


def labelled(series: DataFrame, sampling: Sampling, by) -> DataFrame:
    """Replace the period number by the period label, placed after ``by``."""
    rest = [c for c in series.columns if c not in (*by, "_index")]
    return series.select(*by, sampling.label("_index").alias("period"), *rest)
