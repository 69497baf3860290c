"""Author statistics: summaries, rankings per period, histories with a folded tail."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.functions.periods import Sampling, label_epoch_millis
from annalist.operators import series as T
from annalist.operators.facts import facts, is_rollup
from annalist.operators.grouping import leaders, name_others, ranked, top_rows, with_totals
from annalist.operators.lineage import Scratch


def _by_commits():
    return [F.desc("commits_count"), F.asc("author_name")]


def author_summary(commits: DataFrame, by=()) -> DataFrame:
    """One row per author: lines, merges, first and latest commit, active and contributed days, commits.

    The distinct count runs per author and day first, so a busy author's commits shrink
    to one row per day in many tasks before they meet.
    """
    summed = (
        facts(commits, by)
        .groupBy(*by, "author_name")
        .agg(
            F.sum("insertions").alias("insertions"),
            F.sum("deletions").alias("deletions"),
            F.sum("merge_commits_count").alias("merge_commits_count"),
            F.min("first_timestamp").alias("_first"),
            F.max("last_timestamp").alias("_last"),
            F.count_distinct("day").alias("active_days_count"),
            F.sum("commits_count").alias("commits_count"),
        )
    )
    return summed.select(
        *by,
        "author_name",
        "insertions",
        "deletions",
        "merge_commits_count",
        S.utc_timestamp("_first").alias("first_commit_date"),
        S.utc_timestamp("_last").alias("latest_commit_date"),
        "active_days_count",
        S.contributed_days("_first", "_last").alias("contributed_days_count"),
        "commits_count",
    )


def sort_authors(summary: DataFrame, column: str = "commits_count", by=()) -> DataFrame:
    return summary.orderBy(*by, F.desc(column), F.asc("author_name"))


def author(summary: DataFrame, name: str) -> DataFrame:
    """The row of one author."""
    return summary.filter(F.col("author_name") == name)


def author_names(commits: DataFrame, by=()) -> DataFrame:
    return commits.select(*by, "author_name").distinct()


def authors_count(commits: DataFrame, by=()) -> DataFrame:
    return commits.groupBy(*by).agg(F.count_distinct("author_name").alias("authors_count"))


def top_authors(commits: DataFrame, max_authors: int = 20, by=(), scratch: Scratch | None = None) -> DataFrame:
    """Summaries of the authors with most commits, with their share of all commits.

    The summary of all authors is written once, in a table that ``scratch`` owns; the top
    and the total are taken from it, so commits are read once.
    """
    by, scratch = list(by), scratch or Scratch(commits.sparkSession)
    summary = scratch.keep(author_summary(commits, by))
    kept = top_rows(summary, by, _by_commits(), max_authors)
    totals = summary.groupBy(*by).agg(F.sum("commits_count").alias("_total"))
    return (
        with_totals(kept, totals, by)
        .withColumn("commits_percent", S.guarded_percent("commits_count", "_total"))
        .withColumn("merge_commits_percent", S.guarded_percent("merge_commits_count", "_total"))
        .drop("_total")
        .orderBy(*by, "rank")
    )


def remaining_authors(commits: DataFrame, max_authors: int = 20, by=()) -> DataFrame:
    """Names that did not make the top, in any order. Only the short top list is ranked; the
    long rest is an anti join against it."""
    by = list(by)
    counted = commit_counts(commits, by)
    kept = leaders(counted, by, "author_name", _by_commits(), max_authors)
    # an anti join would be pushed below the aggregation and count the commits twice
    rest = counted.join(kept, [*by, "author_name"], "left")
    return rest.filter(F.col("rank").isNull()).drop("rank")


def commit_counts(commits: DataFrame, by=()) -> DataFrame:
    return (
        facts(commits, by).groupBy(*by, "author_name").agg(F.sum("commits_count").alias("commits_count"))
    )


def authors_by_recency(commits: DataFrame, by=()) -> DataFrame:
    """Authors by the time of their latest commit, newest first."""
    return (
        facts(commits, by)
        .groupBy(*by, "author_name")
        .agg(F.max("last_timestamp").alias("latest_timestamp"))
        .orderBy(*by, F.desc("latest_timestamp"), "author_name")
    )


def _period_counts(commits, period, by):
    """Commits per author and year or month; months are numbers (``yyyymm``) until shown."""
    date = S.day_to_date("day")
    number = {"year": F.year(date), "month": F.year(date) * 100 + F.month(date)}[period]
    return (
        facts(commits, by)
        .withColumn(period, number)
        .filter(F.col(period).isNotNull())
        .groupBy(*by, period, "author_name")
        .agg(F.sum("commits_count").alias("commits_count"))
    )


def _shown(df, period):
    if period == "year":
        return df
    digits = F.lpad(F.col(period).cast("string"), 6, "0")
    return df.withColumn(period, F.concat(F.left(digits, F.lit(4)), F.lit("-"), F.right(digits, F.lit(2))))


def _totals(counted, period, by):
    return counted.groupBy(*by, period).agg(
        F.sum("commits_count").alias("all_commits_count"), F.count("author_name").alias("total_authors_count")
    )


def author_ranking(
    commits: DataFrame, period: str = "year", by=(), limit: int | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """Authors of every ``year`` or ``month`` (``yyyy-MM``) ranked by commits.

    All of them by default, through positions that spread one crowded period over many
    tasks, in a table that ``scratch`` owns; with ``limit`` only the first ranks of each period.
    """
    by = list(by)
    counted = _period_counts(commits, period, by)
    order = ranked(counted, [*by, period], _by_commits(), limit, scratch=scratch)
    return _shown(order, period).select(*by, period, "rank", "author_name", "commits_count")


def period_totals(commits: DataFrame, period: str = "year", by=()) -> DataFrame:
    """Commits and authors of every year or month."""
    by = list(by)
    return _shown(_totals(_period_counts(commits, period, by), period, by), period)


def authors_of_periods(
    commits: DataFrame, period: str = "month", max_periods: int | None = None, next_count: int = 4, by=()
) -> DataFrame:
    """Author of the month or year, the next ones as text, and the period's totals,
    newest period first; ``max_periods`` keeps the newest."""
    by = list(by)
    counted = _period_counts(commits, period, by)
    totals = _totals(counted, period, by)
    if max_periods is not None:
        # one row per period: bounded by the calendar
        totals = top_rows(totals, by, [F.desc(period)], max_periods, "_recency").drop("_recency")
    first = top_rows(counted.join(totals, [*by, period]), [*by, period], _by_commits(), next_count + 1)
    # at most next_count + 1 rows meet per period
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "author_name"))))
    found = first.groupBy(*by, period).agg(
        F.max(F.when(F.col("rank") == 1, F.col("author_name"))).alias("top_author"),
        F.max(F.when(F.col("rank") == 1, F.col("commits_count"))).alias("top_author_commits_count"),
        F.array_join(F.transform(listed, lambda row: row["author_name"]), ", ").alias("next_top_authors"),
        F.max("all_commits_count").alias("all_commits_count"),
        F.max("total_authors_count").alias("total_authors_count"),
    )
    return _shown(found, period).orderBy(*by, F.desc(period))


def _timed_rows(commits, sample, by):
    """Weighted rows of authors, and the number of the single period each falls into."""
    if sample.is_clock:
        if is_rollup(commits):
            raise ValueError("a day rollup has no time of day; pass the commits table")
        rows = commits.select(
            *by,
            "author_name",
            "author_timestamp",
            "insertions",
            "deletions",
            F.lit(1).cast("long").alias("commits_count"),
        )
        return rows, sample.index("author_timestamp")
    return facts(commits, by), sample.index_of_day("day")


def author_history(commits: DataFrame, sampling: str = "W", by=()) -> DataFrame:
    """Lines and commits per period and author, one row per pair with commits, in any order."""
    by = list(by)
    sample = Sampling.parse(sampling)
    rows, index = _timed_rows(commits, sample, by)
    measures = ["insertions", "deletions", "commits_count"]
    summed = T.aggregate_periods(rows, index, sample, by, ["author_name"], measures)
    return T.labelled(summed, sample, by)


def top_author_history(
    commits: DataFrame, sampling: str = "W", max_authors: int = 10, by=(), scratch: Scratch | None = None
) -> DataFrame:
    """Cumulative lines and commits of the authors with most commits and of all others.

    The tail is folded before rows are shuffled and gaps filled, so at most
    ``max_authors + 1`` lines per period and history travel. ``commits_delta`` is the change
    against the period before, 0 in the first one; ``period_commits_count`` the true count.

    Sums per author and single period are written once, in a table that ``scratch`` owns;
    the leaders and the series are taken from it, so commits are read once.
    """
    by, scratch = list(by), scratch or Scratch(commits.sparkSession)
    sample = Sampling.parse(sampling)
    measures = ["insertions", "commits_count"]
    rows, index = _timed_rows(commits, sample, by)
    summed = rows.groupBy(*by, "author_name", index.alias("_single")).agg(*[F.sum(m).alias(m) for m in measures])
    rows = scratch.keep(summed)
    counted = rows.groupBy(*by, "author_name").agg(F.sum("commits_count").alias("commits_count"))
    kept = leaders(counted, by, "author_name", _by_commits(), max_authors)
    # rank is NULL in the folded line, and join keys must be comparable
    named = name_others(rows, kept, by, "author_name").fillna(0, subset=["rank"])
    labels = ["author_name", "is_others", "rank"]
    folded = T.aggregate_periods(named, F.col("_single"), sample, by, labels, measures)
    filled = T.fill_gaps(folded, sample, by, measures, labels)
    filled = filled.withColumn("period_commits_count", F.col("commits_count"))
    ran = T.running(filled, sample, [*by, *labels], sums=measures)
    # every line starts with the first period of the whole history
    delta = F.when(F.col("_index") == F.col("_from"), F.lit(0)).otherwise(F.col("period_commits_count"))
    result = T.labelled(ran.withColumn("commits_delta", delta.cast("long")), sample, by)
    return result.select(
        *by,
        F.expr("nullif(rank, 0)").alias("rank"),
        "author_name",
        "is_others",
        "period",
        label_epoch_millis(F.col("period"), sample).alias("epoch_millis"),
        "insertions",
        "commits_count",
        "commits_delta",
        "period_commits_count",
    ).orderBy(*by, F.asc_nulls_last("rank"), "period")
