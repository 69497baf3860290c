"""Commit activity: totals, distributions over calendar, zone, domain and duration, series."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.functions.periods import Sampling
from annalist.operators import series as T
from annalist.operators.facts import cells, facts, is_rollup
from annalist.operators.grouping import fill_cells, fold_others, leaders


def _count():
    return F.count(F.lit(1)).alias("commits_count")


def _sum():
    return F.sum("commits_count").alias("commits_count")


def commit_totals(commits: DataFrame, by=()) -> DataFrame:
    """Commits, merges, first and last commit time, active UTC days, age in days."""
    totals = (
        facts(commits, by)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("commits_count"), F.lit(0)).alias("commits_count"),
            F.coalesce(F.sum("merge_commits_count"), F.lit(0)).alias("merge_commits_count"),
            F.min("first_timestamp").alias("_first"),
            F.max("last_timestamp").alias("_last"),
            F.count_distinct("day").alias("active_days_count"),
        )
    )
    return totals.select(
        *by,
        "commits_count",
        "merge_commits_count",
        S.utc_timestamp("_first").alias("first_commit_date"),
        S.utc_timestamp("_last").alias("last_commit_date"),
        "active_days_count",
        S.whole_days("_first", "_last").alias("age_days"),
    )


def line_totals(linear: DataFrame, by=()) -> DataFrame:
    """Lines added, removed and net over the first-parent history."""
    added = F.coalesce(F.sum("insertions"), F.lit(0))
    removed = F.coalesce(F.sum("deletions"), F.lit(0))
    return linear.groupBy(*by).agg(
        added.alias("added_lines_count"),
        removed.alias("removed_lines_count"),
        (added - removed).alias("total_lines_count"),
    )


def active_days(commits: DataFrame, by=()) -> DataFrame:
    """Distinct UTC dates with commits."""
    return facts(commits, by).groupBy(*by).agg(F.count_distinct("day").alias("active_days_count"))


def review_durations(commits: DataFrame, by=()) -> DataFrame:
    """Commits per review-duration bin, all nine bins in order, empty ones with 0.

    Negative durations and those beyond the last edge are in no bin.
    """
    by = list(by)
    labels = [label for _, label in S.DURATION_BINS]

    def commits_in(label):
        return F.coalesce(F.sum(F.when(F.col("bin") == label, F.col("commits_count"))), F.lit(0)).alias("commits_count")

    counted = cells(commits, ["bin"], by).groupBy(*by).agg(
        F.array(
            *[F.struct(F.lit(i).alias("bin_order"), F.lit(b).alias("bin"), commits_in(b)) for i, b in enumerate(labels)]
        ).alias("_bins")
    )
    return counted.select(*by, F.inline("_bins")).orderBy(*by, "bin_order")


def timezones(commits: DataFrame, by=()) -> DataFrame:
    """Commits per author time zone, west to east."""
    return (
        cells(commits, ["author_tz_offset"], by)
        .groupBy(*by, "author_tz_offset")
        .agg(_sum())
        .select(*by, "author_tz_offset", S.offset_label("author_tz_offset").alias("timezone"), "commits_count")
        .orderBy(*by, "author_tz_offset")
    )


def domains(commits: DataFrame, by=()) -> DataFrame:
    """Commits per e-mail domain, most frequent first."""
    return (
        cells(commits, ["domain"], by)
        .groupBy(*by, "domain")
        .agg(_sum())
        .orderBy(*by, F.desc("commits_count"), "domain")
    )


def domains_with_others(commits: DataFrame, max_domains: int = 10, by=()) -> DataFrame:
    """Most frequent domains, all further ones added up as ``Others``."""
    by = list(by)
    counted = cells(commits, ["domain"], by).groupBy(*by, "domain").agg(_sum())
    kept = leaders(counted, by, "domain", [F.desc("commits_count"), F.asc("domain")], max_domains)
    return fold_others(counted, kept, by, "domain", "commits_count")


def _histories(commits, by, histories):
    """One row per history: of the small table given, else of all commits."""
    return (commits if histories is None else histories).select(*by).distinct()


def recent_weeks(commits: DataFrame, as_of, weeks: int = 32, by=(), histories: DataFrame | None = None) -> DataFrame:
    """Commits in each of the last ``weeks`` weeks, oldest first.

    Weeks are open at their first and closed at their last instant and end on Sunday
    00:00 UTC: the coming Sunday, or a week later when ``as_of`` is a Sunday. Commits
    older than Monday's time of day ``weeks`` weeks before the coming Monday are left
    out, which trims the oldest week. ``histories`` may list the repositories (or be a rollup);
    without it they are looked up in all commits.
    """
    if weeks < 1:
        raise ValueError("weeks must be positive")
    now = S.epoch_seconds(as_of)
    week = 7 * S.DAY_SECONDS
    today = now // S.DAY_SECONDS
    weekday = (today + 3) % 7
    to_sunday = 7 if weekday == 6 else 6 - weekday
    to_monday = 7 if weekday == 6 else 7 - weekday
    last_edge = (today + to_sunday) * S.DAY_SECONDS
    oldest = now + to_monday * S.DAY_SECONDS - weeks * week
    first_edge = last_edge - weeks * week
    time = F.col("author_timestamp")
    # filter on the plain column, so it reaches the scan; the counts are at most `weeks` rows
    counted = (
        commits.filter((time >= oldest) & (time > first_edge) & (time <= last_edge))
        .groupBy(*by, S.integer_div(F.lit(last_edge) - time, week).alias("weeks_ago"))
        .agg(_count())
    )
    ago = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(weeks - 1).cast("long"))).alias("weeks_ago")
    if by:
        spine = _histories(commits, by, histories).select(*by, ago)
    else:
        spine = commits.sparkSession.range(weeks).select(F.col("id").alias("weeks_ago"))
    end = F.lit(last_edge) - F.col("weeks_ago") * week
    return (
        spine.join(counted, [*by, "weeks_ago"], "left")
        .fillna(0, subset=["commits_count"])
        .select(
            *by,
            "weeks_ago",
            S.utc_date(end - week).alias("week_start"),
            S.utc_date(end).alias("week_end"),
            "commits_count",
        )
        .orderBy(*by, F.desc("weeks_ago"))
    )


def months_of_year(commits: DataFrame, by=(), all_months: bool = False) -> DataFrame:
    """Commits per calendar month (UTC) over all years; ``all_months`` adds empty ones."""
    by = list(by)
    month = F.month(S.day_to_date("day")).cast("int")
    counted = facts(commits, by).groupBy(*by, month.alias("month")).agg(F.sum("commits_count").alias("commits_count"))
    if all_months:
        counted = fill_cells(counted, by, "month", "commits_count", 1, 12)
    return counted.select(*by, "month", S.month_name("month").alias("month_name"), "commits_count").orderBy(
        *by, "month"
    )


def _weekday_hours(commits, by):
    return cells(commits, ["weekday", "hour"], by).groupBy(*by, "weekday", "hour").agg(_sum())


def weekday_hours(commits: DataFrame, by=()) -> DataFrame:
    """Commits per weekday (Monday = 0) and hour on the author's clock, all 168 cells."""
    by = list(by)
    counted = _weekday_hours(commits, by).withColumn("_cell", F.col("weekday") * 24 + F.col("hour"))
    filled = fill_cells(counted, by, "_cell", "commits_count", 0, 167)
    weekday = F.call_function("div", F.col("_cell"), F.lit(24)).cast("int")
    return filled.select(
        *by,
        weekday.alias("weekday"),
        S.weekday_name(weekday).alias("weekday_name"),
        (F.col("_cell") % 24).alias("hour"),
        "commits_count",
    ).orderBy(*by, "weekday", "hour")


def weekday_hour_matrix(commits: DataFrame, by=()) -> DataFrame:
    """One row per weekday with commits, one column ``h0`` .. ``h23`` per hour."""
    by = list(by)
    pivoted = (
        _weekday_hours(commits, by)
        .groupBy(*by, "weekday")
        .pivot("hour", list(range(24)))
        .agg(F.sum("commits_count"))
        .fillna(0)
    )
    return pivoted.select(
        *by, "weekday", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(24)]
    ).orderBy(*by, "weekday")


def weekday_hour_margins(commits: DataFrame, by=()) -> DataFrame:
    """Totals per weekday, per hour and overall; NULL marks the summed dimension.

    ``cell_max`` is the largest single weekday-and-hour cell under the margin.
    """
    by = list(by)
    counted = _weekday_hours(commits, by)
    summed = [F.sum("commits_count").alias("commits_count"), F.max("commits_count").alias("cell_max")]
    sets = [[*by, "weekday"], [*by, "hour"], by]
    grouped = counted.groupingSets(sets, *by, "weekday", "hour").agg(*summed)
    return grouped.select(*by, "weekday", "hour", "commits_count", "cell_max").orderBy(
        *by, F.asc_nulls_last("weekday"), F.asc_nulls_last("hour")
    )


def heat_levels(table: DataFrame, levels: int, by=(), value: str = "commits_count") -> DataFrame:
    """Add ``heat``: the value's place among ``levels`` steps up to the largest value.

    ``table`` is one of the small ones above (weekdays and hours, months, time zones).
    """
    largest = F.max(value).over(Window.partitionBy(*by))
    return table.withColumn("heat", S.heat_level(value, largest, levels))


def commit_history(commits: DataFrame, sampling: str = "W", by=()) -> DataFrame:
    """Commits per period of author time, periods without commits included."""
    by = list(by)
    sample = Sampling.parse(sampling)
    if sample.is_clock:
        if is_rollup(commits):
            raise ValueError("a day rollup has no time of day; pass the commits table")
        rows = commits.select(*by, F.col("author_timestamp"), F.lit(1).cast("long").alias("commits_count"))
        index = sample.index("author_timestamp")
    else:
        rows, index = facts(commits, by), sample.index_of_day("day")
    counted = T.aggregate_periods(rows, index, sample, by, [], ["commits_count"])
    filled = T.fill_gaps(counted, sample, by, ["commits_count"])
    return T.labelled(filled, sample, by).orderBy(*by, "period")


def months_of_current_year(commits: DataFrame, as_of, by=(), histories: DataFrame | None = None) -> DataFrame:
    """Commits per month of the year of ``as_of``, months outside the history with 0.

    The year's bounds are filters on the plain time or day column, so they reach the scan.
    ``histories`` as in :func:`recent_weeks`.
    """
    by = list(by)
    current = dt.datetime.fromtimestamp(S.epoch_seconds(as_of), dt.timezone.utc).year
    year = F.lit(current)
    first, end = ((dt.date(y, 1, 1) - dt.date(1970, 1, 1)).days for y in (current, current + 1))
    if is_rollup(commits):
        inside = commits.filter((F.col("day") >= first) & (F.col("day") < end))
    else:
        time = F.col("author_timestamp")
        inside = commits.filter((time >= first * S.DAY_SECONDS) & (time < end * S.DAY_SECONDS))
    counted = (
        facts(inside, by)
        .groupBy(*by, F.month(S.day_to_date("day")).alias("month"))
        .agg(F.sum("commits_count").alias("commits_count"))
    )
    twelve = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    if by:
        spine = _histories(commits, by, histories).select(*by, twelve)
    else:
        spine = commits.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (
        spine.join(counted, [*by, "month"], "left")
        .fillna(0, subset=["commits_count"])
        .select(*by, year.alias("year"), "month", S.month_name("month").alias("month_name"), "commits_count")
        .orderBy(*by, "month")
    )


def years_and_months(commits: DataFrame, by=()) -> DataFrame:
    """Monthly commit series with year and month as columns."""
    by = list(by)
    return commit_history(commits, "M", by).select(
        *by, F.year("period").alias("year"), F.month("period").alias("month"), "commits_count"
    )


def line_history(linear: DataFrame, sampling: str = "W", by=()) -> DataFrame:
    """First-parent history per period of committer time: running sums of lines, mean
    number of files of the period (of the last period with commits when it has none)."""
    by = list(by)
    sample = Sampling.parse(sampling)
    rows = linear.select(
        *by, "committer_timestamp", "insertions", "deletions", "files_count", F.lit(1).cast("long").alias("_rows")
    )
    sums = ["insertions", "deletions", "files_count", "_rows"]
    summed = T.aggregate_periods(rows, sample.index("committer_timestamp"), sample, by, [], sums)
    mean = F.try_divide(F.col("files_count").cast("double"), F.col("_rows").cast("double"))
    meaned = summed.withColumn("files_count", mean).drop("_rows")
    filled = T.fill_gaps(meaned, sample, by, ["insertions", "deletions"])
    ran = T.running(filled, sample, by, sums=["insertions", "deletions"], fills=["files_count"])
    return (
        T.labelled(ran, sample, by)
        .withColumn("lines_count", F.col("insertions") - F.col("deletions"))
        .select(*by, "period", "insertions", "deletions", "files_count", "lines_count")
        .orderBy(*by, "period")
    )
