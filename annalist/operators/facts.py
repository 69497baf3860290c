"""Commits as weighted facts: of one author and UTC day, or of one cell.

Statistics that need no time of day read *facts*; those of clock, zone, review duration and
domain read *cells*. A commits table is projected to rows of weight 1 (no shuffle); the rollups
made once by :func:`author_days`, :func:`commit_cells` or, both in one pass, :func:`rollups`
already are such tables, many times smaller, and can serve a whole report or be kept between
reports. Rolling up a rollup, or several united, is exact.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S

MEASURES = ("commits_count", "merge_commits_count", "insertions", "deletions")
ROLLUP_COLUMNS = {"author_name", "day", "first_timestamp", "last_timestamp", *MEASURES}
DAY = ("author_name", "day")
CELL = ("author_tz_offset", "weekday", "hour", "bin", "domain")


def is_rollup(df: DataFrame) -> bool:
    return ROLLUP_COLUMNS <= set(df.columns)


def _fact_columns():
    return [
        F.col("author_name"),
        S.epoch_day("author_timestamp").alias("day"),
        F.lit(1).cast("long").alias("commits_count"),
        F.col("is_merge_commit").cast("long").alias("merge_commits_count"),
        F.col("insertions").cast("long").alias("insertions"),
        F.col("deletions").cast("long").alias("deletions"),
        F.col("author_timestamp").alias("first_timestamp"),
        F.col("author_timestamp").alias("last_timestamp"),
    ]


def _sums():
    return [
        *[F.sum(m).alias(m) for m in MEASURES],
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    ]


def facts(commits: DataFrame, by=()) -> DataFrame:
    """Facts view of a commits table; a rollup is returned as it is."""
    return commits if is_rollup(commits) else commits.select(*by, *_fact_columns())


def author_days(commits: DataFrame, by=()) -> DataFrame:
    """Rollup per author and UTC day."""
    return facts(commits, by).groupBy(*by, *DAY).agg(*_sums())


def is_cells(df: DataFrame) -> bool:
    return {*CELL, "commits_count"} <= set(df.columns)


def _cell_columns(names):
    local = S.local_seconds("author_timestamp", "author_tz_offset")
    values = {
        "author_tz_offset": F.col("author_tz_offset"),
        "weekday": S.utc_weekday(local),
        "hour": S.utc_hour(local),
        "bin": S.duration_bin("review_duration"),
        "domain": S.email_domain("author_email"),
    }
    return [values[name].alias(name) for name in names]


def cells(commits: DataFrame, names=CELL, by=()) -> DataFrame:
    """Cells view of a commits table with the columns ``names``; a rollup is returned as it is.

    ``weekday`` (Monday = 0) and ``hour`` are on the author's clock; ``bin`` is the label of the
    review duration, NULL outside all bins.
    """
    if is_cells(commits):
        return commits
    return commits.select(*by, *_cell_columns(names), F.lit(1).cast("long").alias("commits_count"))


def commit_cells(commits: DataFrame, by=()) -> DataFrame:
    """Rollup per zone, weekday and hour, review-duration bin and e-mail domain."""
    return cells(commits, CELL, by).groupBy(*by, *CELL).agg(F.sum("commits_count").alias("commits_count"))


def rollups(commits: DataFrame, by=()) -> DataFrame:
    """Both rollups of a commits table in one scan; ``is_cells`` tells them apart, and
    :func:`days_of` and :func:`cells_of` take one out.

    Every commit becomes two rows inside the task that reads it; these are added up there
    before they are shuffled.
    """
    by = list(by)
    rows = commits.select(*by, *_fact_columns(), *_cell_columns(CELL))
    sets = [[*by, *DAY], [*by, *CELL]]
    return rows.groupingSets(sets, *by, *DAY, *CELL).agg((F.grouping("day") == 1).alias("is_cells"), *_sums())


def days_of(both: DataFrame, by=()) -> DataFrame:
    rest = [*MEASURES, "first_timestamp", "last_timestamp"]
    return both.filter(~F.col("is_cells")).select(*by, *DAY, *rest)


def cells_of(both: DataFrame, by=()) -> DataFrame:
    return both.filter("is_cells").select(*by, *CELL, "commits_count")
