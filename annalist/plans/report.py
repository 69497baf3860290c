"""The report as tables: general, activity, authors, files, tags.

``report_tables`` builds lazy DataFrames, ``write_report`` writes one directory each.
"""

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.functions.periods import Sampling, label_epoch_millis
from annalist.operators import activity, authors, revision, tags
from annalist.operators.facts import cells_of, days_of, rollups
from annalist.operators.grouping import with_totals
from annalist.operators.lineage import Scratch


@dataclass(frozen=True)
class Options:
    """Report settings with their defaults."""

    max_domains: int = 10
    max_authors: int = 20
    max_plot_authors_count: int = 10
    max_authors_of_months: int = 6
    authors_top: int = 5
    orphaned_extension_count: int = 0
    max_recent_tags: int | None = None
    time_sampling: str = "W"
    recent_weeks: int = 32
    knowledge_loss_months: int = 6
    top_files: int = 10
    next_authors_of_month: int = 4
    heat_levels: int = 10

    @classmethod
    def from_json(cls, text: str) -> "Options":
        """Settings of a JSON object over the defaults; unknown keys are left out."""
        known = {field.name for field in fields(cls)}
        return cls(**{key: value for key, value in json.loads(text).items() if key in known})


@dataclass(frozen=True)
class History:
    """Input tables of a report. Without blame, blame tables are left out; without
    assigned tags, tag tables are. ``by`` names the columns of one repository."""

    commits: DataFrame
    linear_history: DataFrame
    files: DataFrame
    blame: DataFrame | None = None
    assigned_tags: DataFrame | None = None
    by: tuple = ()


def _side_by_side(tables, by):
    return reduce(lambda left, right: with_totals(left, right, by), tables)


def general(history: History, days: DataFrame | None = None) -> DataFrame:
    """One row per repository: age, commits, authors, files, lines and their ratios; files and
    lines are 0 for a repository without any."""
    by = list(history.by)
    facts = history.commits if days is None else days
    row = _side_by_side(
        [
            activity.commit_totals(facts, by),
            authors.authors_count(facts, by),
            revision.file_totals(history.files, by).select(*by, "files_count"),
            activity.line_totals(history.linear_history, by),
        ],
        by,
    ).fillna(0, subset=["files_count", "added_lines_count", "removed_lines_count", "total_lines_count"])
    return (
        row.withColumn("active_days_percent", S.guarded_percent("active_days_count", "age_days"))
        .withColumn("merge_commits_percent", S.guarded_percent("merge_commits_count", "commits_count"))
        .withColumn("commits_per_day", S.guarded_ratio("commits_count", "age_days"))
        .withColumn("commits_per_active_day", S.guarded_ratio("commits_count", "active_days_count"))
        .withColumn("commits_per_author", S.guarded_ratio("commits_count", "authors_count"))
    )


def files_overview(history: History, options: Options, as_of=None) -> DataFrame:
    """One row per repository: files, size, and with blame mono-author files and lost knowledge."""
    by = list(history.by)
    tables = [revision.file_totals(history.files, by)]
    if history.blame is not None:
        mono = revision.monoauthor_files(history.blame, by).groupBy(*by)
        tables.append(mono.agg(F.count(F.lit(1)).alias("monoauthor_files_count")))
        lost = revision.lost_knowledge(history.blame, as_of, options.knowledge_loss_months, by)
        tables.append(lost.select(*by, "lost_knowledge_ratio"))
    row = _side_by_side(tables, by)
    if history.blame is not None:
        row = row.fillna(0, subset=["monoauthor_files_count"]).withColumn(
            "monoauthor_files_percent", S.guarded_percent("monoauthor_files_count", "files_count")
        )
    return row


def file_series(history: History, options: Options) -> DataFrame:
    """Files and lines per period with plotting times and the maxima of both series."""
    by = list(history.by)
    sample = Sampling.parse(options.time_sampling)
    series = activity.line_history(history.linear_history, options.time_sampling, by)
    if sample.is_clock:
        maxima = series.groupBy(*by).agg(
            F.floor(F.max("files_count")).alias("max_files"), F.max("lines_count").alias("max_lines")
        )
        series = with_totals(series, maxima, by)
    else:
        # days and longer: a short series, read once
        whole = Window.partitionBy(*by)
        series = series.withColumns({"max_files": F.floor(F.max("files_count").over(whole)), "max_lines": F.max("lines_count").over(whole)})
    return series.withColumn("epoch_millis", label_epoch_millis(F.col("period"), sample))


def report_tables(
    history: History,
    as_of,
    options: Options = Options(),
    days: DataFrame | None = None,
    cells: DataFrame | None = None,
    scratch: Scratch | None = None,
    names: list | None = None,
) -> dict:
    """All report tables by name, or those of ``names``. ``days`` and ``cells`` may hold the rollups of the commits
    per author and day and per cell. With both, only the recent weeks read the commits, as
    they cut days (behind a bound on time), and an author series of periods below a day.
    ``scratch`` owns the summaries of authors that are written while the tables are built."""
    by = list(history.by)
    commits = history.commits
    facts = commits if days is None else days
    sampled = commits if Sampling.parse(options.time_sampling).is_clock else facts
    clocks = commits if cells is None else cells
    tables = {
        "general": lambda: general(history, facts),
        "recent_weeks": lambda: activity.recent_weeks(commits, as_of, options.recent_weeks, by, histories=facts),
        "months_of_current_year": lambda: activity.months_of_current_year(facts, as_of, by),
        "years": lambda: activity.commit_history(facts, "Y", by),
        "years_and_months": lambda: activity.years_and_months(facts, by),
        "review_durations": lambda: activity.review_durations(clocks, by),
        "weekday_hours": lambda: activity.heat_levels(activity.weekday_hours(clocks, by), options.heat_levels, by),
        "weekday_hour_margins": lambda: activity.weekday_hour_margins(clocks, by),
        "timezones": lambda: activity.heat_levels(activity.timezones(clocks, by), options.heat_levels, by),
        "months_of_year": lambda: activity.heat_levels(
            activity.months_of_year(facts, by, all_months=True), options.heat_levels, by
        ),
        "top_authors": lambda: authors.top_authors(facts, options.max_authors, by, scratch),
        "remaining_authors": lambda: authors.remaining_authors(facts, options.max_authors, by),
        "authors_of_months": lambda: authors.authors_of_periods(
            facts, "month", options.max_authors_of_months, options.next_authors_of_month, by
        ),
        "authors_of_years": lambda: authors.authors_of_periods(facts, "year", None, options.authors_top, by),
        "author_series": lambda: authors.top_author_history(
            sampled, options.time_sampling, options.max_plot_authors_count, by, scratch
        ),
        "domains": lambda: activity.domains_with_others(clocks, options.max_domains, by),
        "files_overview": lambda: files_overview(history, options, as_of),
        "file_series": lambda: file_series(history, options),
        "extensions": lambda: revision.extension_shares(
            revision.extensions_folded(history.files, options.orphaned_extension_count, by),
            history.files,
            activity.line_totals(history.linear_history, by),
            by,
        ),
    }
    if history.blame is not None:
        blame = history.blame
        tables["contribution"] = lambda: revision.contribution_with_others(blame, options.max_plot_authors_count, by)
        tables["knowledge_carriers"] = lambda: revision.knowledge_carriers(
            blame, as_of, options.knowledge_loss_months, options.authors_top, by
        )
        tables["top_files"] = lambda: revision.top_files(blame, options.top_files, by)
    wants_tags = options.max_recent_tags is None or options.max_recent_tags > 0
    if history.assigned_tags is not None and wants_tags:
        assigned = history.assigned_tags
        tables["tags"] = lambda: tags.recent_tags(tags.tag_summary(assigned, by), options.max_recent_tags, by)
        tables["tag_contributors"] = lambda: tags.tag_contributors(assigned, by)
        tables["tags_count"] = lambda: tags.tags_count(assigned, by)
    return {name: build() for name, build in tables.items() if names is None or name in names}


def write_report(
    history: History, path: str, as_of, options: Options = Options(), format: str = "parquet", mode: str = "errorifexists"
) -> list:
    """Write every report table to ``path/<table>`` and return the table names.

    The rollups ``author_days`` and ``commit_cells`` come first, from one pass over the
    commits, and are read back: later tables scan them instead, and they survive a lost
    executor. The commits are read twice in all, the second time for the recent weeks.
    """
    spark, by = history.commits.sparkSession, list(history.by)

    def save(table, name):
        table.write.format(format).mode(mode).save(f"{path}/{name}")
        return spark.read.format(format).schema(table.schema).load(f"{path}/{name}")

    with Scratch(spark) as scratch:
        both = scratch.keep(rollups(history.commits, by))
        days, cells = save(days_of(both, by), "author_days"), save(cells_of(both, by), "commit_cells")
        tables = report_tables(history, as_of, options, days, cells, scratch)
        for name, table in tables.items():
            save(table, name)
    return ["author_days", "commit_cells", *tables]
