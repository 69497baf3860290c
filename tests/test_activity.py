from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F
from samples import at, commits

from annalist import schemas as T
from annalist.functions.scalars import epoch_seconds
from annalist.operators import activity, facts


def test_totals(spark):
    total = activity.commit_totals(commits(spark)).select(
        "commits_count",
        "merge_commits_count",
        F.unix_seconds("first_commit_date"),
        F.unix_seconds("last_commit_date"),
        "active_days_count",
        "age_days",
    )
    assert rows(total) == [(4, 1, 1185807283, 1583449674, 3, (1583449674 - 1185807283) // 86400)]


def test_totals_of_nothing(spark):
    empty = commits(spark).filter("false")
    assert rows(activity.commit_totals(empty)) == [(0, 0, None, None, 0, None)]
    lines = spark.createDataFrame([], T.LINEAR_HISTORY)
    assert rows(activity.line_totals(lines)) == [(0, 0, 0)]


def test_timezones_and_domains(spark):
    assert rows(activity.timezones(commits(spark)), "timezone", "commits_count") == [
        ("-0200", 1),
        ("+0000", 1),
        ("+0100", 2),
    ]
    assert rows(activity.domains(commits(spark))) == [("author1.com", 2), ("author2.com", 1), ("author3.com", 1)]


def test_domains_fold_only_when_there_are_more(spark):
    history = commits(spark)
    assert rows(activity.domains_with_others(history, 3), "domain", "is_others") == [
        ("author1.com", False),
        ("author2.com", False),
        ("author3.com", False),
    ]
    assert rows(activity.domains_with_others(history, 2)) == [
        (1, "author1.com", False, 2),
        (2, "author2.com", False, 1),
        (None, "Others", True, 1),
    ]


def test_a_domain_called_others_stays_apart(spark):
    history = commits(spark, email="x@Others").limit(2).unionByName(commits(spark))
    folded = rows(activity.domains_with_others(history, 1), "domain", "is_others", "commits_count")
    assert len(folded) == 2 and sum(r[2] for r in folded) == 6


def test_review_bins_keep_empty_bins_and_drop_what_fits_none(spark):
    durations = [0, 1, 2, 3600, -1, 94608001, 94608000]
    data = [("r", str(i), i, False, "a", "a@b", 0, 0, d, 0, 0) for i, d in enumerate(durations)]
    counted = activity.review_durations(spark.createDataFrame(data, T.COMMITS))
    assert rows(counted, "commits_count") == [(2,), (2,), (0,), (0,), (0,), (0,), (0,), (0,), (1,)]


def test_recent_weeks_of_a_commit_now(spark):
    now = datetime(2024, 1, 31, 12, 34, 56)
    counted = activity.recent_weeks(at(spark, [epoch_seconds(now)]), now, 2)
    assert rows(counted, "weeks_ago", "commits_count") == [(1, 0), (0, 1)]


def weekly_by_hand(times, now, weeks):
    today = pd.Timestamp(now)
    coming = today + (pd.Timedelta(weeks=1) if today.weekday() == 6 else pd.Timedelta(days=7 - today.weekday()))
    edges = pd.date_range(end=coming, periods=weeks + 1, freq="W-SUN", normalize=True)
    stamps = pd.Series(pd.to_datetime(times, unit="s"))
    stamps = stamps[stamps >= coming - pd.Timedelta(weeks=weeks)]
    return pd.cut(stamps, bins=edges).value_counts(sort=False).tolist()


@pytest.mark.parametrize("hours", [0, 13, 37, 61, 85, 109, 133, 157])
def test_recent_weeks_edges(spark, hours):
    now = datetime(2024, 1, 28) + timedelta(hours=hours)
    midnight = epoch_seconds(datetime(2024, 1, 28))
    times = [midnight + h * 3600 + s for h in range(-30 * 24, 15 * 24, 7) for s in (0, 1)]
    times += [midnight + d * 86400 for d in range(-35, 15)]
    counted = activity.recent_weeks(at(spark, times), now, 3)
    assert [r[0] for r in rows(counted, "commits_count")] == weekly_by_hand(times, now, 3)


def test_weekday_hours_use_the_author_clock(spark):
    monday = epoch_seconds(datetime(2024, 1, 1, 0, 30))
    history = at(spark, [monday], offset=-90).unionByName(at(spark, [monday], offset=90))
    busy = activity.weekday_hours(history).filter("commits_count > 0")
    assert rows(busy, "weekday", "hour", "commits_count") == [(0, 2, 1), (6, 23, 1)]
    margins = rows(activity.weekday_hour_margins(history))
    assert (0, None, 1, 1) in margins and (None, 23, 1, 1) in margins and (None, None, 2, 1) in margins
    matrix = {r["weekday"]: r for r in activity.weekday_hour_matrix(history).collect()}
    assert matrix[6]["h23"] == 1 and matrix[0]["h2"] == 1 and matrix[0]["h23"] == 0


def test_linear_history_accumulates_and_fills(spark):
    day = 86400
    data = [("r", "a", 0, 10, 5, 1), ("r", "b", 1, 20, 5, 2), ("r", "c", 21 * day, 3, 7, 0)]
    series = activity.line_history(spark.createDataFrame(data, T.LINEAR_HISTORY), "W")
    assert rows(series.withColumn("period", F.col("period").cast("string"))) == [
        ("1970-01-04", 10, 3, 15.0, 7),
        ("1970-01-11", 10, 3, 15.0, 7),
        ("1970-01-18", 10, 3, 15.0, 7),
        ("1970-01-25", 17, 3, 3.0, 14),
    ]
    hourly = activity.line_history(spark.createDataFrame(data, T.LINEAR_HISTORY), "H")
    assert hourly.count() == 21 * 24 + 1
    assert rows(hourly.orderBy(F.desc("period")).limit(2), "insertions", "files_count") == [(17, 3.0), (10, 15.0)]


def test_a_rollup_serves_like_the_commits(spark):
    history = commits(spark)
    days = facts.author_days(history)
    for statistic in (
        activity.commit_totals,
        activity.active_days,
        activity.months_of_year,
        lambda h: activity.commit_history(h, "M"),
        activity.years_and_months,
    ):
        assert rows(statistic(history)) == rows(statistic(days))
    # rolling up again, from parts, is exact
    parts = facts.author_days(history.limit(2)).unionByName(facts.author_days(history.limit(2)))
    assert facts.author_days(parts).agg(F.sum("commits_count")).first()[0] == 4
    with pytest.raises(ValueError):
        activity.commit_history(days, "H")


def test_many_repositories_in_one_job(spark):
    one = commits(spark)
    two = commits(spark).limit(1).withColumn("repo_id", F.lit("s"))
    both = one.unionByName(two)
    by = ["repo_id"]
    assert rows(activity.commit_totals(both, by).orderBy("repo_id"), "repo_id", "commits_count") == [("r", 4), ("s", 1)]
    weeks = activity.recent_weeks(both, 1583449674, 2, by)
    assert rows(weeks, "repo_id", "commits_count") == [("r", 0), ("r", 1), ("s", 0), ("s", 0)]
    assert rows(activity.months_of_current_year(both, 1583449674, by).filter("month = 2"), "repo_id", "commits_count") == [
        ("r", 2),
        ("s", 1),
    ]
    heat = activity.heat_levels(activity.months_of_year(both, by), 5, by).filter("heat = 4")
    assert {r[0] for r in rows(heat, "repo_id")} == {"r", "s"}
