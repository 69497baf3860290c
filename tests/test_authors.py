from datetime import datetime

from helpers import rows
from pyspark.sql import functions as F
from samples import at, commits

from annalist.functions.scalars import epoch_seconds
from annalist.operators import authors


def test_summary(spark):
    summary = authors.author_summary(commits(spark))
    shown = summary.select(
        "author_name",
        "commits_count",
        "merge_commits_count",
        "insertions",
        "deletions",
        "active_days_count",
        "contributed_days_count",
    ).orderBy("author_name")
    assert rows(shown) == [
        ("Author1", 2, 1, 6, 4, 2, 32),
        ("Author2", 1, 0, 3, 2, 1, 1),
        ("Author3", 1, 0, 1, 4, 1, 1),
    ]
    assert authors.sort_authors(summary).first()["author_name"] == "Author1"
    assert rows(authors.author(summary, "Author3"), "commits_count") == [(1,)]
    assert rows(authors.authors_count(commits(spark))) == [(3,)]
    assert authors.author_names(commits(spark)).count() == 3


def test_rankings(spark):
    days = [datetime(2020, 1, 17), datetime(2019, 11, 15), datetime(2020, 3, 1)]
    history = at(spark, [epoch_seconds(d) for d in days], ["Author1", "Author2", "Author1"])
    assert sorted(rows(authors.author_ranking(history, "year"))) == [(2019, 1, "Author2", 1), (2020, 1, "Author1", 2)]
    months = {(r[0], r[2]): r[3] for r in rows(authors.author_ranking(history, "month"))}
    assert months == {("2020-01", "Author1"): 1, ("2019-11", "Author2"): 1, ("2020-03", "Author1"): 1}


def test_ties_rank_by_name_and_limits_agree_with_full_ranks(spark):
    names = ["b", "a", "c", "c", "d"]
    history = at(spark, [0] * 5, names)
    full = sorted(rows(authors.author_ranking(history, "year")))
    assert full == [(1970, 1, "c", 2), (1970, 2, "a", 1), (1970, 3, "b", 1), (1970, 4, "d", 1)]
    assert sorted(rows(authors.author_ranking(history, "year", limit=2))) == full[:2]


def test_author_of_the_month(spark):
    month = 31 * 86400
    history = at(spark, [0, 0, 0, month, month], ["b", "b", "a", "c", "d"])
    found = rows(authors.authors_of_periods(history, "month", 6, 4))
    assert found == [("1970-02", "c", 1, "d", 2, 2), ("1970-01", "b", 2, "a", 3, 2)]
    assert rows(authors.authors_of_periods(history, "month", 1, 0)) == [("1970-02", "c", 1, "", 2, 2)]


def test_top_and_remaining_authors_are_everyone(spark):
    history = commits(spark)
    top = authors.top_authors(history, 2)
    assert rows(top, "rank", "author_name", "commits_percent") == [(1, "Author1", 50.0), (2, "Author2", 25.0)]
    assert rows(authors.remaining_authors(history, 2), "author_name") == [("Author3",)]
    assert authors.remaining_authors(history, 3).count() == 0


def test_recency(spark):
    assert rows(authors.authors_by_recency(commits(spark)), "author_name") == [("Author1",), ("Author2",), ("Author3",)]


def test_top_history_folds_fills_and_differs(spark):
    week = 7 * 86400
    history = at(spark, [0, 0, 2 * week, 2 * week, 2 * week, 0], ["a", "b", "a", "b", "c", "a"])
    series = authors.top_author_history(history, "W", 1)
    shown = [
        (r["author_name"], r["is_others"], r["commits_count"], r["commits_delta"], r["period_commits_count"])
        for r in series.collect()
    ]
    assert shown == [
        ("a", False, 2, 0, 2),
        ("a", False, 2, 0, 0),
        ("a", False, 3, 1, 1),
        ("Others", True, 1, 0, 1),
        ("Others", True, 1, 0, 0),
        ("Others", True, 3, 2, 2),
    ]
    assert series.first()["epoch_millis"] == 3 * 86400 * 1000


def test_hourly_author_history(spark):
    series = authors.author_history(at(spark, [10, 20, 3700], ["a", "a", "b"]), "H")
    assert sorted(rows(series.select(F.unix_seconds("period"), "author_name", "commits_count"))) == [(0, "a", 2), (3600, "b", 1)]
    top = authors.top_author_history(at(spark, [10, 20, 3700], ["a", "a", "b"]), "H", 1)
    assert rows(top, "author_name", "commits_count") == [("a", 2), ("a", 2), ("Others", 0), ("Others", 1)]
