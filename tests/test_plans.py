"""What the plans must not contain, and what must reach the scan."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import contract.queries as contract
from annalist import schemas as T
from annalist.operators import activity, authors, identity, tags
from annalist.operators.lineage import Scratch

SF_DIR = "/root/testdata/sf0.001"
# these run jobs while the plan is built
LOOPS = {"first_parent", "reachable", "topological_order", "topological_order_equal_clocks", "linear_history_from_parents"}
QUERIES = sorted(set(contract.QUERIES) - LOOPS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    """Plans as they are when nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def below_global_windows(plan):
    """First source of rows under every window that runs in a single task."""
    for match in re.finditer(r"Window \[.*?\n(.*?\n){0,3}?.*?Exchange SinglePartition.*?\n((?:.*\n)*)", plan):
        yield re.search(r"HashAggregate|SortAggregate|TakeOrderedAndProject|Generate explode|FileScan", match.group(2)).group()


def test_the_check_notices_a_window_over_all_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3).write.parquet(path)
    rows = spark.read.schema("id long").parquet(path)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("id")))
    assert list(below_global_windows(plan_of(numbered))) == ["FileScan"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_pairs_no_global_window_over_rows(unbroadcast, name):
    plan = plan_of(contract.QUERIES[name](unbroadcast, SF_DIR))
    for operator in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    # a window without partitions may only see aggregated, limited or laid-out small rows
    assert "FileScan" not in below_global_windows(plan)


def test_time_bounds_reach_every_scan_of_keyed_statistics(spark, tmp_path):
    path = str(tmp_path / "commits")
    spark.createDataFrame([], T.COMMITS).write.parquet(path)
    commits = spark.read.schema(T.COMMITS).parquet(path)
    histories = spark.createDataFrame([("r",)], "repo_id string")
    for build in (
        activity.recent_weeks(commits, 1706704496, 4, ["repo_id"], histories),
        activity.months_of_current_year(commits, 1706704496, ["repo_id"], histories),
        activity.months_of_current_year(commits, 1706704496),
    ):
        scans = re.findall(r"PushedFilters: \[(.*?), ReadSchema", plan_of(build))
        assert scans and all("GreaterThan" in s and "author_timestamp" in s for s in scans)


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "commits")
    spark.createDataFrame([], T.COMMITS).write.parquet(path)
    commits = spark.read.schema(T.COMMITS).parquet(path)
    recent = plan_of(activity.recent_weeks(commits, 1706704496, 4))
    assert "GreaterThanOrEqual(author_timestamp" in recent
    assert "ReadSchema: struct<author_timestamp:bigint>" in recent
    zones = plan_of(activity.timezones(commits))
    assert "ReadSchema: struct<author_tz_offset:int>" in zones
    ranking = plan_of(authors.author_ranking(commits, "year", limit=3))
    assert "ReadSchema: struct<author_name:string,author_timestamp:bigint>" in ranking


def test_top_ranks_are_cut_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "commits")
    spark.createDataFrame([], T.COMMITS).write.parquet(path)
    plan = plan_of(authors.author_ranking(spark.read.schema(T.COMMITS).parquet(path), "month", limit=3))
    assert re.search(r"row_number\(\), 3, Partial", plan)


def scans(df):
    """The columns that every scan reads."""
    return [set(re.findall(r"(\w+)#", read)) for read in re.findall(r"FileScan parquet \[(.*?)\]", plan_of(df))]


@pytest.fixture
def stored_commits(unbroadcast, tmp_path):
    path = str(tmp_path / "commits")
    unbroadcast.createDataFrame([], T.COMMITS).write.parquet(path)
    return unbroadcast.read.schema(T.COMMITS).parquet(path)


def test_tags_read_the_commits_once_whole_and_once_narrow(stored_commits):
    refs = stored_commits.sparkSession.createDataFrame([("r", "c", "v1", None, None, 0)], T.TAG_REFS)
    for by in ([], ["repo_id"]):
        narrow, wide = sorted(scans(tags.assign_tags(stored_commits, refs, by)), key=len)
        assert narrow == {"commit_id", "walk_pos", *by} and narrow < wide


def test_a_crowded_identity_is_dealt_to_shares(stored_commits):
    """Rules meet different pairs only; rows are shuffled once, by name, e-mail and share."""
    rules = stored_commits.sparkSession.createDataFrame([("r", "A", None, None, "a@x", 0)], T.MAILMAP)
    resolved = identity.resolve_identities(stored_commits, rules, by=["repo_id"])
    narrow, wide = sorted(scans(resolved), key=len)
    assert narrow == {"repo_id", "author_name", "author_email"} and len(wide) == len(T.COMMITS)
    rows = [keys for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(resolved)) if "_share" in keys]
    assert len(rows) == 2 and all("author" in keys or "_written" in keys for keys in rows)
    bare = identity.resolve_identities(stored_commits, rules, by=["repo_id"]).select("commit_id", "author_name")
    assert max(scans(bare), key=len) == {"repo_id", "commit_id", "author_name", "author_email"}


@pytest.mark.parametrize("by", [[], ["repo_id"]])
def test_leaders_and_totals_come_from_one_written_sum(stored_commits, by):
    """Commits are read by the written table alone, which its owner deletes."""
    folder = stored_commits.inputFiles()[0].rsplit("/", 1)[0]
    for build in (authors.top_authors, lambda *a: authors.top_author_history(a[0], "W", *a[1:])):
        with Scratch(stored_commits.sparkSession) as scratch:
            found = build(stored_commits, 3, by, scratch)
            assert len(scratch.paths) == 1
            assert found.count() == 0
            assert not [f for f in found.inputFiles() if f.startswith(folder)]
            (path,) = scratch.paths
            assert os.path.isdir(path.removeprefix("file:"))
        assert not os.path.isdir(path.removeprefix("file:"))


@pytest.mark.parametrize("by", [[], ["repo_id"]])
def test_the_written_sums_read_the_commits_once(stored_commits, by, monkeypatch):
    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(df) or keep(self, df))
    authors.top_authors(stored_commits, 3, by)
    authors.top_author_history(stored_commits, "W", 3, by)
    authors.top_author_history(stored_commits, "12H", 3, by)
    assert [len(scans(df)) for df in written] == [1, 1, 1]
