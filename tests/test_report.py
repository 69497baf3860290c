import pytest
from helpers import rows
from pyspark.sql import types
from samples import blame, commits, files
from test_tags import history as tagged_history
from test_tags import refs

from annalist import schemas as T
from annalist.operators import tags
from annalist.operators.facts import author_days, cells_of, commit_cells, days_of, rollups
from annalist.plans.report import History, Options, general, report_tables, write_report


def sample(spark, by=()):
    linear = spark.createDataFrame([("r", "a", 1580666336, 4, 10, 3), ("r", "b", 1583449674, 5, 2, 1)], T.LINEAR_HISTORY)
    assigned = tags.assign_tags(tagged_history(spark, 6), refs(spark, [("c2", "v1", "m", 1)]), by)
    return History(commits(spark), linear, files(spark), blame(spark), assigned, by)


def test_options():
    assert Options.from_json("{}") == Options()
    assert Options.from_json('{"max_authors": 7, "colormap": "classic"}').max_authors == 7
    assert Options().time_sampling == "W" and Options().max_recent_tags is None


def test_general_row(spark):
    row = general(sample(spark)).first()
    assert (row["commits_count"], row["authors_count"], row["files_count"], row["total_lines_count"]) == (4, 3, 4, 8)
    assert row["merge_commits_percent"] == 25.0 and row["commits_per_active_day"] == 4 / 3


@pytest.mark.parametrize("by, format", [((), "json"), (("repo_id",), "parquet")])
def test_written_report_equals_the_lazy_tables(spark, tmp_path, by, format):
    history = sample(spark, by)
    path = str(tmp_path / "report")
    names = write_report(history, path, 1583449674, format=format)
    tables = report_tables(history, 1583449674)
    assert names == ["author_days", "commit_cells", *tables]
    for name, table in tables.items():
        read = spark.read.format(format).schema(table.schema).load(f"{path}/{name}")
        assert sorted(map(repr, rows(read))) == sorted(map(repr, rows(table))), name


def test_optional_parts(spark):
    full = sample(spark)
    bare = History(full.commits, full.linear_history, full.files)
    names = set(report_tables(bare, 0))
    assert not names & {"contribution", "knowledge_carriers", "top_files", "tags"}
    assert "lost_knowledge_ratio" not in report_tables(bare, 0)["files_overview"].columns
    assert "tags" not in report_tables(full, 0, Options(max_recent_tags=0))
    assert report_tables(full, 0, Options(max_recent_tags=1))["tags"].count() == 1


def test_clock_sampling_reads_the_commits(spark, tmp_path):
    names = write_report(sample(spark), str(tmp_path / "report"), 1583449674, Options(time_sampling="12H"))
    assert "author_series" in names


@pytest.mark.parametrize("by", [(), ("repo_id",)])
def test_one_pass_makes_both_rollups(spark, by):
    """Also of merged rollups, and with NULLs in every key."""
    loose = types.StructType([types.StructField(f.name, f.dataType) for f in T.COMMITS])
    odd = spark.createDataFrame([("r", *[None] * 10)], loose)
    history = commits(spark).unionByName(odd)
    both = rollups(history, by)
    for found, alone in ((days_of(both, by), author_days(history, by)), (cells_of(both, by), commit_cells(history, by))):
        assert found.columns == alone.columns
        assert sorted(map(repr, rows(found))) == sorted(map(repr, rows(alone)))
    twice = commit_cells(commit_cells(commits(spark), by).unionByName(commit_cells(odd, by)), by)
    assert sorted(map(repr, rows(twice))) == sorted(map(repr, rows(cells_of(both, by))))


@pytest.mark.parametrize("by", [(), ("repo_id",)])
def test_commits_are_read_by_the_rollups_and_the_recent_weeks_only(spark, tmp_path, by):
    def stored(name, table):
        table.write.parquet(str(tmp_path / name))
        return spark.read.schema(table.schema).parquet(str(tmp_path / name))

    given = sample(spark, by)
    names = ("commits", "linear_history", "files", "blame", "assigned_tags")
    history = History(*[stored(name, getattr(given, name)) for name in names], by)
    plan = rollups(history.commits, by)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    both = rollups(history.commits, by)
    days, cells = stored("days", days_of(both, by)), stored("cells", cells_of(both, by))
    tables = report_tables(history, 1583449674, Options(), days, cells)
    assert {n for n, t in tables.items() if any("/commits/" in f for f in t.inputFiles())} == {"recent_weeks"}
    plan = tables["recent_weeks"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(author_timestamp") == plan.count("author_timestamp:bigint") == 1
