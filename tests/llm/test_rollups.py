import oracle_check
import pytest
from pyspark.sql import functions as F

from annalist.llm import rollups
from annalist.llm.queries import ORACLE, QUERIES

SCHEMA = "source string, lang string, tokenizer_version string, tokens bigint, old_tokens bigint, new_tokens bigint, documents string"


def totals(rollup):
    return sorted(((r.source, r.lang, r.tokenizer_version, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)


def test_signed_batches(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "rollup"))
    rows = [("a", "en", "v1", 10, 10, 12, "x"), ("a", "en", "v1", 5, 5, None, "x"), ("a", None, "v1", None, 0, 3, "x"), (None, "de", "v2", 7, 7, 7, "x")]
    counted = spark.createDataFrame(rows, SCHEMA)
    assert totals(rollup) == []
    rollup.commit("1", rollups.inserts(counted))
    first = [("a", "en", "v1", 2, 15), ("a", None, "v1", 1, 0), (None, "de", "v2", 1, 7)]
    assert totals(rollup) == sorted(first, key=str)
    rollup.commit("1", rollups.inserts(counted))  # again
    rollup.commit("nothing", rollups.inserts(counted.filter(F.lit(False))))
    assert totals(rollup) == sorted(first, key=str)
    rollup.commit("2", rollups.revisions(counted))
    assert totals(rollup) == sorted([("a", "en", "v1", 2, 12), ("a", None, "v1", 1, 3), (None, "de", "v2", 1, 7)], key=str)
    rollup.commit("3", rollups.deletes(counted.filter("source is null")))
    assert totals(rollup) == sorted([("a", "en", "v1", 2, 12), ("a", None, "v1", 1, 3)], key=str)
    with pytest.raises(ValueError):
        rollup.commit("../1", rollups.inserts(counted))


def test_order_of_batches_does_not_matter(spark, tmp_path):
    counted = spark.createDataFrame([("a", "en", "v1", 10, 10, 4, "x")], SCHEMA)
    batches = {"in": rollups.inserts(counted), "out": rollups.deletes(counted, "new_tokens"), "again": rollups.revisions(counted)}
    for k, names in enumerate((["in", "again", "out"], ["out", "in", "again", "out"])):
        rollup = rollups.Rollup(spark, str(tmp_path / str(k)))
        for name in names:
            rollup.commit(name, batches[name])
        assert totals(rollup) == []


def test_query_against_sql(spark, sf_dir):
    duck = oracle_check.connect(sf_dir)
    assert oracle_check.difference(QUERIES["op6_rollups"](spark, sf_dir), duck, ORACLE["op6_rollups"]) is None


def test_failing_replay_takes_nothing_away(spark, tmp_path):
    rollup = rollups.Rollup(spark, str(tmp_path / "rollup"))
    counted = spark.createDataFrame([("a", "en", "v1", 10, 10, 4, "x")], SCHEMA)
    rollup.commit("1", rollups.inserts(counted))
    failing = counted.withColumn("tokens", F.raise_error(F.lit("lost")).cast("bigint"))
    rollup.commit("1", rollups.inserts(failing))
    assert totals(rollup) == [("a", "en", "v1", 1, 10)]
    # a first commit that fails is not taken for one
    with pytest.raises(Exception, match="lost"):
        rollup.commit("2", rollups.inserts(failing))
    rollup.commit("2", rollups.inserts(counted))
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]


def test_incomplete_batches_do_not_count(spark, tmp_path):
    folder = tmp_path / "rollup"
    rollup = rollups.Rollup(spark, str(folder))
    counted = spark.createDataFrame([("a", "en", "v1", 10, 10, 4, "x")], SCHEMA)
    rollup.commit("1", rollups.inserts(counted))
    rollup.commit("2", rollups.inserts(counted))
    (folder / "batch_id=2" / "_SUCCESS").unlink()
    assert totals(rollup) == [("a", "en", "v1", 1, 10)]
    rollup.commit("2", rollups.inserts(counted))  # takes the place of what was left
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]
    # files of a writer that died before it renamed
    rollups.inserts(counted).write.parquet(str(folder / "_attempt-dead"))
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """The second has looked before the first renamed, and renames after it."""
    folder = tmp_path / "rollup"
    counted = spark.createDataFrame([("a", "en", "v1", 10, 10, 4, "x")], SCHEMA)
    late = rollups.Rollup(spark, str(folder))
    monkeypatch.setattr(late, "_committed", lambda: [])
    rollups.Rollup(spark, str(folder)).commit("0", rollups.inserts(counted))
    files, path = late._files()

    class Racing:
        def __getattr__(self, name):
            return getattr(files, name)

        def rename(self, attempt, goal):
            rollups.Rollup(spark, str(folder)).commit("1", rollups.inserts(counted))
            return files.rename(attempt, goal)

    monkeypatch.setattr(late, "_files", lambda: (Racing(), path))
    late.commit("1", rollups.inserts(counted))
    assert totals(rollups.Rollup(spark, str(folder))) == [("a", "en", "v1", 2, 20)]
    assert not [p for p in folder.rglob("_attempt*")]
