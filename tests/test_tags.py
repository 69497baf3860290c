from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist import schemas as T
from annalist.operators import carry, tags

# One unreleased commit above a tag of three.
ASSIGNED = [
    (None, None, None, "Committer1", 1230000, False),
    ("v2", "Release Master", 1234, "Author2", 123000, True),
    ("v2", "Release Master", 1234, "Author1", 123, False),
    ("v2", "Release Master", 1234, "Author1", 14, False),
]
SCHEMA = (
    "tag_name string, tagger_name string, tagger_time long, commit_author string, commit_time long, is_merge boolean,"
    " walk_pos long"
)


def assigned(spark, records=ASSIGNED):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(records)], SCHEMA)


def history(spark, size):
    data = [("r", f"c{i}", i, False, f"a{i % 3}", "a@b", 0, 1000 - i, 0, 0, 0) for i in range(size)]
    return spark.createDataFrame(data, T.COMMITS)


def refs(spark, records):
    return spark.createDataFrame([("r", *r, i) for i, r in enumerate(records)], T.TAG_REFS)


def test_summary(spark):
    summary = tags.tag_summary(assigned(spark)).select(
        "tag", F.unix_seconds("created"), F.unix_seconds("initiated"), "tagger_name", "commits_count", "is_consistent"
    )
    assert rows(summary) == [
        ("unreleased", None, 1230000, None, 1, True),
        ("v2", 1234, 14, "Release Master", 3, True),
    ]
    v2 = tags.tag_contributors(tags.commits_of_tag(assigned(spark), "v2"))
    assert sorted(rows(v2, "commit_author", "commits_count")) == [("Author1", 2), ("Author2", 1)]
    assert rows(tags.tags_count(assigned(spark))) == [(2,)]
    assert tags.commits_of_tag(assigned(spark), None).count() == 1
    assert tags.tags_matching(assigned(spark), "^v").count() == 3


def test_history_without_tags_is_one_unreleased_group(spark):
    plain = tags.assign_tags(history(spark, 3), refs(spark, []).limit(0))
    assert rows(tags.tag_summary(plain), "tag", "created", "commits_count") == [("unreleased", None, 3)]


def test_two_tags_that_share_a_name_are_reported(spark):
    mixed = assigned(spark, [("v1", "x", 1, "a", 1, False), ("v1", None, None, "a", 1, False)])
    assert rows(tags.tag_summary(mixed), "is_consistent") == [(False,)]


def test_recent_tags(spark):
    summary = tags.tag_summary(assigned(spark))
    assert rows(tags.recent_tags(summary), "tag") == [("unreleased",), ("v2",)]
    assert rows(tags.recent_tags(summary, 1), "tag") == [("unreleased",)]
    assert rows(tags.recent_tags(summary, 0), "tag") == []


def test_last_reference_of_a_commit_wins(spark):
    found = tags.assign_tags(history(spark, 2), refs(spark, [("c1", "one", None, None), ("c1", "two", "t", 5)]))
    assert rows(found.orderBy("walk_pos"), "tag_name", "tagger_name") == [(None, None), ("two", "t")]


def test_chunks_equal_one_window(spark):
    """Every chunk size carries the same tags, also over chunks without any, and a
    lightweight tag does not inherit the tagger of the tag above it."""
    commits = history(spark, 40)
    marks = refs(spark, [("c4", "v9", "m", 9), ("c23", "v8", None, None), ("c24", "v7", "m", 7), ("c99", "lost", "m", 1)])
    window = Window.orderBy("walk_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = commits.join(tags.tag_targets(marks), "commit_id", "left")
    whole = joined.withColumn("_tag", F.last("_tag", ignorenulls=True).over(window))
    expected = rows(whole.orderBy("walk_pos"), "commit_id", "_tag.tag_name", "_tag.tagger_name")
    for chunk in (1, 3, 7, 1000):
        found = tags.assign_tags(commits, marks, chunk=chunk).orderBy("walk_pos")
        assert rows(found, "commit_id", "tag_name", "tagger_name") == expected


def test_repositories_do_not_share_tags(spark):
    one, two = history(spark, 6), history(spark, 6).withColumn("repo_id", F.lit("s"))
    found = tags.assign_tags(one.unionByName(two), refs(spark, [("c2", "v1", "m", 1)]), ["repo_id"], chunk=2)
    assert rows(found.filter("repo_id = 's' and tag_name is not null")) == []
    assert found.filter("repo_id = 'r' and tag_name = 'v1'").count() == 4


def test_sums_numbers_and_texts_are_carried_together(spark):
    """Over chunks of every size, with values that come back and chunks that hold none."""
    data = [("r" if i % 4 else "s", i, i % 3, i if i % 7 == 3 else None, "ab"[i % 2] if i % 9 == 5 else None) for i in range(60)]
    df = spark.createDataFrame(data, "repo_id string, place long, n long, number long, text string")
    window = Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = df.select(
        "repo_id", "place", F.sum("n").over(window), *[F.last(c, ignorenulls=True).over(window) for c in ("number", "text")]
    )
    for chunk in (1, 4, 11, 100):
        ran = carry.carry(df, ["repo_id"], "place", sums=["n"], fills=["number", "text"], chunk=chunk)
        assert sorted(rows(ran), key=repr) == sorted(rows(whole), key=repr)
