"""Release attribution: which tag a commit belongs to, and statistics per tag."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import carry
from annalist.operators.grouping import top_rows


def tag_targets(tag_refs: DataFrame, by=()) -> DataFrame:
    """One tag per commit: the last reference wins."""
    tag = F.struct("tag_name", "tagger_name", "tagger_time")
    return tag_refs.groupBy(*by, "commit_id").agg(F.max_by(tag, "ref_order").alias("_tag"))


def assign_tags(commits: DataFrame, tag_refs: DataFrame, by=(), chunk: int = carry.CHUNK) -> DataFrame:
    """Commits in walk order, each with the tag met last on the walk down from the head.

    Commits above the first tag stay without one (unreleased). The walk is cut into
    chunks, so a history of any length spreads over many tasks.
    """
    by = list(by)
    walked = commits.select(
        *by,
        "commit_id",
        "walk_pos",
        F.col("author_name").alias("commit_author"),
        F.col("author_timestamp").alias("commit_time"),
        F.col("is_merge_commit").alias("is_merge"),
    ).join(tag_targets(tag_refs, by), [*by, "commit_id"], "left")
    filled = carry.carry(walked, by, "walk_pos", fills=["_tag"], chunk=chunk)
    return filled.select(
        *by,
        "commit_id",
        "walk_pos",
        F.col("_tag.tag_name").alias("tag_name"),
        F.col("_tag.tagger_name").alias("tagger_name"),
        F.col("_tag.tagger_time").alias("tagger_time"),
        "commit_author",
        "commit_time",
        "is_merge",
    )


def commits_of_tag(assigned: DataFrame, tag_name: str | None) -> DataFrame:
    """Commits of one tag; None selects the unreleased ones."""
    return assigned.filter(F.col("tag_name").eqNullSafe(F.lit(tag_name)))


def tags_matching(assigned: DataFrame, pattern: str) -> DataFrame:
    """Commits of the tags whose name matches a regular expression."""
    return assigned.filter(F.col("tag_name").rlike(pattern))


def tag_summary(assigned: DataFrame, by=()) -> DataFrame:
    """One row per tag in walk order (newest first): commits, times, tagger, contributors.

    ``walk_start`` orders the tags. ``is_consistent`` is false when the commits of a tag
    disagree on tagger or creation time, which means two tags share one name.
    """
    # the tagger is a key first, so that the many rows are aggregated by numbers only
    runs = assigned.groupBy(*by, "tag_name", "tagger_name", "tagger_time").agg(
        F.count(F.lit(1)).alias("commits_count"),
        F.min("commit_time").alias("_initiated"),
        F.min("walk_pos").alias("walk_start"),
    )
    summed = runs.groupBy(*by, "tag_name").agg(
        F.sum("commits_count").alias("commits_count"),
        F.min("_initiated").alias("_initiated"),
        F.min("tagger_time").alias("_created"),
        F.min("tagger_name").alias("tagger_name"),
        F.min("walk_start").alias("walk_start"),
        (F.count(F.lit(1)) == 1).alias("is_consistent"),
    )
    return summed.select(
        *by,
        "walk_start",
        S.tag_display_name("tag_name").alias("tag"),
        "tag_name",
        S.utc_timestamp("_created").alias("created"),
        S.utc_timestamp("_initiated").alias("initiated"),
        "tagger_name",
        "commits_count",
        "is_consistent",
    ).orderBy(*by, "walk_start")


def recent_tags(summary: DataFrame, max_recent: int | None = None, by=()) -> DataFrame:
    """The first tags in walk order: all when ``max_recent`` is absent, none for 0."""
    if max_recent is None:
        return summary.orderBy(*by, "walk_start")
    return top_rows(summary, by, [F.asc("walk_start")], max(max_recent, 0), "_rank").drop("_rank").orderBy(*by, "walk_start")


def tag_contributors(assigned: DataFrame, by=()) -> DataFrame:
    """Commits per tag and author, in any order."""
    return (
        assigned.groupBy(*by, "tag_name", "commit_author")
        .agg(F.count(F.lit(1)).alias("commits_count"))
        .select(*by, "tag_name", S.tag_display_name("tag_name").alias("tag"), "commit_author", "commits_count")
    )


def tag_names(assigned: DataFrame, by=()) -> DataFrame:
    """Distinct tag names; NULL stands for the unreleased group."""
    return assigned.select(*by, "tag_name").distinct()


def tags_count(assigned: DataFrame, by=()) -> DataFrame:
    """Number of tag groups, the unreleased one included."""
    return tag_names(assigned, by).groupBy(*by).agg(F.count(F.lit(1)).alias("tags_count"))
