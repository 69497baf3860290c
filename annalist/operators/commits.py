"""From exported records to the two history tables and the blame table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators import carry
from annalist.operators.graph import first_parent_chain, merge_flags
from annalist.operators.identity import resolve_identities
from annalist.operators.lineage import Scratch


def commit_line_stats(commit_files: DataFrame, by=()) -> DataFrame:
    """Lines inserted and deleted per commit against its first parent; binary files count 0."""
    return commit_files.groupBy(*by, "commit_id").agg(
        F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
    )


def whole_history(
    raw_commits: DataFrame, parents: DataFrame, commit_files: DataFrame, mailmap: DataFrame | None = None, by=()
) -> DataFrame:
    """All commits with their line counts; merges count 0 lines.

    The three inputs meet on ``commit_id``, which is unique after pre-aggregation.
    """
    by = list(by)
    keys = [*by, "commit_id"]
    if mailmap is not None:
        raw_commits = resolve_identities(raw_commits, mailmap, by=by)
    joined = raw_commits.join(merge_flags(parents, by), keys, "left").join(
        commit_line_stats(commit_files, by), keys, "left"
    )
    is_merge = F.coalesce("is_merge", F.lit(False))

    def lines(name):
        return F.when(is_merge, F.lit(0)).otherwise(F.coalesce(F.col(name), F.lit(0))).cast("long").alias(name)

    return joined.select(
        *by,
        "commit_id",
        "walk_pos",
        is_merge.alias("is_merge_commit"),
        "author_name",
        "author_email",
        "author_tz_offset",
        "author_timestamp",
        S.review_duration("author_timestamp", "committer_timestamp").alias("review_duration"),
        lines("insertions"),
        lines("deletions"),
    )


def tree_file_counts(tree_entries: DataFrame, by=()) -> DataFrame:
    """Files per commit from full tree listings ``(commit_id, path)``."""
    return tree_entries.groupBy(*by, "commit_id").agg(F.count(F.lit(1)).alias("files_count"))


def chain_file_counts(chain: DataFrame, file_changes: DataFrame, by=(), chunk: int = carry.CHUNK) -> DataFrame:
    """Files in the tree of every commit of a first-parent chain ``(commit_id, walk_pos)``,
    as files created minus files removed so far, oldest commit first."""
    by = list(by)
    net = file_changes.groupBy(*by, "commit_id").agg(F.sum("change").alias("files_count"))
    steps = (
        chain.select(*by, "commit_id", (-F.col("walk_pos")).alias("_step"))
        .join(net, [*by, "commit_id"], "left")
        .fillna(0, subset=["files_count"])
    )
    return carry.carry(steps, by, "_step", sums=["files_count"], chunk=chunk).select(*by, "commit_id", "files_count")


def linear_history(
    raw_commits: DataFrame,
    parents: DataFrame,
    commit_files: DataFrame,
    heads: DataFrame,
    file_changes: DataFrame | None = None,
    tree_entries: DataFrame | None = None,
    by=(),
    scratch: Scratch | None = None,
) -> DataFrame:
    """Commits on the first-parent chain of the heads; merges count their lines against
    the first parent. Files are counted from tree listings if given, else from changes.
    ``scratch`` owns the chain's table."""
    by = list(by)
    keys = [*by, "commit_id"]
    chain = raw_commits.select(*keys, "walk_pos", "committer_timestamp").join(
        first_parent_chain(parents, heads, by, scratch), keys, "left_semi"
    )
    if tree_entries is not None:
        files = tree_file_counts(tree_entries, by)
    else:
        files = chain_file_counts(chain, file_changes, by)
    return (
        chain.join(files, keys, "left")
        .join(commit_line_stats(commit_files, by), keys, "left")
        .fillna(0, subset=["files_count", "insertions", "deletions"])
        .select(*keys, "committer_timestamp", "files_count", "insertions", "deletions")
    )


def blame(
    blame_lines: DataFrame,
    raw_commits: DataFrame,
    files: DataFrame | None = None,
    submodules: DataFrame | None = None,
    mailmap: DataFrame | None = None,
    revision: str | None = None,
    by=(),
) -> DataFrame:
    """Lines of a revision per file, committer and time.

    A commit without a usable committer is credited to its author. Binary files and
    submodules are left out. Lines of commits that ``raw_commits`` lacks (shallow clones, the
    log of another revision) stay, under the placeholder name and without a time. Lines are
    summed per file and commit before any join, so an initial import that owns a third of all
    lines arrives as one row per file.
    """
    by = list(by)
    lines = blame_lines
    if revision is not None and "revision" in blame_lines.columns:
        lines = lines.filter(F.col("revision") == revision)
    owned = lines.groupBy(*by, "filepath", "commit_id").agg(F.sum("lines_count").alias("lines_count"))
    if files is not None:
        if revision is not None and "revision" in files.columns:
            files = files.filter(F.col("revision") == revision)
        text_files = files.filter(~F.col("is_binary")).select(*by, F.col("file").alias("filepath"))
        owned = owned.join(text_files, [*by, "filepath"], "left_semi")
    if submodules is not None:
        paths = submodules.select(*by, F.col("path").alias("filepath"))
        owned = owned.join(paths, [*by, "filepath"], "left_anti")
    # git drops a signature whose name or e-mail is empty
    has_committer = F.coalesce((F.trim("committer_email") != "") & (F.trim("committer_name") != ""), F.lit(False))

    def either(kind):
        return F.when(has_committer, F.col(f"committer_{kind}")).otherwise(F.col(f"author_{kind}"))

    people = raw_commits.select(
        *by,
        "commit_id",
        either("name").alias("committer_name"),
        either("email").alias("committer_email"),
        either("timestamp").alias("timestamp"),
    )
    if mailmap is not None:
        people = resolve_identities(people, mailmap, "committer_name", "committer_email", by)
    return (
        owned.join(people, [*by, "commit_id"], "left")
        .groupBy(*by, "filepath", F.coalesce("committer_name", F.lit(S.EMPTY_NAME)).alias("committer_name"), "timestamp")
        .agg(F.sum("lines_count").alias("lines_count"))
    )


def without_submodules(files: DataFrame, submodules: DataFrame, by=()) -> DataFrame:
    """File listing without submodule paths."""
    paths = submodules.select(*by, F.col("path").alias("file"))
    return files.join(paths, [*by, "file"], "left_anti")


def commits_count(commits: DataFrame, by=()) -> DataFrame:
    return commits.groupBy(*by).agg(F.count(F.lit(1)).alias("commits_count"))
