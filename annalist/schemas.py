"""Declared schemas of the history tables. Nothing in the library infers a schema.

Every table carries ``repo_id`` so that one job can serve many repositories.
Times are epoch seconds; the library derives calendar values from them by
integer arithmetic, so results do not depend on the session time zone.
"""

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(*columns):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in columns])


#: one row per commit, as exported (names not yet passed through the mailmap)
RAW_COMMITS = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("walk_pos", LongType(), False),
    ("author_name", StringType(), True),
    ("author_email", StringType(), True),
    ("author_timestamp", LongType(), False),
    ("author_tz_offset", IntegerType(), False),
    ("committer_name", StringType(), True),
    ("committer_email", StringType(), True),
    ("committer_timestamp", LongType(), False),
)

#: commit -> ordered parents
PARENTS = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("parent_id", StringType(), False),
    ("ordinal", IntegerType(), False),
)

#: lines changed per file against the first parent (NULL counts = binary file)
COMMIT_FILES = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("path", StringType(), False),
    ("insertions", LongType(), True),
    ("deletions", LongType(), True),
)

#: files created (+1) or removed (-1) against the first parent
FILE_CHANGES = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("path", StringType(), False),
    ("change", IntegerType(), False),
)

#: whole history: the table most statistics read
COMMITS = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("walk_pos", LongType(), False),
    ("is_merge_commit", BooleanType(), False),
    ("author_name", StringType(), False),
    ("author_email", StringType(), True),
    ("author_tz_offset", IntegerType(), False),
    ("author_timestamp", LongType(), False),
    ("review_duration", LongType(), False),
    ("insertions", LongType(), False),
    ("deletions", LongType(), False),
)

#: first-parent history
LINEAR_HISTORY = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("committer_timestamp", LongType(), False),
    ("files_count", LongType(), False),
    ("insertions", LongType(), False),
    ("deletions", LongType(), False),
)

#: runs of lines of one file, each last changed by one commit
BLAME_LINES = _table(
    ("repo_id", StringType(), False),
    ("revision", StringType(), False),
    ("filepath", StringType(), False),
    ("commit_id", StringType(), False),
    ("lines_count", LongType(), False),
)

#: blame joined to the commits that last changed the lines
BLAME = _table(
    ("repo_id", StringType(), False),
    ("revision", StringType(), False),
    ("committer_name", StringType(), False),
    ("lines_count", LongType(), False),
    ("timestamp", LongType(), False),
    ("filepath", StringType(), False),
)

#: entries of a revision's tree
FILES = _table(
    ("repo_id", StringType(), False),
    ("revision", StringType(), False),
    ("file", StringType(), False),
    ("is_binary", BooleanType(), False),
    ("size_bytes", LongType(), False),
    ("lines_count", LongType(), False),
)

#: tag references resolved to the commit they point at
TAG_REFS = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("tag_name", StringType(), False),
    ("tagger_name", StringType(), True),
    ("tagger_time", LongType(), True),
    ("ref_order", LongType(), False),
)

#: commits with the tag they belong to (NULL = unreleased)
ASSIGNED_TAGS = _table(
    ("repo_id", StringType(), False),
    ("commit_id", StringType(), False),
    ("walk_pos", LongType(), False),
    ("tag_name", StringType(), True),
    ("tagger_name", StringType(), True),
    ("tagger_time", LongType(), True),
    ("commit_author", StringType(), False),
    ("commit_time", LongType(), False),
    ("is_merge", BooleanType(), False),
)

#: name corrections; ``match_name`` NULL applies to every name with the e-mail
MAILMAP = _table(
    ("repo_id", StringType(), False),
    ("canonical_name", StringType(), True),
    ("canonical_email", StringType(), True),
    ("match_name", StringType(), True),
    ("match_email", StringType(), False),
    ("rule_order", LongType(), False),
)

TABLES = {
    "raw_commits": RAW_COMMITS,
    "parents": PARENTS,
    "commit_files": COMMIT_FILES,
    "file_changes": FILE_CHANGES,
    "commits": COMMITS,
    "linear_history": LINEAR_HISTORY,
    "blame_lines": BLAME_LINES,
    "blame": BLAME,
    "files": FILES,
    "tag_refs": TAG_REFS,
    "assigned_tags": ASSIGNED_TAGS,
    "mailmap": MAILMAP,
}
