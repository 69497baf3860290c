"""Readers of the text exports that ``tools/export_history.sh`` makes with stock git.

Every line is a record of its own, so the files split and no record grows with a commit.
``parse_*`` take lines as a DataFrame ``(repo_id, value)``, from wherever they come; ``read_*``
read them from text files. A path may name many repositories (``exports/*/log.txt``); the
folder names the repository unless ``repo_id`` is given.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


#: git's escapes in quoted paths, letters for some control characters, octal for others
ESCAPES = [('\\"', '"'), ("\\a", "\a"), ("\\b", "\b"), ("\\t", "\t"), ("\\n", "\n"), ("\\v", "\v"), ("\\f", "\f"), ("\\r", "\r")]
ESCAPES += [(f"\\{code:03o}", chr(code)) for code in (*range(1, 32), 127)]


class CommitLog(NamedTuple):
    commits: DataFrame
    parents: DataFrame
    commit_files: DataFrame
    file_changes: DataFrame


class Tree(NamedTuple):
    files: DataFrame
    submodules: DataFrame


def read_lines(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """``repo_id, value`` for every line of text files."""
    text = spark.read.option("lineSep", "\n").text(path)
    # the path is URI-encoded, where a plus sign stands for itself
    folder = F.element_at(F.split(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")), "/"), -2)
    return text.select((F.lit(repo_id) if repo_id is not None else F.url_decode(folder)).alias("repo_id"), "value")


def _split(lines):
    return lines.select("repo_id", "value", F.split("value", SEPARATOR, -1).alias("part"))


def _part(index, kind="string"):
    return F.col("part").getItem(index).try_cast(kind)


def _text(value):
    return F.nullif(value, F.lit(""))


def unquoted_path(path):
    """Undo git's quoting of paths with quotes, backslashes or control characters."""
    backslash = "\x00"  # no path holds it
    inner = F.replace(F.substr(path, F.lit(2), F.length(path) - 2), F.lit("\\\\"), F.lit(backslash))
    for escaped, plain in (*ESCAPES, (backslash, "\\")):
        inner = F.replace(inner, F.lit(escaped), F.lit(plain))
    return F.when(path.startswith('"') & path.endswith('"') & (F.length(path) > 1), inner).otherwise(path)


def _minutes(offset):
    size = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")
    return F.when(offset.startswith("-"), -size).otherwise(size)


def read_commit_log(spark: SparkSession, path: str, repo_id: str | None = None) -> CommitLog:
    """``parse_commit_log`` of ``log.txt``."""
    return parse_commit_log(read_lines(spark, path, repo_id))


def parse_commit_log(lines: DataFrame) -> CommitLog:
    """Commits, parents, changed files and created or removed files."""
    lines = _split(lines)

    def tagged(tag):
        return lines.filter(F.col("value").startswith(tag + SEPARATOR))

    heads = tagged("C")
    commits = heads.select(
        "repo_id",
        _part(2).alias("commit_id"),
        _part(1, "long").alias("walk_pos"),
        _part(4).alias("author_name"),
        _part(5).alias("author_email"),
        _part(6, "long").alias("author_timestamp"),
        _minutes(_part(7)).alias("author_tz_offset"),
        _part(8).alias("committer_name"),
        _part(9).alias("committer_email"),
        _part(10, "long").alias("committer_timestamp"),
    )
    # a root commit has an empty parent field, which still splits into one element
    parents = (
        heads.select("repo_id", _part(2).alias("commit_id"), F.posexplode(F.split(_part(3), " ")))
        .filter(F.col("col") != "")
        .select("repo_id", "commit_id", F.col("col").alias("parent_id"), F.col("pos").alias("ordinal"))
    )
    commit_files = tagged("F").select(
        "repo_id",
        _part(1).alias("commit_id"),
        unquoted_path(_part(4)).alias("path"),
        _part(2, "long").alias("insertions"),
        _part(3, "long").alias("deletions"),
    )
    file_changes = tagged("X").select(
        "repo_id", _part(1).alias("commit_id"), unquoted_path(_part(3)).alias("path"), _part(2, "int").alias("change")
    )
    return CommitLog(commits, parents, commit_files, file_changes)


def read_tree(spark: SparkSession, path: str, repo_id: str | None = None) -> Tree:
    """``parse_tree`` of ``tree.txt``."""
    return parse_tree(read_lines(spark, path, repo_id))


def parse_tree(lines: DataFrame) -> Tree:
    """File listing (submodules left out) and submodule paths."""
    lines = _split(lines)
    entries = lines.filter(F.col("value").startswith("T" + SEPARATOR)).select(
        "repo_id",
        _part(1).alias("revision"),
        unquoted_path(_part(4)).alias("file"),
        _part(2).alias("kind"),
        _part(3, "long").alias("size_bytes"),
    )
    counts = lines.filter(F.col("value").startswith("N" + SEPARATOR)).select(
        "repo_id", _part(1).alias("revision"), unquoted_path(_part(3)).alias("file"), _part(2).alias("_lines")
    )
    files = (
        entries.filter(F.col("kind") == "blob")
        .join(counts, ["repo_id", "revision", "file"], "left")
        .select(
            "repo_id",
            "revision",
            "file",
            F.coalesce(F.col("_lines") == "-", F.lit(False)).alias("is_binary"),
            F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
            F.coalesce(F.col("_lines").try_cast("long"), F.lit(0)).alias("lines_count"),
        )
    )
    submodules = entries.filter(F.col("kind") == "commit").select("repo_id", "revision", F.col("file").alias("path"))
    return Tree(files, submodules)


def read_blame(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """``parse_blame`` of ``blame.txt``."""
    return parse_blame(read_lines(spark, path, repo_id))


def parse_blame(lines: DataFrame) -> DataFrame:
    """Runs of lines with the commit that last changed them."""
    return _split(lines).select(
        "repo_id",
        _part(0).alias("revision"),
        unquoted_path(_part(1)).alias("filepath"),
        _part(2).alias("commit_id"),
        _part(3, "long").alias("lines_count"),
    )


def read_tag_refs(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """``parse_tag_refs`` of ``refs.txt``."""
    return parse_tag_refs(read_lines(spark, path, repo_id))


def parse_tag_refs(lines: DataFrame) -> DataFrame:
    """Tag references. Annotated tags bring name, tagger and time; lightweight ones their
    reference name only. Other references are left out."""
    annotated = _part(2) == "tag"
    name = F.substr(_part(1), F.lit(len("refs/tags/") + 1))
    return (
        _split(lines)
        .filter(_part(1).startswith("refs/tags/"))
        .select(
            "repo_id",
            F.when(annotated, _part(4)).otherwise(_part(3)).alias("commit_id"),
            F.when(annotated, F.coalesce(_text(_part(5)), name)).otherwise(name).alias("tag_name"),
            F.when(annotated, _text(_part(6))).alias("tagger_name"),
            F.when(annotated, F.regexp_replace(_part(7), "^<|>$", "")).alias("tagger_email"),
            F.when(annotated, _part(8, "long")).alias("tagger_time"),
            _part(0, "long").alias("ref_order"),
        )
    )


def read_mailmap(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """``parse_mailmap`` of a mailmap file; rules come in the order of its lines."""
    lines = read_lines(spark, path, repo_id)
    return parse_mailmap(lines.withColumn("rule_order", F.monotonically_increasing_id()))


def parse_mailmap(lines: DataFrame) -> DataFrame:
    """Mailmap rules ``(repo_id, value, rule_order)`` in their four line forms::

        Proper Name <commit@email>
        <proper@email> <commit@email>
        Proper Name <proper@email> <commit@email>
        Proper Name <proper@email> Commit Name <commit@email>
    """
    form = r"^\s*([^<]*?)\s*<([^>]*)>\s*(?:([^<]*?)\s*<([^>]*)>)?"

    def group(index):
        return F.regexp_extract("value", form, index)

    two = group(4) != ""
    return (
        lines.filter(~F.ltrim("value").startswith("#") & F.col("value").rlike(form))
        .select(
            "repo_id",
            _text(group(1)).alias("canonical_name"),
            F.when(two, _text(group(2))).alias("canonical_email"),
            F.when(two, _text(group(3))).alias("match_name"),
            F.when(two, group(4)).otherwise(group(2)).alias("match_email"),
            "rule_order",
        )
    )
