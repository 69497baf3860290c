"""From a folder of exports to the input tables of a report, and keeping these tables."""

from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from annalist.operators import commits as extract
from annalist.operators import tags
from annalist.operators.identity import resolve_identities
from annalist.plans.report import History
from annalist.schemas import TABLES
from annalist.sources import exports, tables

BY = ("repo_id",)


def history_from_exports(
    spark: SparkSession, root: str, revision: str = "HEAD", with_blame: bool = True, with_tags: bool = True
) -> History:
    """Histories of all repositories exported below ``root`` (``root/<repo_id>/log.txt`` ...).

    The tables are lazy: every use parses and joins the exports again. Keep them with
    :func:`store_history` before computing more than one statistic.
    """
    log = exports.read_commit_log(spark, f"{root}/*/log.txt")
    mailmap = exports.read_mailmap(spark, f"{root}/*/mailmap.txt")
    tree = exports.read_tree(spark, f"{root}/*/tree.txt")
    commits = extract.whole_history(log.commits, log.parents, log.commit_files, mailmap, BY)
    heads = log.commits.filter(F.col("walk_pos") == 0).select(*BY, "commit_id")
    linear = extract.linear_history(
        log.commits, log.parents, log.commit_files, heads, file_changes=log.file_changes, by=BY
    )
    files = tables.of_revision(tree.files, revision)
    blame = assigned = None
    if with_blame:
        blame = extract.blame(
            exports.read_blame(spark, f"{root}/*/blame.txt"),
            log.commits,
            files=tree.files,
            submodules=tables.of_revision(tree.submodules, revision),
            mailmap=mailmap,
            revision=revision,
            by=BY,
        ).withColumn("revision", F.lit(revision))
    if with_tags:
        refs = exports.read_tag_refs(spark, f"{root}/*/refs.txt")
        annotated = refs.filter(F.col("tagger_time").isNotNull())
        named = resolve_identities(annotated, mailmap, "tagger_name", "tagger_email", BY)
        refs = named.unionByName(refs.filter(F.col("tagger_time").isNull()))
        assigned = tags.assign_tags(commits, refs, BY)
    return History(commits, linear, files, blame, assigned, BY)


def store_history(history: History, path: str, format: str = "parquet", mode: str = "errorifexists") -> History:
    """Write the tables of a history below ``path``, each once, and return them as stored."""
    spark = history.commits.sparkSession
    for name in _table_names(history):
        table = getattr(history, name)
        table.select(*[c for c in TABLES[name].names if c in table.columns]).write.format(format).mode(mode).save(
            f"{path}/{name}"
        )
    return stored_history(spark, path, format, _table_names(history), history.by)


def stored_history(
    spark: SparkSession, path: str, format: str = "parquet", names=("commits", "linear_history", "files"), by=BY
) -> History:
    """A history kept by :func:`store_history`; name ``blame`` and ``assigned_tags`` to have them."""
    return History(by=by, **{name: tables.read_table(spark, name, f"{path}/{name}", format) for name in names})


def _table_names(history):
    return tuple(f.name for f in fields(History) if f.name in TABLES and getattr(history, f.name) is not None)
