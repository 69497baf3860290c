"""Statistics of one revision: who owns its lines, what its files are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import scalars as S
from annalist.operators.grouping import fold_others, leaders, top_rows, with_totals

FOLDED_EXTENSIONS = "~others~"


def _by_lines():
    return [F.desc("lines_count"), F.asc("committer_name")]


def contribution(blame: DataFrame, by=()) -> DataFrame:
    """Lines left by each committer."""
    return blame.groupBy(*by, "committer_name").agg(F.sum("lines_count").alias("lines_count"))


def contribution_with_others(blame: DataFrame, max_authors: int = 10, by=()) -> DataFrame:
    """Largest contributions, the rest added up; a rest of one is shown by name instead."""
    by = list(by)
    summed = contribution(blame, by)
    kept = leaders(summed, by, "committer_name", _by_lines(), max_authors, slack=1)
    return fold_others(summed, kept, by, "committer_name", "lines_count")


def unknown_lines(blame: DataFrame, by=()) -> DataFrame:
    """Lines whose commit is not in the commit log: they have no time."""
    unknown = F.sum(F.when(F.col("timestamp").isNull(), F.col("lines_count")))
    return blame.groupBy(*by).agg(F.coalesce(unknown, F.lit(0)).alias("unknown_lines_count"))


def committers_per_file(blame: DataFrame, by=(), approximate: bool = False) -> DataFrame:
    """Distinct committers of every file; ``approximate`` trades exactness for a sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return blame.groupBy(*by, "filepath").agg(count("committer_name").alias("committers_count"))


def top_files(blame: DataFrame, top: int = 10, by=()) -> DataFrame:
    """Files with most committers."""
    by = list(by)
    counted = committers_per_file(blame, by)
    return top_rows(counted, by, [F.desc("committers_count"), F.asc("filepath")], top).orderBy(*by, "rank")


def monoauthor_files(blame: DataFrame, by=()) -> DataFrame:
    """Files whose lines all come from one committer."""
    return committers_per_file(blame, by).filter(F.col("committers_count") == 1)


def lost_knowledge(blame: DataFrame, as_of, months: int = 6, by=()) -> DataFrame:
    """Share of lines last changed more than ``months`` months before ``as_of`` (0 to 1,
    NULL without lines). Lines without a time, whose commit is unknown, count as forgotten."""
    known = F.coalesce(F.col("timestamp") >= S.months_before(as_of, months), F.lit(False))
    sums = blame.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~known, F.col("lines_count"))), F.lit(0)).alias("forgotten_lines_count"),
        F.coalesce(F.sum("lines_count"), F.lit(0)).alias("total_lines_count"),
    )
    ratio = F.try_divide(F.col("forgotten_lines_count").cast("double"), F.col("total_lines_count").cast("double"))
    return sums.withColumn("lost_knowledge_ratio", ratio)


def knowledge_carriers(
    blame: DataFrame, as_of, months: int = 6, top: int | None = None, by=()
) -> DataFrame:
    """Lines each committer changed within ``months`` months before ``as_of``, most first."""
    by = list(by)
    recent = blame.filter(F.col("timestamp") >= S.months_before(as_of, months))
    summed = contribution(recent, by)
    if top is not None:
        summed = top_rows(summed, by, _by_lines(), top).drop("rank")
    return summed.orderBy(*by, *_by_lines())


def file_totals(files: DataFrame, by=()) -> DataFrame:
    """Number of distinct files, their size and mean size."""
    totals = files.groupBy(*by).agg(
        F.count_distinct("file").alias("files_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
    )
    return totals.withColumn("average_file_size", S.guarded_ratio("size_bytes", "files_count"))


def extensions(files: DataFrame, by=()) -> DataFrame:
    """Bytes, lines and files per (binary, extension), most files first."""
    return (
        files.groupBy(*by, "is_binary", S.file_extension("file").alias("extension"))
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("lines_count").alias("lines_count"),
            F.count(F.lit(1)).alias("files_count"),
        )
        .orderBy(*by, F.desc("files_count"), "is_binary", "extension")
    )


def extensions_folded(files: DataFrame, max_orphans: int = 0, by=()) -> DataFrame:
    """Extension summary with extensions of at most ``max_orphans`` files folded into one
    row, shown last. ``extensions_count`` tells how many extensions a row stands for."""
    by = list(by)
    orphan = F.col("files_count") <= max_orphans
    marked = extensions(files, by).select(
        *by,
        (orphan).alias("is_others"),
        F.when(orphan, F.lit(False)).otherwise(F.col("is_binary")).alias("is_binary"),
        F.when(orphan, F.lit(FOLDED_EXTENSIONS)).otherwise(F.col("extension")).alias("extension"),
        "size_bytes",
        "lines_count",
        "files_count",
    )
    return (
        marked.groupBy(*by, "is_others", "is_binary", "extension")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("lines_count").alias("lines_count"),
            F.sum("files_count").alias("files_count"),
            F.count(F.lit(1)).alias("extensions_count"),
        )
        .orderBy(*by, "is_others", F.desc("files_count"), "is_binary", "extension")
    )


def extension_shares(
    summary: DataFrame, files: DataFrame, line_totals: DataFrame, by=()
) -> DataFrame:
    """Shares of files, bytes and lines per extension. Lines are compared with the net
    lines of the first-parent history (``line_totals``), and only for text files."""
    by = list(by)
    totals = file_totals(files, by).select(
        *by, F.col("files_count").alias("_files"), F.col("size_bytes").alias("_size")
    )
    lines = line_totals.select(*by, F.col("total_lines_count").alias("_lines"))
    attached = with_totals(with_totals(summary, totals, by), lines, by)
    text = ~F.col("is_binary")
    return (
        attached.withColumn("files_percent", S.guarded_percent("files_count", "_files"))
        .withColumn("size_percent", S.guarded_percent("size_bytes", "_size"))
        .withColumn("lines_percent", F.when(text, S.guarded_percent("lines_count", "_lines")))
        .withColumn("lines_per_file", F.when(text, S.guarded_ratio("lines_count", "files_count")))
        .drop("_files", "_size", "_lines")
    )
