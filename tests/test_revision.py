from datetime import datetime

from helpers import rows
from pyspark.sql import functions as F
from samples import blame, files

from annalist.functions.scalars import epoch_seconds
from annalist.operators import revision


def test_contribution_and_files(spark):
    assert sorted(rows(revision.contribution(blame(spark)))) == [("Author1", 4), ("Author2", 2), ("Author3", 4)]
    assert rows(revision.top_files(blame(spark), 2)) == [("file1.txt", 2, 1), ("file2.txt", 1, 2)]
    assert sorted(rows(revision.monoauthor_files(blame(spark)), "filepath")) == [("file2.txt",), ("file3.txt",)]
    estimated = revision.committers_per_file(blame(spark), approximate=True)
    assert sorted(rows(estimated)) == sorted(rows(revision.committers_per_file(blame(spark))))


def test_contribution_folds_only_beyond_one_more(spark):
    assert rows(revision.contribution_with_others(blame(spark), 2), "committer_name") == [
        ("Author1",),
        ("Author3",),
        ("Author2",),
    ]
    assert rows(revision.contribution_with_others(blame(spark), 1)) == [
        (1, "Author1", False, 4),
        (None, "Others", True, 6),
    ]


def test_knowledge_boundary_is_known(spark):
    now = datetime(2024, 8, 31, 12)
    edge = epoch_seconds(datetime(2024, 2, 29, 12))
    lines = blame(spark, [("a", 1, edge - 1, "f"), ("b", 2, edge, "f"), ("c", 4, edge + 9, "f")])
    assert rows(revision.lost_knowledge(lines, now)) == [(1, 7, 1 / 7)]
    assert rows(revision.knowledge_carriers(lines, now)) == [("c", 4), ("b", 2)]
    assert rows(revision.knowledge_carriers(lines, now, top=1)) == [("c", 4)]
    assert rows(revision.lost_knowledge(lines.filter("false"), now)) == [(0, 0, None)]


def test_extensions(spark):
    assert rows(revision.file_totals(files(spark))) == [(4, 29, 7.25)]
    assert rows(revision.extensions(files(spark)), "extension", "size_bytes", "lines_count", "files_count") == [
        ("txt", 17, 5, 2),
        ("dat", 4, 2, 1),
        ("log", 8, 3, 1),
    ]


def test_orphaned_extensions_fold_into_one_last_row(spark):
    folded = revision.extensions_folded(files(spark), 1)
    assert rows(folded, "extension", "is_others", "size_bytes", "lines_count", "files_count", "extensions_count") == [
        ("txt", False, 17, 5, 2, 1),
        ("~others~", True, 12, 5, 2, 2),
    ]
    assert revision.extensions_folded(files(spark), 0).filter("is_others").count() == 0


def test_extension_shares(spark):
    lines = spark.range(1).select(F.lit(20).alias("total_lines_count"))
    binary = files(spark).withColumn("is_binary", F.col("file").endswith(".dat"))
    shares = revision.extension_shares(revision.extensions(binary), binary, lines).orderBy("extension")
    assert rows(shares, "extension", "files_percent", "lines_percent", "lines_per_file") == [
        ("dat", 25.0, None, None),
        ("log", 25.0, 15.0, 3.0),
        ("txt", 50.0, 25.0, 2.5),
    ]
