"""Token counts kept up to date by signed changes instead of recounting the corpus.

A change is a row with the group it belongs to, a signed number of documents and a signed
number of tokens. A batch of changes is summed by group and stored under its id; totals are
the sums over all batches. As everything is additive, batches may come in any order.
"""

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer_version")


def inserts(counted: DataFrame, tokens="tokens") -> DataFrame:
    """Changes of documents that come in; a NULL count is 0."""
    return counted.select(*GROUP, F.lit(1).cast("bigint").alias("documents"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))


def deletes(counted: DataFrame, tokens="tokens") -> DataFrame:
    """Changes of documents that go, with the count they came in with."""
    return inserts(counted, tokens).select(*GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(counted: DataFrame, old="old_tokens", new="new_tokens") -> DataFrame:
    """Changes of documents that stay and are counted anew."""
    change = F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0))
    return counted.select(*GROUP, F.lit(0).cast("bigint").alias("documents"), change.cast("bigint").alias("tokens"))


class Rollup:
    """Totals by ``GROUP`` in a folder that all executors share, one sub-folder for each batch.

    NULL sources, languages and versions are groups like others. Each row of a batch counts,
    so repeated rows count repeatedly; a batch may be empty. Changes are summed within tasks
    before they are shuffled, so a source with most documents costs no more than others.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Stores a batch, idempotently: nothing is done for a batch that is already committed.

        So a replay that fails takes nothing away. Sums are written beside the batches under a
        name that readers skip, and renamed when complete: a commit that failed midway is not
        counted, and of two writers of one id the first to rename wins. The folder must be in a
        file system that renames at once. A corrected batch needs an id of its own.
        """
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r} may hold letters, digits, '.' and '-' only")
        target = f"{self.folder}/batch_id={batch_id}"
        if target in self._committed():
            return
        sums = changes.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        name = f"_attempt-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{name}")
        files, path = self._files()
        attempt, goal = path(f"{self.folder}/{name}"), path(target)
        if files.exists(goal) and target not in self._committed():
            files.delete(goal, True)  # left by a copy that broke off
        if target in self._committed() or not files.rename(attempt, goal):
            files.delete(attempt, True)
        # a rename onto a folder that has appeared meanwhile moves into it
        files.delete(path(f"{target}/{name}"), True)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _committed(self) -> list[str]:
        """Folders of complete batches, which have Spark's mark of success."""
        files, path = self._files()
        if not files.exists(path(self.folder)):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path(self.folder))]
        found = [f"{self.folder}/{n}" for n in names if n.startswith("batch_id=")]
        return [f for f in found if files.exists(path(f"{f}/_SUCCESS"))]

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_docs, n_tokens``; groups that nothing is left of
        are absent, so there are no rows before the first batch. Incomplete batches do not count."""
        schema = "source string, lang string, tokenizer_version string, documents bigint, tokens bigint"
        batches = self._committed()
        deltas = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        sums = deltas.groupBy(*GROUP).agg(F.sum("documents").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")
