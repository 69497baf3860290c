"""Cutting the plan of iterative jobs by written tables, which one owner can delete."""

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode with the setting absent (tests) a folder of this process is used;
    the session's settings are never changed. What a cluster names is taken to be shared,
    also a ``file:`` folder, which may be a mount that all hosts have.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return _folder_of_process()
    return folder.rstrip("/")


_made = []


def _folder_of_process() -> str:
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="annalist-"))
    return _made[0]


class Scratch:
    """Owner of the tables that one job writes to the shared folder.

    ``keep`` writes a table and reads it back. Unlike ``DataFrame.checkpoint`` this computes
    the rows once, and the files tell the planner their size, so small rounds are broadcast.
    A lost executor costs a re-read. ``drop`` deletes one table when no later step needs it;
    ``release`` deletes all. What a job returns may still read its last tables, so the
    caller releases them after using the result. As a context manager it releases at the end.
    """

    def __init__(self, spark):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/annalist-{uuid.uuid4().hex}"
        self.paths = {}
        self.appended = {}

    def counted(self, df: DataFrame) -> tuple:
        """The table read back, and its number of rows."""
        path = f"{self.folder}/{len(self.paths)}"
        written = Observation()
        df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table, written.get["rows"]

    def keep(self, df: DataFrame) -> DataFrame:
        return self.counted(df)[0]

    def append(self, name: str, df: DataFrame) -> tuple:
        """Adds rows to the table ``name``; the whole table and the added rows, both read back."""
        parts = f"{self.folder}/{name}"
        number = self.appended[name] = self.appended.get(name, 0) + 1
        df.write.parquet(f"{parts}/part={number}")
        read = self.spark.read.schema(df.schema)
        return read.option("recursiveFileLookup", True).parquet(parts), read.parquet(f"{parts}/part={number}")

    def drop(self, table: DataFrame) -> None:
        for path, kept in self.paths.items():
            if kept is table:
                self._delete(path)

    def release(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()
