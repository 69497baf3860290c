"""History tables kept as Parquet, JSON, ORC or CSV, always with the declared schema."""

from pyspark.sql import DataFrame, SparkSession

from annalist.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, format: str = "parquet", **options) -> DataFrame:
    """One of the tables of :mod:`annalist.schemas`."""
    return spark.read.format(format).schema(TABLES[name]).options(**options).load(path)


def of_revision(df: DataFrame, revision: str = "HEAD") -> DataFrame:
    """Rows of one revision of a files or blame table; a partition filter when the table
    is partitioned by revision."""
    return df.filter(df["revision"] == revision)
