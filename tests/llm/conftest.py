import os

import pytest

SF_DIR = "/root/testdata/sf0.001"

LONG = "Every word of this sentence stands in a longer passage that is repeated. " * 12
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: extra columns named like results and inner columns of the operators
CLASHES = ["n_tokens", "score", "set_id", "text_id", "row", "_key", "_text", "_row", "key", "label", "component_id", "kept", "spans", "start"]

ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, "a"),
    (4, "One short text.", "en", None),
    (4, "One short text.", "en", None),  # a repeated row
    (5, "One short text.", "en", "b"),
    (None, "One short text.", "en", "b"),
    (None, None, None, None),
    (6, LONG, "en", "b"),
    (7, "Other words stand before it. " + LONG + "And after it.", "en", "b"),
    (8, "12 34 !!!", "de", "c"),
    (9, "Grüße über Straßen, naïve cafés, 日本語 😀 it's we'll", "de", "c"),
    (10, "abc " * 40_000, "fr", "c"),
    (11, "a" * 30_000, "fr", "c"),
]


@pytest.fixture(scope="session")
def documents(spark):
    from pyspark.sql import functions as F

    rows = [(*r, len(r[1] or "")) for r in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def scratch(spark):
    from annalist.operators.lineage import Scratch

    with Scratch(spark) as owner:
        yield owner


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR
