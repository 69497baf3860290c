"""What several test modules share; no conftest, as each folder may have one of its own."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
