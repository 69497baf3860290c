"""Run queries in Spark and DuckDB side by side and compare them value by value."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def difference(df, con, statement):
    """None when equal, else a short description."""
    relation = con.execute(statement)
    oracle_names = [d[0] for d in relation.description]
    if sorted(df.columns) != sorted(oracle_names):
        return f"columns {sorted(df.columns)} / {sorted(oracle_names)}"
    expected = _sorted_rows(oracle_names, relation.fetchall())
    found = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows / {len(expected)}"
    for left, right in zip(found, expected):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"{left} / {right}"
    return None
