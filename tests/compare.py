"""Compares rows of Spark and DuckDB regardless of order."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _value(x):
    if isinstance(x, float):
        return "NULL" if x != x else repr(float(f"{x:.12g}") + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_value, x)) + "]"
    return "NULL" if x is None else str(x)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def same(df, connection, sql):
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want = normal([x[0] for x in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
