"""Compare a query with its SQL on the same tables."""

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)


def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(found.columns), found.fetchall())
