"""Comparison of a query's rows with DuckDB's over the same tables."""

import os

import duckdb

DATA = "/root/testdata"


def plain(value):
    """Value that compares equal between the two engines."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    """Rows with columns by name, sorted."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def both(spark, query, sql, sf="sf0.001"):
    """(columns, rows) of the query and of its twin."""
    folder = f"{DATA}/{sf}"
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    found = db.execute(sql)
    return rows_of(df.columns, df.collect()), rows_of([c[0] for c in found.description], found.fetchall())
