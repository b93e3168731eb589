"""Comparison of a query with its SQL on the driver tables."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{DATA}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return plain(float(value)) if type(value).__name__ == "Decimal" else value


def same_rows(df, sql, connection):
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = connection.execute(sql)
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == names
    theirs = sorted((tuple(plain(r[at[n]]) for n in names) for r in cursor.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
