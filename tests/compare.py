"""Results of a query and of its SQL, in a form that can be compared."""

import os

import duckdb
import numpy as np

ROOT = "/root/testdata"


def tables(connection, folder):
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "~"
    if isinstance(value, (float, np.floating)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 9))
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def same(query, sql, spark, folder):
    connection = duckdb.connect()
    tables(connection, folder)
    assert rows(query(spark, folder).toPandas()) == rows(connection.sql(sql).df())
