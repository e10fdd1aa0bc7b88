"""Comparison of a Spark result with DuckDB's on the same tables."""

import datetime
import decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = connection.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(v[i]) for i in order] for v in values), key=repr)


def assert_same(df, sf_dir, sql):
    names, values = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, values)
