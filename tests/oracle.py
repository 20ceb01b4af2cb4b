"""Compares a query with its SQL, as sets of rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9))
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


def wanted(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


def check(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == wanted(sql, sf_dir)
