"""Runs a catalogued query and its checking SQL side by side."""

import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def rows_of(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    ours = rows_of(tuple(r[c] for c in columns) for r in df.collect())
    theirs = rows_of(con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql})").fetchall())
    return ours, theirs
