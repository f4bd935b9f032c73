"""Comparison of Spark rows with DuckDB rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(r[n]) for n in names) for r in df.collect())


def sql_rows(c, sql):
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(str(x[i]) for i in order) for x in r.fetchall())
