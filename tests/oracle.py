"""Runs a query beside its SQL on the same files and compares the rows as multisets."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(norm, value))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(norm(row[n]) for n in names) for row in df.collect())


def duck_rows(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(norm(row[k]) for k in order) for row in found.fetchall())
