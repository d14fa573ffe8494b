"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(v) if v.as_tuple().exponent < 0 else int(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got, got_names = rows_of(df.collect(), df.columns)
    cursor = con.execute(sql)
    want, want_names = rows_of(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got_names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
