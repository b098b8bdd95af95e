"""Compare a query with its SQL the way the driver does: names, row counts and values whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    order = sorted(names)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    right = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    for a, b in zip(left, right):
        assert a == b, (name, order, a, b)
    assert len(left) == len(right), (name, len(left), len(right))
    return len(left)
