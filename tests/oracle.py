"""Compare a query with its SQL on the driver's tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


def assert_same(frame, relation):
    assert sorted(frame.columns) == sorted(relation.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(relation.columns, relation.fetchall())
