"""Spark queries against their SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(frame):
    """Rows as sorted tuples of text; doubles to six significant digits."""
    def text(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


def compare(spark, query, sql, sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        at = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"create view {f[:-8]} as select * from '{at}'")
    ours, theirs = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
