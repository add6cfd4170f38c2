"""Holds a query against its SQL in DuckDB: rows as sorted lists of rounded values."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:3], [x for x in want[1] if x not in got[1]][:3])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, (len(bad), bad[0])
    return len(got[1])
