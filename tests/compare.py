"""Rows of a query and of its SQL, brought to one form."""

import datetime
import decimal
import math
from pathlib import Path


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows_of_sql(con, sql):
    c = con.execute(sql)
    names = [x[0] for x in c.description]
    cols = sorted(names)
    return cols, sorted((tuple(norm(r[names.index(n)]) for n in cols) for r in c.fetchall()), key=key)
