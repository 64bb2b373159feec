"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import datetime
import decimal
import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)) and not hasattr(v, "_fields"):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
