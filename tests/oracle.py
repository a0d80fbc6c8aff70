"""Spark rows against DuckDB rows, columns by name, order left out."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if type(v).__name__ == "Decimal":
        return round(float(v), 9) + 0.0
    return repr(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def same_number(row):
    return tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)


def compare(spark_df, con, sql):
    """None if both give the same rows, else what differs."""
    columns = sorted(spark_df.columns)
    ours = Counter(same_number(map(plain, r)) for r in spark_df.select(*columns).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(same_number(plain(r[i]) for i in order) for r in result.fetchall())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]} ({columns})"
