"""Run a query in Spark and its SQL in DuckDB and compare columns, row counts and values."""
from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {"bigint": "long", "integer": "int", "varchar": "string", "double": "double", "boolean": "boolean",
          "timestamp": "timestamp", "date": "date"}


def compare(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """Differences in words; empty when both agree."""
    df = query(spark, sf_dir)
    left = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: _KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cur.description}
    right = cur.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for f in df.schema:
        mine = {"bigint": "long", "timestamp_ntz": "timestamp"}.get(f.dataType.simpleString(), f.dataType.simpleString())
        if mine != kinds[f.name]:
            out.append(f"type of {f.name}: {mine} != {kinds[f.name]}")
    a, b = _rows(left, df.columns), _rows(right, names)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [r for r in a if r not in in_b][:2], [r for r in b if r not in in_a][:2]
        out.append(f"values differ\n   spark {str(only_a)[:700]}\n   sql   {str(only_b)[:700]}")
    return out
