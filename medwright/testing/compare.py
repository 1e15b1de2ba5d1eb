"""Run a Spark query and its DuckDB oracle on the same parquet tables and compare.

Mirrors the driver's correctness gate: same column names, same row count,
and the same multiset of rows (order-insensitive, values normalised).
"""

from __future__ import annotations

import datetime as dt
import decimal

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_connection(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for t in BASE_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


_SPARK_TYPES = {"int": "int32", "bigint": "int64", "string": "str", "double": "float64", "date": "date",
                "timestamp_ntz": "ts", "timestamp": "ts", "boolean": "bool", "smallint": "int16", "tinyint": "int8",
                "float": "float32"}
_DUCK_TYPES = {"INTEGER": "int32", "BIGINT": "int64", "VARCHAR": "str", "DOUBLE": "float64", "DATE": "date",
               "TIMESTAMP": "ts", "BOOLEAN": "bool", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float32"}


def _spark_type(t) -> str:
    name = t.simpleString()
    return name.replace(" ", "") if name.startswith("decimal") else _SPARK_TYPES.get(name, name)


def _duck_type(t) -> str:
    name = str(t).upper()
    return name.lower().replace(" ", "") if name.startswith("DECIMAL") else _DUCK_TYPES.get(name, name)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_types = {f.name: _spark_type(f.dataType) for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_types = {c[0]: _duck_type(c[1]) for c in cur.description}
    d_rows = cur.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols),
           "types_match": s_types == d_types}
    if not res["types_match"]:
        res["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
        res["match"] = False
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = list(sa - sb)[:3]
        res["only_oracle"] = list(sb - sa)[:3]
    return res
