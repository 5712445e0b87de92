"""Spark-vs-DuckDB comparison, the same shape as the driver's correctness gate:
row count, column names (sorted) and an order-insensitive value comparison.

Run ``python tests/oracle_harness.py [sf_dir] [name ...]`` for a report.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from weft.session import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


_SPARK_KIND = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64",
               "float": "float32", "string": "string", "boolean": "bool"}
_DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8", "DOUBLE": "float64",
              "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "HUGEINT": "int128", "UBIGINT": "uint64"}


def _kind(t: str, table: dict) -> str:
    t = str(t)
    for k, v in table.items():
        if t == k:
            return v
    if t.startswith("array<") or t.endswith("[]"):
        inner = t[6:-1] if t.startswith("array<") else t[:-2]
        return "list<" + _kind(inner, table) + ">"
    if t.startswith("decimal") or t.startswith("DECIMAL"):
        return "decimal"
    return t


def type_diffs(sdf, cur) -> list:
    """Columns whose Spark and DuckDB types differ (after name sorting)."""
    st = {f.name: _kind(f.dataType.simpleString(), _SPARK_KIND) for f in sdf.schema.fields}
    dt = {d[0]: _kind(d[1], _DUCK_KIND) for d in cur.description}
    return [(c, st[c], dt.get(c)) for c in sorted(st) if st[c] != dt.get(c)]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    res["type_diffs"] = type_diffs(sdf, cur)
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return res
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["status"] = f"VALUES {diff}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from weft.plans import registry
    from weft.session import local_session
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, oracle = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(qs)} queries, {bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
