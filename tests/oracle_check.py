"""Compare registered queries with their DuckDB oracle: python tests/oracle_check.py [names..]."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if math.isinf(v) else round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    if hasattr(v, "asDict"):
        return str(v.asDict())
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _shape(v):
    return "null" if v is None else "float" if isinstance(v, float) or hasattr(v, "as_tuple") else type(v).__name__


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    kinds = [{_shape(r[i]) for r in rows} - {"null"} for i in order]
    return [columns[i] for i in order], sorted(out, key=repr), kinds


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(got[1])} (no oracle)", True
    cur = con.execute(sql)
    want = normalise([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", False
    if got[1] != want[1]:
        left, right = set(map(repr, got[1])), set(map(repr, want[1]))
        return (f"rows {len(got[1])} vs {len(want[1])}\n   spark {sorted(left - right)[:3]}\n   duck  {sorted(right - left)[:3]}", False)
    if got[2] != want[2]:
        return f"types {list(zip(got[0], got[2], want[2]))}", False
    return f"rows={len(got[1])}", len(got[1]) > 0


def main(names, sf_dir):
    import __spark_entry__ as entry
    from veritab.session import local_session
    spark = local_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            note, ok = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on to the next query
            note, ok = f"{type(exc).__name__}: {str(exc)[:700]}", False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")))
