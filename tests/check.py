"""Compare registered queries with their SQL in DuckDB: ``python tests/check.py [sf] [name-prefix ...]``."""

import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

STRICT = bool(os.environ.get("CHECK_STRICT"))
ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 6)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, build, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        only = [r for r in got if r not in set(map(lambda x: x, want))][:2] if len(got) < 50000 else []
        miss = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"{len(got)} vs {len(want)} rows; spark only {str(only)[:700]}; sql only {str(miss)[:700]}", len(got)
    return None, len(got)


def main():
    from scriptorium.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, build, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:34s} rows={n:<7d} {time.time() - start:5.1f}s {'' if name in oracles else '(rows only) '}"
              f"{problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
