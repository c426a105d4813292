"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [slug ...]
Prints one line per query: OK / MISMATCH / ERROR / NO-ORACLE with row counts.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from catalux.session import local_session  # noqa: E402
from catalux.sources.tables import BASE_TABLES  # noqa: E402


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    only = [a for a in args if a != sf_dir]
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    spark = local_session(os.environ.get("ORACLE_CORES", "8"), 8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR     {name}: spark {type(exc).__name__}: {str(exc).splitlines()[0][:300]}")
            if only:
                traceback.print_exc()
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"NO-ORACLE {name}: spark rows={len(s_rows)} ({ts:.1f}s)")
            continue
        try:
            rel = con.execute(oracle[name])
            d_cols = [d[0] for d in rel.description]
            d_rows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR     {name}: duckdb {type(exc).__name__}: {str(exc).splitlines()[0][:300]}")
            continue
        sc, sr = canon(s_cols, s_rows)
        dc, dr = canon(d_cols, d_rows)
        if sc == dc and sr == dr:
            print(f"OK        {name}: rows={len(sr)} ({ts:.1f}s)")
        else:
            bad += 1
            print(f"MISMATCH  {name}: spark rows={len(sr)} cols={sc} | duck rows={len(dr)} cols={dc}")
            if sc == dc:
                ss, ds = set(sr), set(dr)
                for r in list(ss - ds)[:3]:
                    print("   spark only:", str(r)[:400])
                for r in list(ds - ss)[:3]:
                    print("   duck  only:", str(r)[:400])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
