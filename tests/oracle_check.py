"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names and an order-insensitive multiset of rows
(floats rounded to 6 decimals).
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import threading
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

ORACLE_SECONDS = 60

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir, names=None, verbose=True, plans=None):
    """Results by query; ``plans``, if given, takes the executed plan of each."""
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            if plans is not None:
                plans[name] = df._jdf.queryExecution().executedPlan().toString()
            srows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # report and continue
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in orc:
            results[name] = f"rows-only {len(srows)}"
            if verbose:
                print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        limit = threading.Timer(ORACLE_SECONDS, con.interrupt)  # one endless oracle must not cost the others
        limit.start()
        try:
            cur = con.execute(orc[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as exc:
            results[name] = f"DUCKDB ERROR {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        finally:
            limit.cancel()
        if sorted(cols) != sorted(dcols):
            results[name] = f"COLUMNS {sorted(cols)} vs {sorted(dcols)}"
        elif len(srows) != len(drows):
            results[name] = f"ROWCOUNT {len(srows)} vs {len(drows)}"
        else:
            a, b = rows_key(cols, srows), rows_key(dcols, drows)
            if a == b:
                results[name] = f"OK {len(srows)}"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                results[name] = f"VALUES differ e.g. {diff}"
        if verbose:
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from traceframe.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    res = check(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
