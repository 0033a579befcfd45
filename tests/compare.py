"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(df, con, sql):
    """(ok, message) over names, counts and values."""
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return False, f"columns {gcols} != {wcols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [{type(x).__name__ for r in got for x in (r[i],) if x is not None} ^ {type(x).__name__ for r in want for x in (r[i],) if x is not None} for i in range(len(gcols))]
    mixed = [c for c, t in zip(gcols, types) if t]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}"
    return True, f"{len(got)} rows" + (f" TYPES {mixed}" if mixed else "")


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from tidemark.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark, con = local_session(), duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            ok, msg = compare(df, con, sqls[name]) if name in sqls else (True, f"rows only {df.count()}")
        except Exception as ex:
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed", failed)
