"""Runs registered queries against DuckDB on the same tables and compares rows, columns and values."""

import glob
import math
import os
import sys
import time

import duckdb

TESTDATA = os.environ.get("LOREKEEP_TESTDATA", "/root/testdata")


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def compare(got, expected):
    """None when equal, else a short description. Both: (columns, rows)."""
    gc, gr = got
    ec, er = expected
    if sorted(gc) != sorted(ec):
        return f"columns {sorted(gc)} != {sorted(ec)}"
    go, eo = [gc.index(c) for c in sorted(gc)], [ec.index(c) for c in sorted(ec)]
    a = sorted(tuple(plain(r[i]) for i in go) for r in gr)
    b = sorted(tuple(plain(r[i]) for i in eo) for r in er)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:3]
        return f"rows {len(a)} != {len(b)}; only in result: {extra}; only in oracle: {[x for x in b if x not in set(a)][:3]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}" if diff else None


def main(names, sf):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lorekeep.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{TESTDATA}/sf{sf}"
    con = connect(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name:28} {took:6.1f}s rows={len(rows)} (no oracle)", rows[:1] if names else "", flush=True)
                continue
            start = time.time()
            cur = con.execute(sql)
            expected = ([d[0] for d in cur.description], cur.fetchall())
            problem = compare((df.columns, rows), expected)
            bad += problem is not None
            print(f"{name:28} {took:6.1f}s duck={time.time() - start:5.1f}s rows={len(rows)} {'OK' if problem is None else 'DIFF ' + problem[:1500]}", flush=True)
        except Exception as exc:
            bad += 1
            print(f"{name:28} ERROR {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main([a for a in sys.argv[2:]], sys.argv[1])
