"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    names = sorted(frame)
    return names, sorted(zip(*[[norm(v) for v in frame[n]] for n in names]), key=repr)


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return v
    return v


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, query, sql):
    t0 = time.time()
    got = query(spark, sf).toArrow().to_pydict()
    t1 = time.time()
    want = con.sql(sql).to_arrow_table().to_pydict()
    t2 = time.time()
    a, b = rows_of(got), rows_of(want)
    return a, b, t1 - t0, t2 - t1


if __name__ == "__main__":
    import __spark_entry__ as entry
    from kurzwerk.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sorted(queries):
        if name not in oracles:
            t0 = time.time()
            n = queries[name](spark, sf).count()
            print(f"{name:32s} rows-only {n} {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            a, b, ts, td = compare(spark, con, sf, queries[name], oracles[name])
        except Exception as exc:
            print(f"{name:32s} ERROR {str(exc)[:1500]}", flush=True)
            continue
        ok = a == b
        print(f"{name:32s} {'ok' if ok else 'DIFF'} rows {len(a[1])}/{len(b[1])} spark {ts:.1f}s duck {td:.1f}s", flush=True)
        if not ok:
            if a[0] != b[0]:
                print("   columns", a[0], b[0])
            else:
                bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
                print("   differing", len(bad), "first:", [str(p)[:600] for p in bad[:1]])
