"""Compare registered queries with their SQL on DuckDB: python tests/check.py [sf] [name-part ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0) if v != v.to_integral_value() else str(int(v))
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def num(s):
    return s[:-2] if s.endswith(".0") else s


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(num(norm(r[i])) for i in order) for r in rows)


def compare(df, con, sql):
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    a, b = rows_of(got, df.columns), rows_of(want, rel.columns)
    if a == b:
        return "", len(got)
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; spark only {sorted(sa - sb)[:3]}; sql only {sorted(sb - sa)[:3]}", len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from beatloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(d)
    q, o = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in q.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in o:
                err, n = compare(fn(spark, d), con, o[name])
            else:
                n, err = fn(spark, d).count(), ""
        except Exception as e:  # report and go on
            err, n = f"{type(e).__name__}: {str(e).splitlines()[0][:400]}", -1
        print(f"{'ok  ' if not err else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {'sql' if name in o else 'rows'} {err[:700]}", flush=True)
        if err:
            bad.append(name)
    print("failed:", bad)
