"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0)
                 if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def compare(df, con, sql):
    """(ok, message) for one query."""
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; spark {got[:2]} duck {want[:2]}"
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        return False, f"{len(bad)} of {len(got)} rows differ, first: {diff[:4]} in {str(g)[:300]}"
    types = {c: (type(a).__name__, type(b).__name__) for c, a, b in
             zip(cols, got[0], want[0]) if type(a) is not type(b)} if got else {}
    if types:
        return False, f"types differ: {types}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from scorewright.session import get_session

    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    spark, con = get_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                ok, msg = True, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on to the next query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
