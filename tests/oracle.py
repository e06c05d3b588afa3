"""Side-by-side comparison of a registered query with its SQL counterpart."""

from __future__ import annotations

import datetime
import decimal
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return a short problem text, or '' when both sides agree."""
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if sr else "no rows"
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        a, b = set(map(repr, sr)), set(map(repr, dr))
        return f"rows {len(sr)} vs {len(dr)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        a, b = set(map(repr, sr)), set(map(repr, dr))
        return f"{len(a - b)} rows differ; cols {sc}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return "" if sr else "EMPTY (agrees)"


if __name__ == "__main__":
    import os
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from provlake.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on to the next query
            problem = "ERROR " + str(e)[:1500]
        failed += bool(problem and not problem.startswith("EMPTY"))
        print(f"{'ok  ' if not problem else 'BAD '} {name} {time.time() - t:.1f}s {'' if name in oracles else '(rows only) '}{problem}", flush=True)
    print("failed:", failed)
