"""Runs registered queries against their SQL: python -m tests.oracle SF_DIR [name...]"""

import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted(tuple(fix(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, query, sql):
    got = query(spark, sf)
    a = canonical([tuple(r) for r in got.collect()], got.columns)
    done = con.execute(sql)
    b = canonical(done.fetchall(), [d[0] for d in done.description])
    return a == b, a, b


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sys.argv[1]), 0
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            ok, a, b = compare(s, con, sys.argv[1], entry.queries()[name], sql)
            print("ok " if ok else "BAD", name, len(a[1]), len(b[1]), f"{time.time() - t:.1f}s", "" if ok else (a[0], b[0], [x for x in zip(a[1], b[1]) if x[0] != x[1]][:2]), flush=True)
        except Exception as e:
            ok = False
            print("ERR", name, str(e)[:500].replace("\n", " "), flush=True)
        bad += not ok
    sys.exit(bad)
