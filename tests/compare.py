"""Compare registered queries with their SQL on one data folder.

``python tests/compare.py [--sf DIR] [NAME...]``
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("COMPARE_SF", "/root/testdata/sf0.01")


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = os.path.join(sf, f, "*.parquet") if os.path.isdir(os.path.join(sf, f)) else os.path.join(sf, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        if isinstance(x, float):
            return format(x + 0.0, ".9g")
        if isinstance(x, bool):
            return str(x).lower()
        return str(x)

    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differences(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return None, len(mine[1]), None
    cur = con.execute(sql)
    theirs = canonical(cur.fetchall(), [c[0] for c in cur.description])
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}", len(mine[1]), len(theirs[1])
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"only here {sorted(a - b)[:3]} only there {sorted(b - a)[:3]}", len(mine[1]), len(theirs[1])
    return "", len(mine[1]), len(theirs[1])


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = duck(SF), e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or qs:
        t = time.time()
        try:
            why, n, m = differences(spark, con, name, qs[name], sql.get(name), SF)
        except Exception as x:  # noqa: BLE001
            why, n, m = f"error {str(x)[:600]}", None, None
        took = time.time() - t
        print(f"{name:32s} {took:6.1f}s rows {n} / {m} {'rows only' if why is None else why or 'equal'}", flush=True)
        bad += bool(why)
    sys.exit(bad)
