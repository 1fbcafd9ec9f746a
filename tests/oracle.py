"""Run queries and their SQL side by side: python tests/oracle.py [name ...]"""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(spark, d, name, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    got = f(spark, d)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(names)

    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    a = sorted(repr([norm(r[c]) for c in order]) for r in got.collect())
    b = sorted(repr([norm(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    return sorted(got.columns), order, a, b


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/stratalog-wh").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or o:
        t = time.time()
        try:
            c1, c2, a, b = rows_of(spark, os.environ.get("SF", "/root/testdata/sf0.01"), name, q[name], o[name])
            ok = c1 == c2 and a == b
            print(name, "ok" if ok else f"DIFFERS {c1} {c2} {len(a)} {len(b)} {a[:2]} {b[:2]}", len(a), round(time.time() - t, 1), flush=True)
        except Exception as x:
            print(name, "ERROR", str(x)[:3000].replace("\n", " "), traceback.format_exc().splitlines()[-1][:100], flush=True)
