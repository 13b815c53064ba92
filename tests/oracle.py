"""Holds every registered query against its SQL: python tests/oracle.py SF_DIR [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def differences(spark, name, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(canon(v) for v in r) for r in df.select(*names).collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    place = [rel.columns.index(c) for c in names]
    want = [tuple(canon(r[k]) for k in place) for r in rel.fetchall()]
    key = lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), (got[-1:], want[-1:]))
        return f"{len(got)} and {len(want)} rows; {first}"
    return None if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, sql in e.oracle_sql().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            d = differences(spark, name, e.queries()[name], sql, sys.argv[1])
        except Exception as x:
            d = f"{type(x).__name__}: {str(x)[:700]}"
        bad += d is not None
        print("BAD" if d else "ok ", name, round(time.time() - t, 1), (d or "")[:900], flush=True)
    print("bad:", bad)
