"""Compare registered queries with their oracle SQL: python tools/check.py [-s sf0.01] [-c chunk] [name ...]"""

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores="8"):
    s = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="sf0.01")
    ap.add_argument("-c", type=int)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tideline.operators import panel

    if a.c:
        panel.CHUNK = a.c
    from tideline.plans import ORACLE, QUERIES

    d = f"/root/testdata/{a.s}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    spark = session()
    bad = []
    for name in a.names or list(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, d)
            got = [tuple(r) for r in df.collect()]
            cols = df.columns
            t1 = time.time()
            if name not in ORACLE:
                print(f"ROWS {name} n={len(got)} {t1-t0:.1f}s {got[:1]}", flush=True)
                continue
            cur = con.execute(ORACLE[name])
            oc = [x[0] for x in cur.description]
            exp = cur.fetchall()
            t2 = time.time()
            if sorted(cols) != sorted(oc):
                bad.append(name)
                print(f"COLS {name} {sorted(set(cols)^set(oc))}", flush=True)
                continue
            ig, ie = [cols.index(c) for c in sorted(cols)], [oc.index(c) for c in sorted(cols)]
            g = sorted(tuple(norm(r[i]) for i in ig) for r in got)
            e = sorted(tuple(norm(r[i]) for i in ie) for r in exp)
            ok = g == e
            print(f"{'ok  ' if ok else 'BAD '} {name} n={len(g)}/{len(e)} spark={t1-t0:.1f}s duck={t2-t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                sg, se = set(g), set(e)
                print("   cols", sorted(cols))
                for x in sorted(sg - se)[:3]:
                    print("   spark", x)
                for x in sorted(se - sg)[:3]:
                    print("   duck ", x)
                print("   diff", len(sg - se), len(se - sg))
        except Exception as ex:
            bad.append(name)
            print(f"ERR  {name} {type(ex).__name__}: {str(ex)[:700]}", flush=True)
    print("bad:", bad)


main()
