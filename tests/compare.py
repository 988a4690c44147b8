"""Run a registered query and its SQL side by side: python -m tests.compare [folder] [names]."""

import datetime
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_result(spark, folder, name):
    df = queries()[name](spark, folder)
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, name):
    cur = con.execute(oracle_sql()[name])
    return normal([d[0] for d in cur.description], cur.fetchall())


def differences(spark, con, folder, name):
    """None when equal, otherwise a short description."""
    (a_names, a), (b_names, b) = spark_result(spark, folder, name), duck_result(con, name)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return (f"rows {len(a)} / {len(b)}, differing {len(only_a)} / {len(only_b)}\n"
                f"   spark {str(only_a[:2])[:700]}\n   duck  {str(only_b[:2])[:700]}")
    return None


if __name__ == "__main__":
    from tests.session import local_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                result = differences(spark, con, folder, name)
            else:
                result = f"(rows only) {len(spark_result(spark, folder, name)[1])}"
        except Exception as e:
            result = "ERROR " + str(e)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = result is None or result.startswith("(rows")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}",
              flush=True)
    print("failed:", bad)
