"""Run registered queries against their DuckDB oracle.

usage: python tests/run_oracle.py [sf_dir] [name ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from tablab.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session()
con = duck(sf)
qs, sql = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if names and name not in names:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sql:
            ok, msg = compare(df, con, sql[name])
        else:
            n = df.count()
            ok, msg = True, f"rows-only {n}"
    except Exception as e:  # report and continue
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t:6.2f}s {msg}", flush=True)
print(f"{bad} failing")
