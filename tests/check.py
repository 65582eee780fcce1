"""Compare named queries with their SQL texts: python tests/check.py SF NAME..."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from factorloom.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(cores=8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    db = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            rows = queries[name](spark, sf).toPandas()
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        try:
            expected = db.execute(oracles[name]).df()
        except duckdb.Error as error:
            print(f"SQL  {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        problem = compare(rows, expected)
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name}: {len(rows)} rows {took:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    spark.stop()
