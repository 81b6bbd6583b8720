"""Compare queries with their SQL: ``python tests/check_all.py [sf dir] [name ...]``."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402

from stratapanel import catalog  # noqa: E402
from stratapanel.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(sf)
    runs, sqls = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in names or runs:
        start = time.time()
        try:
            found = compare.differences(spark, con, runs[name], sqls[name], sf) if name in sqls else ["no SQL"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n     " if found else " ")
    print(f"{bad} of {len(names or runs)} differ")
    spark.stop()
