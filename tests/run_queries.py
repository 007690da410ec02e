"""Run registered queries against their SQL: `python tests/run_queries.py FOLDER [name prefixes]`."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402

from plumbline.plans import load_all  # noqa: E402
from plumbline.session import get_spark  # noqa: E402


def main(folder, prefixes):
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    qs, oracles = load_all()
    con = connect(folder)
    names = [n for n in qs if not prefixes or any(n.startswith(p) for p in prefixes)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            if n in oracles:
                res = compare(df, oracles[n], con)
            else:
                rows = df.collect()
                res = [] if rows else ["no rows"]
                print(f"     {n}: {len(rows)} rows, e.g. {str(rows[:1])[:300]}")
        except Exception as e:  # noqa: BLE001
            res = [f"{type(e).__name__}: {str(e)[:900]}"]
        dt = time.time() - t0
        if res:
            bad += 1
        print(f"{'BAD ' if res else 'ok  '} {n} {dt:.2f}s {'' if n in oracles else '(rows only)'} {'; '.join(res)[:1200]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
