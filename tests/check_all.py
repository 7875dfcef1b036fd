"""python -m tests.check_all SF_DIR [name ...]: compare queries with their SQL twins."""

import sys
import time

from __spark_entry__ import oracle_sql, queries
from tests.compare import difference, duck
from tests.conftest import session

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, oracles, bad = session(), duck(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                why = difference(df, con, oracles[name])
                n = df.count() if why is None else -1
            else:
                why, n = None, df.count()
        except Exception as e:  # report and go on
            why, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {name} rows={n} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("bad:", bad)
