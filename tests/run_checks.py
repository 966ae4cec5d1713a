"""Run chosen queries against their oracles and print time and outcome per query.

    python -m tests.run_checks [sf_dir] [name ...]
"""

import sys
import time

from portolan.queries import ORACLES, QUERIES
from portolan.session import build_session
from tests.oracle import compare, connect


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or sorted(QUERIES)
    spark = build_session("portolan-checks", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problems = compare(df, con, ORACLES[name]) if name in ORACLES else [] if df.count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{time.time() - start:6.1f}s {'ok ' if not problems else 'BAD'} {name} {problems or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
