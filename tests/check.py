"""python tests/check.py [sf] [name part ...]: run registered queries against DuckDB."""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import connect, differences  # noqa: E402

from watchframe import session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    spark = session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                    spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as entry
    folder = f"/root/testdata/sf{sf}"
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                wrong = differences(df, con, oracles[name])
                n = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]
            else:
                wrong, n = None, df.count()
            bad += bool(wrong)
            mark = "FAIL" if wrong else ("ok  " if name in oracles else "rows")
            print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {wrong or ''}"[:900], flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(exc).__name__} {str(exc)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
