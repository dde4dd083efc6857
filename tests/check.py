"""Command-line run of catalogue checks: python tests/check.py [sf] [name or prefix*]..."""

import fnmatch
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare
from taplight.session import build_session


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sf}"
    oracles, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if wanted and not any(fnmatch.fnmatch(name, w) for w in wanted):
            continue
        t = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                ok, note = compare(df, oracles[name], folder)
            else:
                ok, note = True, f"{df.count()} rows (no SQL)"
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
