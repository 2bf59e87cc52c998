"""Command-line check: python tests/check.py [--sf 0.01] [query ...]."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            result = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name in oracles:
                expected = con.sql(oracles[name]).to_arrow_table()
                notes = differences(result, expected)
            else:
                notes = [] if result.num_rows else ["no rows"]
        except Exception as error:  # report and go on with the next query
            took, notes, result = time.time() - start, [f"{type(error).__name__}: {str(error)[:1500]}"], None
        hard = [n for n in notes if not n.startswith("type of")]
        bad += bool(hard)
        rows = result.num_rows if result is not None else "-"
        print(f"{'BAD ' if hard else 'ok  '} {name:34s} {took:6.2f}s rows={rows} {'' if name in oracles else '(rows only)'}", flush=True)
        for note in notes:
            print("     ", note, flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
