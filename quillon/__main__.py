"""python -m quillon FOLDER QUERY.txt [--out RESULT.csv | --out-folder PATH] [--quote] [--show N] [--check-keys]"""

from __future__ import annotations

import argparse
import time
from itertools import islice
from pathlib import Path

from pyspark.sql import SparkSession

from quillon.plans.engine import Engine


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillon", description="Answers an SQL query over a folder of typed-header CSV files.")
    p.add_argument("folder")
    p.add_argument("query", help="a file that holds the query")
    p.add_argument("--out", help="the result file; by default the query file's name with .csv, here")
    p.add_argument("--out-folder", help="write the rows as part files in this folder of any store instead, not through the driver")
    p.add_argument("--quote", action="store_true", help="quote text that holds commas, quotes or line ends")
    p.add_argument("--show", type=int, default=0, metavar="N", help="also print the first N rows")
    p.add_argument("--check-keys", action="store_true", help="report violated primary and foreign keys")
    p.add_argument("--strict", action="store_true", help="fail on fields that don't parse")
    o = p.parse_args(args)
    began = time.time()
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    engine = Engine(spark, o.folder, mode="FAILFAST" if o.strict else "PERMISSIVE")
    if o.check_keys:
        for what, n in engine.folder.check_keys(engine.spark).items():
            print(f"{what}: {n} rows")
    out = o.out_folder or o.out or Path(o.query).name.split(".")[0] + ".csv"
    engine.answer(Path(o.query).read_text(encoding="utf-8"), out, bool(o.out_folder), o.quote)
    if o.show:  # of what was written, so that the query runs once
        if o.out_folder:
            shown = [r[0] for part, n in (("header", 1), ("rows", o.show)) for r in spark.read.text(f"{out}/{part}").take(n)]
        else:
            with Path(out).open(encoding="utf-8") as written:
                shown = [line.rstrip("\n") for line in islice(written, o.show + 1)]
        print(*shown, sep="\n")
    print(f"{out}: {1000 * (time.time() - began):.0f} ms")


if __name__ == "__main__":
    main()
