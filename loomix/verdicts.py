"""Verifies what has no verdict yet of the corpus, and writes the verdicts: python -m loomix.verdicts"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from .functions import NEAR, corpus
from .verify import Report, verify

PATH = os.path.join(os.path.dirname(__file__), "functions", "verified.json")
#: Arguments that random draws don't hit.
SAMPLES = {"udfb_converttoeuro": [(10.0, c) for c in ("EUR", "USD", "GBP", "CHF")] + [(None, "EUR"), (1.0, None)]}


def check(spark: SparkSession, name: str, draws: int = 100) -> Report:
    return verify(spark, corpus()[name], SAMPLES.get(name, ()), draws, tolerance=NEAR.get(name, 0))


def main() -> int:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    found, failed = {}, 0
    with open(PATH, encoding="utf-8") as f:
        known = set(json.load(f).values())
    for name, native in sorted(corpus().items()):
        if not native.native:
            continue
        if native.digest() in known:
            found[name] = native.digest()
            continue
        report = check(spark, name)
        if report.ok:
            found[name] = native.digest()
        else:
            failed += 1
            print(name, *report.problems, sep="\n  ")
    with open(PATH, "w", encoding="utf-8") as f:
        json.dump(found, f, indent=1)
        f.write("\n")
    print(f"{len(found)} verified, {failed} failed")
    spark.stop()
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
