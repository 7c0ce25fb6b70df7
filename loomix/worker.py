"""Works off pending rewrites: python -m loomix.worker --catalog FILE [--once]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Rewrite and verify what the catalog has pending.")
    parser.add_argument("--catalog", required=True, help="SQLite file of the catalog")
    parser.add_argument("--once", action="store_true", help="end when nothing is pending")
    given = parser.parse_args(args)
    session = api.enable(SparkSession.builder.getOrCreate(), catalog=given.catalog)
    n = 0
    try:
        if given.once:
            while session.poll():
                n += 1
            print(f"{n} worked off")
        else:
            session.run_worker()
    except KeyboardInterrupt:
        pass
    finally:
        api.shutdown()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
