"""Reviews parked rewrites: python -m loomix.approve --catalog FILE list | show KEY | approve KEY | reject KEY [WHY]"""

from __future__ import annotations

import argparse
import getpass

from .catalog import Catalog


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Review rewrites that wait for approval.")
    parser.add_argument("--catalog", required=True, help="SQLite file of the catalog")
    parser.add_argument("--reviewer", default=None)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    for name in ("show", "approve", "reject"):
        sub.add_parser(name).add_argument("key", help="the key, or an unambiguous beginning of it")
    sub.choices["reject"].add_argument("why", nargs="?", default="")
    given = parser.parse_args(args)
    catalog = Catalog(given.catalog)
    try:
        rows = catalog.awaiting()
        if given.what == "list":
            for r in rows:
                print(f"{r.key[:16]} {r.name} {r.kind} {r.producer}")
            return 0
        found = [r for r in rows if r.key.startswith(given.key)]
        if len(found) != 1:
            print(f"{len(found)} rewrites of that key wait for approval")
            return 1
        (row,) = found
        if given.what == "show":
            print(f"{row.source}\n\n{row.kind}:\n{row.payload}")
            return 0
        who = given.reviewer or getpass.getuser()
        return int(not (catalog.approve(row.key, who) if given.what == "approve" else catalog.reject(row.key, who, given.why)))
    finally:
        catalog.close()


if __name__ == "__main__":
    raise SystemExit(main())
