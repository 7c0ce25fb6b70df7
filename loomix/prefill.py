"""Fills the catalog from source files: python -m loomix.prefill PATH... [--catalog FILE] [--queue]"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import api, extract
from .catalog import FAILED, SUCCESS, Row

CACHED, REWRITTEN, FAILURE, QUEUED, IN_FLIGHT, FAILED_BEFORE = "cached", "rewritten", "failed", "queued", "in flight", "failed before"


@dataclass(frozen=True)
class Outcome:
    path: str
    name: str
    outcome: str
    detail: str = ""


def prefill(session: api.Session, paths: list[str], queue: bool = False) -> list[Outcome]:
    """Rewrites, or with ``queue`` asks for, every UDF under the paths; files unchanged since they were done are passed over."""
    out = []
    for path in extract.walk(paths):
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        digest = extract.digest(text, session.spark.version)
        if session.catalog.file_done(path, digest):
            continue
        done = True
        for found in extract.extract(text, path):
            outcome = Outcome(path, found.name, "skipped", found.reason) if found.reason else one(session, found, queue)
            done &= outcome.outcome not in (QUEUED, IN_FLIGHT)
            out.append(outcome)
        if done:
            session.catalog.mark_file(path, digest)
    return out


def one(session: api.Session, found: extract.Found, queue: bool) -> Outcome:
    name = found.key(session.spark.version)
    row = Row(name, found.name, found.source, found.params, found.returns, found.captures, session.spark.version)
    old = session.catalog.get(name)
    if old is not None and old.status == SUCCESS:
        return Outcome(found.path, found.name, CACHED)
    if old is not None and old.status == FAILED:
        return Outcome(found.path, found.name, FAILED_BEFORE, old.error)
    if old is not None and old.status not in ("pending",):
        return Outcome(found.path, found.name, IN_FLIGHT, old.status)
    session.catalog.insert_pending(row)
    if queue:
        return Outcome(found.path, found.name, QUEUED)
    status = session.process(row)
    if status in (SUCCESS, "awaiting_approval"):
        return Outcome(found.path, found.name, REWRITTEN, status)
    return Outcome(found.path, found.name, FAILURE if status == FAILED else IN_FLIGHT, session.catalog.get(name).error)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Rewrite the UDFs of source files.")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--catalog", help="SQLite file of the catalog")
    parser.add_argument("--queue", action="store_true", help="leave the work to a worker")
    given = parser.parse_args(args)
    session = api.enable(SparkSession.builder.getOrCreate(), catalog=given.catalog)
    try:
        found = prefill(session, given.paths, given.queue)
        for x in found:
            print(f"{x.path}: {x.name}: {x.outcome}{': ' + x.detail if x.detail else ''}")
    finally:
        api.shutdown()
    return int(any(x.outcome == FAILURE for x in found))


if __name__ == "__main__":
    raise SystemExit(main())
