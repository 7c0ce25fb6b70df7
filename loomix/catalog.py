"""The catalog of rewrites: one row for each function, from the wish for a rewrite to its service.

    pending -> running -> provisional -> success | awaiting_approval | failed

A row is claimed by one worker at a time (a conditional update in SQLite). A verified rewrite is provisional
until its function has been built once, and only a success is served. A failed row returns to pending after a
cooldown, at most ``max_retries`` times; a success that was verified more loosely than is allowed now, too.

Sessions on other machines share successes through a Parquet table: rows are appended, never changed, and the
latest row of a key holds. The relational parts (latest, newest, merged, success rates) are DataFrame functions.
"""

from __future__ import annotations

import json
import sqlite3
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PENDING, RUNNING, PROVISIONAL, SUCCESS, FAILED, AWAITING = "pending", "running", "provisional", "success", "failed", "awaiting_approval"


@dataclass(frozen=True)
class Row:
    """A function and its rewrite. params: JSON pairs of names and types; kind: sql, java or python."""

    key: str
    name: str = ""
    source: str = ""
    params: str = "[]"
    returns: str = ""
    captures: str = "{}"
    spark_version: str = ""
    status: str = PENDING
    kind: str = ""
    payload: str = ""
    cls: str = ""
    producer: str = ""
    model: str = ""
    tolerance: float = 0.0
    agreed: int = 0
    attempts: int = 0
    error: str = ""
    reviewer: str = ""
    created_at: float = 0.0
    updated_at: float = 0.0
    claimed_at: float = 0.0


NAMES = [f.name for f in fields(Row)]
_SQL = {"str": "TEXT", "float": "REAL", "int": "INTEGER"}
SCHEMA = ", ".join(f"{f.name} {dict(str='string', float='double', int='int')[f.type]}" for f in fields(Row))


class Catalog:
    """The state machine, in a SQLite file that workers on one machine may share."""

    def __init__(self, path: str = ":memory:", cooldown: float = 86400, max_retries: int = 3, claim_timeout: float = 600, max_samples: int = 64, clock: Callable[[], float] = time.time):
        self.cooldown, self.max_retries, self.claim_timeout, self.max_samples, self.clock = cooldown, max_retries, claim_timeout, max_samples, clock
        self._lock = threading.RLock()
        self._db = sqlite3.connect(path, check_same_thread=False, timeout=30, isolation_level=None)
        self._db.execute(f"CREATE TABLE IF NOT EXISTS rewrites ({', '.join(f'{f.name} {_SQL[f.type]}' for f in fields(Row))}, PRIMARY KEY (key))")
        self._db.execute("CREATE TABLE IF NOT EXISTS samples (key TEXT, args TEXT, created_at REAL, UNIQUE (key, args))")
        self._db.execute("CREATE TABLE IF NOT EXISTS files (path TEXT PRIMARY KEY, digest TEXT)")

    def _run(self, sql: str, *values) -> sqlite3.Cursor:
        with self._lock:
            return self._db.execute(sql, values)

    def _rows(self, where: str, *values) -> list[Row]:
        return [Row(*r) for r in self._run(f"SELECT {', '.join(NAMES)} FROM rewrites {where}", *values)]

    def _set(self, key: str, where: str = "", **values) -> bool:
        """Changes a row, if ``where`` holds for it; says whether it did."""
        values["updated_at"] = self.clock()
        sets = ", ".join(f"{n} = :{n}" for n in values)
        with self._lock:
            return self._db.execute(f"UPDATE rewrites SET {sets} WHERE key = :key {where}", {**values, "key": key}).rowcount == 1

    def get(self, key: str) -> Row | None:
        found = self._rows("WHERE key = ?", key)
        return found[0] if found else None

    def size(self) -> int:
        return self._run("SELECT count(*) FROM rewrites").fetchone()[0]

    # A row's life.

    def lookup(self, key: str, tolerance: float = 0.0, approval: bool = False) -> tuple[str, Row | None]:
        """("hit", row) for a rewrite that may be served, ("wait", row) for one that may come, ("miss", None)."""
        row = self.get(key)
        if row is None:
            return "miss", None
        if row.status == SUCCESS:
            if row.tolerance > tolerance:
                self._set(key, f"AND status = '{SUCCESS}'", status=PENDING, error="verified more loosely than allowed")
            elif approval and not row.reviewer:
                self._set(key, f"AND status = '{SUCCESS}'", status=AWAITING)
            else:
                return "hit", row
        elif row.status == FAILED and row.attempts < self.max_retries and row.reviewer == "" and self.clock() - row.updated_at >= self.cooldown:
            self._set(key, f"AND status = '{FAILED}'", status=PENDING)
        return "wait", self.get(key)

    def insert_pending(self, row: Row) -> bool:
        """Asks for a rewrite; False if the key is there already."""
        if not row.returns or any(not t for _, t in json.loads(row.params)):
            raise ValueError("the types of a function must be known")
        now = self.clock()
        values = asdict(replace(row, status=PENDING, created_at=now, updated_at=now))
        return self._run(f"INSERT OR IGNORE INTO rewrites ({', '.join(NAMES)}) VALUES ({', '.join('?' * len(NAMES))})", *[values[n] for n in NAMES]).rowcount == 1

    def oldest_pending(self) -> Row | None:
        found = self._rows(f"WHERE status = '{PENDING}' ORDER BY created_at, key LIMIT 1")
        return found[0] if found else None

    def claim(self, key: str) -> bool:
        """Takes a pending row; of several workers one succeeds."""
        with self._lock:
            now = self.clock()
            return self._db.execute(f"UPDATE rewrites SET status = '{RUNNING}', attempts = attempts + 1, claimed_at = ?, updated_at = ? WHERE key = ? AND status = '{PENDING}'", (now, now, key)).rowcount == 1

    def mark_success(self, key: str, kind: str, payload: str, cls: str = "", producer: str = "", model: str = "", tolerance: float = 0.0, agreed: int = 0) -> bool:
        """A claimed row's verified rewrite, not served before promote()."""
        return self._set(key, f"AND status = '{RUNNING}'", status=PROVISIONAL, kind=kind, payload=payload, cls=cls, producer=producer, model=model, tolerance=tolerance, agreed=agreed, error="")

    def upsert_success(self, row: Row) -> None:
        """A rewrite that was verified outside a worker; not served before promote()."""
        now = self.clock()
        old = self.get(row.key)
        values = asdict(replace(row, status=PROVISIONAL, created_at=old.created_at if old else now, updated_at=now, claimed_at=now))
        self._run(f"INSERT OR REPLACE INTO rewrites ({', '.join(NAMES)}) VALUES ({', '.join('?' * len(NAMES))})", *[values[n] for n in NAMES])

    def promote(self, key: str) -> bool:
        return self._set(key, f"AND status = '{PROVISIONAL}'", status=SUCCESS)

    def mark_failed(self, key: str, error: str, kind: str = "", payload: str = "") -> bool:
        """The rejected candidate stays with the row."""
        return self._set(key, f"AND status IN ('{RUNNING}', '{PROVISIONAL}')", status=FAILED, error=error, kind=kind, payload=payload)

    def release(self, key: str, error: str) -> bool:
        """After a passing trouble: failed, but without having used up an attempt."""
        with self._lock:
            self._db.execute("UPDATE rewrites SET attempts = max(attempts - 1, 0) WHERE key = ?", (key,))
            return self.mark_failed(key, error)

    def reclaim_stale(self) -> int:
        """Rows whose worker was lost: pending again, or failed after the last retry."""
        old, n = self.clock() - self.claim_timeout, 0
        for row in self._rows(f"WHERE status IN ('{RUNNING}', '{PROVISIONAL}') AND claimed_at < ?", old):
            status = PENDING if row.attempts < self.max_retries else FAILED
            n += self._set(row.key, f"AND status = '{row.status}'", status=status, error="its worker was lost")
        return n

    # Approval.

    def park(self, key: str) -> bool:
        return self._set(key, f"AND status IN ('{PROVISIONAL}', '{SUCCESS}')", status=AWAITING)

    def awaiting(self) -> list[Row]:
        return self._rows(f"WHERE status = '{AWAITING}' ORDER BY created_at, key")

    def approve(self, key: str, reviewer: str) -> bool:
        return self._set(key, f"AND status = '{AWAITING}'", status=SUCCESS, reviewer=reviewer)

    def reject(self, key: str, reviewer: str, why: str = "") -> bool:
        """For good: a rejected rewrite isn't tried again, nor taken from the shared table."""
        return self._set(key, f"AND status IN ('{AWAITING}', '{SUCCESS}')", status=FAILED, reviewer=reviewer, error=why or "rejected")

    # Samples and scanned files.

    def add_samples(self, key: str, rows: Iterable[tuple]) -> None:
        """Argument rows seen in data; of a key the newest ``max_samples`` stay."""
        with self._lock:
            for i, r in enumerate(rows):
                self._db.execute("INSERT OR REPLACE INTO samples VALUES (?, ?, ?)", (key, encode(r), self.clock() + i * 1e-6))
            self._db.execute("DELETE FROM samples WHERE key = ? AND args NOT IN (SELECT args FROM samples WHERE key = ? ORDER BY created_at DESC LIMIT ?)", (key, key, self.max_samples))

    def samples(self, key: str) -> list[tuple]:
        return [decode(r[0]) for r in self._run("SELECT args FROM samples WHERE key = ? ORDER BY created_at DESC", key)]

    def file_done(self, path: str, digest: str) -> bool:
        found = self._run("SELECT digest FROM files WHERE path = ?", path).fetchone()
        return found is not None and found[0] == digest

    def mark_file(self, path: str, digest: str) -> None:
        self._run("INSERT OR REPLACE INTO files VALUES (?, ?)", path, digest)

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows as a DataFrame."""
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self._rows("")], SCHEMA)

    def close(self) -> None:
        self._db.close()


def encode(args: tuple) -> str:
    """Argument values as tagged JSON, so that each comes back as what it was."""
    import base64
    import datetime
    import decimal

    def tag(x):
        if x is None or isinstance(x, (bool, int, str)):
            return x
        if isinstance(x, float):
            return {"float": repr(x)}
        if isinstance(x, (bytes, bytearray)):
            return {"bytes": base64.b64encode(bytes(x)).decode()}
        if isinstance(x, datetime.datetime):
            return {"time": x.isoformat()}
        if isinstance(x, decimal.Decimal):
            return {"decimal": str(x)}
        if isinstance(x, (list, tuple)):
            return [tag(y) for y in x]
        if isinstance(x, dict):
            return {"map": [[tag(k), tag(v)] for k, v in x.items()]}
        raise TypeError(f"no sample of type {type(x).__name__}")

    return json.dumps([tag(x) for x in args])


def decode(text: str) -> tuple:
    import base64
    import datetime
    import decimal

    kinds = {"float": float, "bytes": base64.b64decode, "time": datetime.datetime.fromisoformat, "decimal": decimal.Decimal}

    def value(x):
        if isinstance(x, list):
            return [value(y) for y in x]
        if isinstance(x, dict):
            ((name, y),) = x.items()
            return {value(k): value(v) for k, v in y} if name == "map" else kinds[name](y)
        return x

    return tuple(value(x) for x in json.loads(text))


# Relational parts.


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregate, combined before the shuffle, so a frequent key doesn't matter."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def newest(df: DataFrame, keys: list[str], order: list[str], n: int = 64) -> DataFrame:
    """The last ``n`` rows of each key by ``order``; Spark limits each key's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def merged(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: rows of ``changes`` replace those of their keys, others stay. Both have the same columns."""
    return table.join(changes, keys, "left_anti").unionByName(changes)


def success_rates(df: DataFrame, by: list[str], status: str = "status", success: str = SUCCESS) -> DataFrame:
    """(by, succeeded, tried) of each group."""
    return df.groupBy(*by).agg(F.count_if(F.col(status) == success).alias("succeeded"), F.count("*").alias("tried"))


def collect_stats(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Success by producer and model, of rows that a producer has answered."""
    return success_rates(catalog.table(spark).where("producer <> ''"), ["producer", "model"])


@dataclass
class Shared:
    """Successes shared by a Parquet table; reads go to the local catalog first."""

    spark: SparkSession
    local: Catalog
    path: str
    threshold: int = 32
    staged: list[Row] = field(default_factory=list)

    def publish(self, row: Row) -> None:
        """Stages a verified row, or a reviewer's rejection; appended once enough are staged."""
        self.staged.append(row)
        if len(self.staged) >= self.threshold:
            self.flush()

    def flush(self) -> int:
        rows, self.staged = self.staged, []
        if rows:
            self.spark.createDataFrame([tuple(asdict(r).values()) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return len(rows)

    def table(self) -> DataFrame:
        """The latest row of each key."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return latest(rows, ["key"], ["updated_at", "status"])

    def lookup(self, key: str, tolerance: float = 0.0, approval: bool = False) -> tuple[str, Row | None]:
        """As Catalog.lookup(); what is neither served nor rejected here is looked for in the shared table and kept here."""
        state, row = self.local.lookup(key, tolerance, approval)
        if state == "hit" or row is not None and row.reviewer and row.status == FAILED:
            return state, row
        found = self.table().where((F.col("key") == key) & (F.col("status") == SUCCESS) & (F.col("tolerance") <= tolerance)).select(*NAMES).first()
        if found is None:
            return state, row
        self.local.upsert_success(Row(*found))
        self.local.promote(key)
        return self.local.lookup(key, tolerance, approval)
