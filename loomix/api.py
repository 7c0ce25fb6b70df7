"""Sessions: enable(), udf(), register_impl() and shutdown() around the catalog, the producers and the verifier."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import conf, producers
from .canonical import NotKeyable, canonical_source, captures, key, load
from .catalog import Catalog, Row, Shared
from .lowering import Decline
from .serve import NativeFunction, Rewrite
from .types import Signature, UnknownType, category, signature
from .verify import verify


@dataclass
class Session:
    """What a Spark session's functions share."""

    spark: SparkSession
    catalog: Catalog
    shared: Shared | None = None
    registry: producers.Registry = field(default_factory=producers.Registry)
    stop: threading.Event = field(default_factory=threading.Event)
    worker: threading.Thread | None = None

    def chain(self) -> producers.Chain:
        made = {"registry": self.registry, "lowering": producers.Lowering(), "command": producers.Command(conf.get(self.spark, "command"))}
        return producers.Chain(tuple(made[n] for n in conf.names(self.spark, "producers")))

    def lookup(self, name: str, sig: Signature) -> tuple[str, Row | None]:
        where = self.shared or self.catalog
        return where.lookup(name, conf.number(self.spark, "tolerance"), self.needs_approval(sig, ""))

    def needs_approval(self, sig: Signature, source: str) -> bool:
        """Whether a person must approve a rewrite: by a parameter's category, for code that uses the network, or always."""
        asked = set(conf.names(self.spark, "requireApproval"))
        network = any(f"import {m}" in source or f"{m}." in source for m in ("socket", "urllib", "http", "requests", "boto3"))
        return "all" in asked or bool(asked & {category(t) for t in sig.types}) or "network" in asked and network

    def process(self, row: Row, fn=None) -> str:
        """Rewrites and verifies a pending row, and returns its new status; whatever happens, it doesn't stay running."""
        catalog, spark = self.catalog, self.spark
        if not catalog.claim(row.key):
            return catalog.get(row.key).status
        try:
            fn = fn or load(row.source, json.loads(row.captures))
            sig = Signature(tuple(map(tuple, json.loads(row.params))), row.returns)
            producer, found = self.chain().ask(fn, sig)
            if found.kind not in conf.names(spark, "targets"):
                raise Decline(f"{found.kind} isn't wanted")
            tolerance = conf.number(spark, "tolerance")
            report = verify(spark, NativeFunction(fn, sig, found), catalog.samples(row.key), int(conf.number(spark, "maxExamples")), tolerance=tolerance, timeout=conf.number(spark, "verifyTimeoutSeconds"))
            if not report.ok:
                catalog.mark_failed(row.key, "; ".join(report.problems)[:2000], found.kind, found.payload)
            else:
                catalog.mark_success(row.key, found.kind, found.payload, found.cls, producer, "", tolerance, report.agreed)
                self.finish(row.key, sig, row.source)
        except producers.Trouble as e:
            catalog.release(row.key, str(e))
        except Exception as e:
            catalog.mark_failed(row.key, str(e)[:2000])
        return catalog.get(row.key).status

    def finish(self, name: str, sig: Signature, source: str) -> None:
        """A provisional row that was built once is served, or waits for approval."""
        if self.needs_approval(sig, source):
            self.catalog.park(name)
        elif self.catalog.promote(name) and self.shared:
            self.shared.publish(self.catalog.get(name))

    def poll(self) -> bool:
        """One turn of a worker: lost claims return, the oldest pending row is processed. False if there was none."""
        self.catalog.reclaim_stale()
        row = self.catalog.oldest_pending()
        if row is None:
            return False
        self.process(row)
        return True

    def run_worker(self) -> None:
        while not self.stop.is_set():
            if not self.poll():
                self.stop.wait(conf.number(self.spark, "pollIntervalSeconds"))


_session: Session | None = None


def enable(spark: SparkSession, background: bool = False, **settings) -> Session:
    """Opens the catalog for a session; settings as in conf. With ``background``, a thread works off what is pending."""
    global _session
    shutdown()
    conf.override(**settings)
    catalog = Catalog(
        conf.get(spark, "catalog") or ":memory:", conf.number(spark, "failCooldownSeconds"), int(conf.number(spark, "maxRetries")),
        conf.number(spark, "claimTimeoutSeconds"), int(conf.number(spark, "maxSamples")),
    )
    shared = conf.get(spark, "shared")
    _session = Session(spark, catalog, Shared(spark, catalog, shared, int(conf.number(spark, "shareThreshold"))) if shared else None)
    if background:
        _session.worker = threading.Thread(target=_session.run_worker, name="loomix-worker", daemon=True)
        _session.worker.start()
    return _session


def shutdown() -> None:
    """Ends the worker, appends what is staged, closes the catalog and forgets the settings."""
    global _session
    if _session is None:
        return
    held, _session = _session, None
    held.stop.set()
    if held.worker:
        held.worker.join(60)
    if held.shared:
        held.shared.flush()
    held.catalog.close()
    conf.override(**dict.fromkeys(conf.DEFAULTS))


def current() -> Session:
    if _session is None:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no active session")
        enable(spark)
    return _session


def udf(fn, returns: str | None = None, inputs: list[str] | None = None):
    """A function on columns, native if the catalog has, or the session finds, a verified rewrite.

    Pandas, Arrow and nondeterministic UDFs, and what isn't a plain function, are left as they are; functions of unknown
    types, of unwanted categories or with captures that can't be part of a key keep running as Python.
    """
    if not hasattr(fn, "__code__") or hasattr(fn, "evalType"):
        return fn
    held = current()
    spark = held.spark
    python = lambda sig, why: NativeFunction(fn, sig, Rewrite("python", why=why))
    try:
        sig = signature(fn, returns, inputs)
    except UnknownType as e:
        if not returns:
            raise
        return python(Signature(tuple((n, "string") for n in fn.__code__.co_varnames[: fn.__code__.co_argcount]), returns), str(e))
    unwanted = {category(t) for t in sig.types} - set(conf.names(spark, "inputCategories"))
    if unwanted:
        return python(sig, f"parameters of {', '.join(sorted(unwanted))}")
    try:
        name = key(fn, sig, spark.version)
    except NotKeyable as e:
        return python(sig, str(e))
    state, row = held.lookup(name, sig)
    if state == "miss":
        row = Row(name, fn.__name__, canonical_source(fn), json.dumps([list(p) for p in sig.params]), sig.returns, json.dumps(captures(fn)), spark.version)
        held.catalog.insert_pending(row)
    if state != "hit" and conf.flag(spark, "inlineWorker"):
        held.process(held.catalog.get(name), fn)
        state, row = held.lookup(name, sig)
    if state != "hit":
        return python(sig, (row.error if row else "") or "not rewritten yet")
    out = NativeFunction(fn, sig, Rewrite(row.kind, row.payload, row.cls))
    out.trusted = lambda spark: True  # the catalog holds its verdict
    return out


def register(spark: SparkSession, name: str, fn, returns: str | None = None, inputs: list[str] | None = None):
    """As spark.udf.register: the function under a name for SQL, native where it can be."""
    found = udf(fn, returns, inputs)
    if not isinstance(found, NativeFunction):
        return spark.udf.register(name, found)
    found.name = name
    found._sessions.clear()
    if found.native and found.trusted(spark):
        found.register(spark)
    else:
        spark.udf.register(name, fn, found.sig.returns)
    found._sessions[id(spark)] = name
    return found


def register_impl(fn, sql: str | None = None, java_body: str | None = None, returns: str | None = None, inputs: list[str] | None = None, check: bool = True):
    """A person's rewrite: verified and served, or, with check off, kept as pending for a worker to verify. Returns the row."""
    held = current()
    sig = signature(fn, returns, inputs)
    found = producers.given("java" if sql is None else "sql", sql if sql is not None else java_body, sig)
    held.registry.add(fn, sig, found)
    name = key(fn, sig, held.spark.version)
    row = Row(name, fn.__name__, canonical_source(fn), json.dumps([list(p) for p in sig.params]), sig.returns, json.dumps(captures(fn)), held.spark.version, kind=found.kind, payload=found.payload, cls=found.cls, producer="human")
    if not check:
        held.catalog.insert_pending(row)
        return held.catalog.get(name)
    tolerance = conf.number(held.spark, "tolerance")
    report = verify(held.spark, NativeFunction(fn, sig, found), held.catalog.samples(name), int(conf.number(held.spark, "maxExamples")), tolerance=tolerance, timeout=conf.number(held.spark, "verifyTimeoutSeconds"))
    held.catalog.upsert_success(row)
    if report.ok:
        held.catalog._set(name, tolerance=tolerance, agreed=report.agreed)
        held.finish(name, sig, row.source)
    else:
        held.catalog.mark_failed(name, "; ".join(report.problems)[:2000], found.kind, found.payload)
    return held.catalog.get(name)


def sample(df: DataFrame, fn, columns: list[str], returns: str | None = None, inputs: list[str] | None = None) -> int:
    """Keeps argument rows of a DataFrame for verification, as many as the setting says; distinct ones."""
    held = current()
    if not conf.flag(held.spark, "sampling"):
        return 0
    sig = signature(fn, returns, inputs)
    rows = [tuple(r) for r in df.select(*columns).distinct().limit(int(conf.number(held.spark, "maxSamples"))).collect()]
    held.catalog.add_samples(key(fn, sig, held.spark.version), rows)
    return len(rows)


canonical_source_from_func = canonical_source
