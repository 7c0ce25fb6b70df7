"""Serving: Python functions as SQL-defined functions that the analyzer inlines.

A rewrite is registered as ``CREATE OR REPLACE TEMPORARY FUNCTION f(x BIGINT) RETURNS BIGINT RETURN ...``;
the plan holds ordinary expressions, so filters reach the scan and code generation applies. Only a rewrite
that was verified against its Python function is served: at its first use, or before, with the verdict kept
in ``verified.json`` under a digest of function, rewrite and versions. A function without one, or whose rewrite
fails, keeps running as a Python UDF.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from dataclasses import dataclass

import pyspark

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import conf, java
from .canonical import NotKeyable, fingerprint
from .lowering import Decline, lower
from .types import Signature, UnknownType, signature


@dataclass(frozen=True)
class Rewrite:
    """A function's equivalent. kind: sql (an expression over the parameters), java (a class), or python (none)."""

    kind: str
    payload: str = ""
    cls: str = ""
    why: str = ""


def rewrite(fn, sig: Signature) -> Rewrite:
    """The rewrite that the lowering rules give."""
    try:
        return Rewrite("sql", lower(fn, sig))
    except (Decline, ValueError) as e:
        return Rewrite("python", why=str(e))


def bind(sql: str, columns: list[str]) -> str:
    """Replaces the placeholders _p0, _p1, ... ; _p1 isn't taken for the beginning of _p10."""
    return re.sub(r"\b_p(\d+)\b", lambda m: columns[int(m[1])], sql)


#: Text that could reach beyond the row.
FORBIDDEN = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.I)


def define(spark: SparkSession, name: str, sig: Signature, found: Rewrite) -> None:
    """Registers a rewrite under the name."""
    if found.kind == "java":
        java.register(spark, name, found.cls, found.payload, sig.returns)
        return
    if FORBIDDEN.search(found.payload):
        raise java.Rejected("reflection isn't allowed")
    params = ", ".join(f"`{n}` {t}" for n, t in sig.params)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({params}) RETURNS {sig.returns} RETURN {found.payload}")


#: Verdicts of this process, by digest.
_verified: dict[str, bool] = {}


@functools.lru_cache
def verdicts() -> frozenset[str]:
    """Digests of the corpus functions whose rewrites were verified when the file was written."""
    with open(os.path.join(os.path.dirname(__file__), "functions", "verified.json"), encoding="utf-8") as f:
        return frozenset(json.load(f).values())


class NativeFunction:
    """Callable on columns; runs natively where there is a rewrite."""

    def __init__(self, fn, sig: Signature, found: Rewrite):
        functools.update_wrapper(self, fn)
        self.fn, self.sig, self.rewrite = fn, sig, found
        digest = hashlib.sha256(f"{found.kind}\0{found.payload}\0{sig}".encode()).hexdigest()[:12]
        self.name = f"loomix_{fn.__name__}_{digest}".lower()
        self._sessions: dict[int, str] = {}

    @property
    def native(self) -> bool:
        return self.rewrite.kind != "python"

    def digest(self) -> str:
        """Changes with anything that the verdict on the rewrite may depend on."""
        parts = [fingerprint(self.fn), str(self.sig), self.rewrite.kind, self.rewrite.payload, pyspark.__version__]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def register(self, spark: SparkSession) -> str:
        """Registers the rewrite, verified or not, and returns its name."""
        define(spark, self.name, self.sig, self.rewrite)
        return self.name

    def trusted(self, spark: SparkSession) -> bool:
        """Whether the rewrite was verified; if that isn't known, and may be done here, it is done now."""
        try:
            digest = self.digest()
        except NotKeyable:
            digest = f"{id(self)}"
        if digest in verdicts() or digest in _verified:
            return digest in verdicts() or _verified[digest]
        if not conf.flag(spark, "inlineWorker"):
            return False
        from .verify import verify

        _verified[digest] = verify(spark, self, draws=int(conf.number(spark, "maxExamples")), timeout=conf.number(spark, "verifyTimeoutSeconds"), tolerance=conf.number(spark, "tolerance")).ok
        return _verified[digest]

    def define(self, spark: SparkSession) -> str:
        """Registers what may be served with the session once; returns its name there."""
        name = self._sessions.get(id(spark))
        if name is None or not spark.catalog.functionExists(name):
            if self.native and self.trusted(spark):
                name = self.register(spark)
            else:
                name = f"{self.name}_python"
                spark.udf.register(name, self.fn, self.sig.returns)
            self._sessions[id(spark)] = name
        return name

    def __call__(self, *columns) -> Column:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no active session")
        return F.call_function(self.define(spark), *[c if isinstance(c, Column) else F.col(c) for c in columns])


def native_udf(returns: str | None = None, *, inputs: list[str] | None = None, sql: str | None = None, java_body: str | None = None, java_members: str = ""):
    """Decorator: serve an annotated function natively.

    sql: a rewrite to use instead of lowering, over the parameters by name; java_body: the body of a Java
    UDF's call(). Functions whose types aren't known keep running as Python UDFs of type ``returns``.
    """

    def decorate(fn) -> NativeFunction:
        try:
            sig = signature(fn, returns, inputs)
        except UnknownType as e:
            if not returns:
                raise
            names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
            return NativeFunction(fn, Signature(tuple((n, "string") for n in names), returns), Rewrite("python", why=str(e)))
        if java_body is not None:
            cls, source = java.wrap(java_body, list(sig.params), sig.returns, java_members)
            return NativeFunction(fn, sig, Rewrite("java", source, cls))
        return NativeFunction(fn, sig, Rewrite("sql", sql) if sql is not None else rewrite(fn, sig))

    return decorate


def served_kind(df) -> str:
    """python if the plan calls Python workers, else native."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "python" if re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF", plan) else "native"
