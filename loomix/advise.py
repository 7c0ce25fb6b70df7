"""Measurement and advice: which rewrite is fastest, and which may be slower than the Python it replaces."""

from __future__ import annotations

import ast
import csv
import io
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import definition
from .serve import NativeFunction, served_kind

#: Methods of re and of compiled patterns that scan a text.
_REGEX = {"match", "search", "fullmatch", "findall", "finditer", "sub", "subn", "split"}
_SQL_REGEX = re.compile(r"\b(regexp_\w+|rlike|regexp|split)\s*\(", re.I)
OK, AT_RISK, LIKELY, NOT_SERVED = "ok", "at-risk", "likely-regression", "not-served"


def python_regex_calls(fn) -> int:
    """How many regular expressions a call of the function runs at most; a loop over literals counts each of its turns."""
    node = definition(fn)
    modules = {a.asname or a.name for x in ast.walk(node) if isinstance(x, ast.Import) for a in x.names if a.name in ("re", "regex")} | {n for n in ("re", "regex") if getattr(fn, "__globals__", {}).get(n) is not None}
    patterns = {n for n, v in getattr(fn, "__globals__", {}).items() if isinstance(v, re.Pattern)}

    def turns(iterated: ast.expr) -> int:
        if isinstance(iterated, (ast.Tuple, ast.List, ast.Set)):
            return max(1, len(iterated.elts))
        value = fn.__globals__.get(iterated.id) if isinstance(iterated, ast.Name) else None
        return max(1, len(value)) if isinstance(value, (tuple, list)) else 1

    def count(x: ast.AST) -> int:
        own = int(isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in _REGEX and isinstance(x.func.value, ast.Name) and x.func.value.id in modules | patterns)
        if isinstance(x, ast.For):
            return count(x.iter) + turns(x.iter) * sum(map(count, x.body)) + sum(map(count, x.orelse))
        if isinstance(x, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
            n = 1
            for g in x.generators:
                n *= turns(g.iter)
            return sum(count(g.iter) for g in x.generators) + n * (count(x.elt) + sum(count(i) for g in x.generators for i in g.ifs))
        return own + sum(map(count, ast.iter_child_nodes(x)))

    return count(node)


@dataclass(frozen=True)
class Risk:
    verdict: str
    reasons: tuple[str, ...] = ()


def regression_risk(native: NativeFunction) -> Risk:
    """A static guess whether a rewrite may be slower than its Python form.

    Java's regular expressions are what costs most: more of them than Python runs, or ones that see every character
    through lookarounds or Unicode classes, outweigh the trip to a Python worker. So do arrays of single characters.
    """
    found = native.rewrite
    if found.kind == "python":
        return Risk(NOT_SERVED, (found.why or "no rewrite",))
    try:
        calls = python_regex_calls(native.fn)
    except ValueError:
        calls = 0
    regexes = len(_SQL_REGEX.findall(found.payload)) if found.kind == "sql" else len(re.findall(r"Pattern\.compile\(", found.payload))
    reasons, grave = [], False
    if regexes > calls:
        reasons.append(f"{regexes} regular expressions for {calls} in Python")
        grave = regexes > 2 * max(1, calls)
    if re.search(r"\(\?<?[=!][^)]*\\+p\{", found.payload):
        reasons.append("lookarounds with Unicode classes")
        grave = grave or regexes > 3
    if found.kind == "sql" and re.search(r"split\([^()]*(\([^()]*\)[^()]*)*,\s*''\)|sequence\(", found.payload):
        reasons.append("an array with an element for each character or step")
    if found.kind == "sql" and len(found.payload) > 4000:
        reasons.append("an expression of more than 4000 characters, too long for compiled code")
        grave = True
    return Risk((LIKELY if grave else AT_RISK) if reasons else OK, tuple(reasons))


# Timing.


def noop(df: DataFrame) -> None:
    """Runs a plan to its end without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()


def seconds(df: DataFrame, runs: int = 3) -> float:
    """The least time of some runs, after one to warm up."""
    noop(df)
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        noop(df)
        times.append(time.perf_counter() - began)
    return min(times)


@dataclass(frozen=True)
class Timing:
    """Rows a second of one candidate; 0 if it doesn't run, or runs as Python without saying so."""

    name: str
    rate: float
    error: str = ""


def benchmark_all(df: DataFrame, candidates: dict[str, str | Column | Callable[[], Column]], runs: int = 3, python: tuple[str, ...] = ("python",)) -> list[Timing]:
    """Times expressions over a DataFrame. Those named in ``python`` may call Python workers; others that do are refused."""
    rows, out = df.count(), []
    for name, c in candidates.items():
        try:
            plan = df.select((F.expr(c) if isinstance(c, str) else c() if callable(c) and not isinstance(c, Column) else c).alias("result"))
            if name not in python and served_kind(plan) == "python":
                out.append(Timing(name, 0.0, "runs as Python"))
                continue
            out.append(Timing(name, rows / max(seconds(plan, runs), 1e-9)))
        except Exception as e:
            out.append(Timing(name, 0.0, str(e).partition("\n")[0][:200]))
    return out


def choose_best(timings: list[Timing]) -> Timing | None:
    """The fastest one that runs."""
    found = [t for t in timings if t.rate > 0]
    return max(found, key=lambda t: t.rate) if found else None


def frame(spark: SparkSession, rows: int, **columns: str) -> DataFrame:
    """A generated table for timing: x from 0, and columns as expressions over it."""
    return spark.range(rows).select(F.col("id").alias("x"), *[F.expr(e).alias(n) for n, e in columns.items()])


#: Shapes of the columns that functions are timed on.
FRAMES = {
    "plain": {"s": "cast(x AS string)", "y": "x % 100003"},
    "nulls": {"maybe": "CASE WHEN x % 100 <> 0 THEN x END", "value": "x - 1000", "modulus": "x % 99 + 1"},
    "dates": {"day": "date_format(date_add(DATE '2000-01-01', cast(x % 9000 AS int)), 'yyyy-MM-dd')", "project": "concat('fund', x % 7, '::class', x % 11, '::', x)"},
    "money": {"amount": "x % 100000 / 100D", "currency": "element_at(array('EUR', 'USD', 'GBP', 'CHF'), cast(x % 4 + 1 AS int))"},
}


# Reports.


def to_markdown(df: DataFrame) -> str:
    """The rows of a report as a table; for results of bounded size."""
    spell = lambda v: "" if v is None else f"{v:,.1f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[spell(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def to_csv(df: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(df.collect())
    return out.getvalue()
