"""Finds UDFs in Python source files by reading them; nothing is imported or run.

Names are followed by what they are bound to: ``from pyspark.sql.functions import udf as u`` makes ``u`` the
decorator, another ``udf`` isn't. What can't be rewritten is reported with a reason.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import json
import os
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .canonical import key_of_source
from .types import UnknownType, kind_of, normal, of_annotation

VERSION = 1
SCHEMA = "path string, line int, name string, source string, params string, returns string, captures string, reason string"
#: Spark's type classes and the names that its DDL has for them.
TYPE_CLASSES = {
    "LongType": "bigint", "IntegerType": "int", "ShortType": "smallint", "ByteType": "tinyint", "DoubleType": "double", "FloatType": "float",
    "StringType": "string", "BooleanType": "boolean", "BinaryType": "binary", "TimestampType": "timestamp", "TimestampNTZType": "timestamp_ntz",
}
FUNCTIONS = "pyspark.sql.functions"


@dataclass(frozen=True)
class Found:
    """A UDF; ``reason`` says why it is skipped, and is empty if it can be rewritten."""

    path: str
    line: int
    name: str
    source: str = ""
    params: str = "[]"
    returns: str = ""
    captures: str = "{}"
    reason: str = ""

    def key(self, spark_version: str) -> str:
        return key_of_source(self.source, json.loads(self.params), self.returns, spark_version, json.loads(self.captures))


class Skip(Exception):
    """A UDF that isn't rewritten."""


class _Module:
    """What a module's names are bound to at its top level."""

    def __init__(self, tree: ast.Module):
        self.modules: dict[str, str] = {}  # name -> the module it stands for
        self.imported: dict[str, str] = {}  # name -> module.attribute
        self.defs: dict[str, ast.FunctionDef] = {}
        self.values: dict[str, ast.expr] = {}
        self.methods = {f.name for c in tree.body if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, ast.FunctionDef)}
        bound: Counter[str] = Counter()
        for node in tree.body:
            match node:
                case ast.Import(names=names):
                    for a in names:
                        self.modules[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
                        bound[a.asname or a.name.partition(".")[0]] += 1
                case ast.ImportFrom(module=module, names=names, level=0):
                    for a in names:
                        self.imported[a.asname or a.name] = f"{module}.{a.name}"
                        bound[a.asname or a.name] += 1
                case ast.FunctionDef(name=name):
                    self.defs[name] = node
                    bound[name] += 1
                case ast.ClassDef(name=name):
                    bound[name] += 1
                case ast.Assign(targets=targets, value=value):
                    for t in targets:
                        for x in ast.walk(t):
                            if isinstance(x, ast.Name):
                                self.values[x.id] = value
                                bound[x.id] += 1
                case ast.AnnAssign(target=ast.Name(id=name), value=value):
                    self.values[name] = value
                    bound[name] += 1
                case ast.If() | ast.Try() | ast.For() | ast.While() | ast.With():
                    for x in ast.walk(node):
                        if isinstance(x, (ast.FunctionDef, ast.ClassDef)):
                            bound[x.name] += 2
                        elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                            bound[x.id] += 2
        self.bound = bound

    def qualified(self, node: ast.expr) -> str:
        """The dotted name that an expression stands for, as far as imports tell."""
        match node:
            case ast.Name(id=name):
                return self.imported.get(name) or self.modules.get(name, "")
            case ast.Attribute(value=value, attr=attr):
                owner = self.qualified(value)
                return f"{owner}.{attr}" if owner else ""
        return ""

    def is_udf(self, node: ast.expr) -> bool:
        return self.qualified(node) in (f"{FUNCTIONS}.udf", "pyspark.sql.functions.builtin.udf")

    def is_vector_udf(self, node: ast.expr) -> bool:
        return self.qualified(node) in (f"{FUNCTIONS}.pandas_udf", f"{FUNCTIONS}.arrow_udf", f"{FUNCTIONS}.udtf", f"{FUNCTIONS}.arrow_udtf")

    # Types.

    def returns(self, node: ast.expr | None) -> str:
        """The DDL of a return type: a string, a type class, an ArrayType of one, or a name bound once to such."""
        match node:
            case None:
                return "string"
            case ast.Constant(value=str() as ddl):
                return self.atomic(ddl)
            case ast.Name(id=name) if self.bound[name] == 1 and name in self.values:
                return self.returns(self.values[name])
            case ast.Call(func=func, args=args):
                cls = self.qualified(func).rpartition(".")[2] or (func.id if isinstance(func, ast.Name) else "")
                if cls == "ArrayType" and args:
                    return f"array<{self.returns(args[0])}>"
                if cls == "DecimalType":
                    size = [a.value for a in args if isinstance(a, ast.Constant)]
                    return normal(f"decimal({','.join(map(str, size))})" if len(size) == 2 else "decimal")
                if cls in TYPE_CLASSES:
                    return TYPE_CLASSES[cls]
            case ast.Name() | ast.Attribute():
                cls = self.qualified(node).rpartition(".")[2]
                if cls in TYPE_CLASSES:
                    return TYPE_CLASSES[cls]
        raise Skip("non-atomic return")

    @staticmethod
    def atomic(ddl: str) -> str:
        try:
            out = normal(ddl)
        except UnknownType as e:
            raise Skip("non-atomic return") from e
        if kind_of(out) == "map":
            raise Skip("non-atomic return")
        return out

    # What a function takes from outside.

    def captures(self, node: ast.FunctionDef) -> dict[str, str]:
        inner = [x for statement in node.body for x in ast.walk(statement)]
        own = {a.arg for a in node.args.args} | {x.id for x in inner if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)} | {node.name}
        local = {a.asname or a.name.partition(".")[0] for x in inner if isinstance(x, (ast.Import, ast.ImportFrom)) for a in x.names}
        out = {}
        for x in inner:
            if not isinstance(x, ast.Name) or not isinstance(x.ctx, ast.Load) or x.id in own | local or x.id in out:
                continue
            if self.bound[x.id] == 0 and hasattr(builtins, x.id):
                continue
            value = self.values.get(x.id)
            if x.id in self.modules and self.modules[x.id].split(".")[0] in sys.stdlib_module_names:
                out[x.id] = f"module {self.modules[x.id]}"
            elif value is not None and self.bound[x.id] == 1 and self.literal(value):
                out[x.id] = repr(ast.literal_eval(value))
            else:
                raise Skip(f"captures {x.id}")
        return dict(sorted(out.items()))

    @staticmethod
    def literal(node: ast.expr) -> bool:
        try:
            return isinstance(ast.literal_eval(node), (bool, int, float, str, bytes, tuple, type(None)))
        except ValueError:
            return False

    # A function and its type, as a UDF.

    def function(self, node: ast.FunctionDef, returns: str, path: str) -> Found:
        a = node.args
        if a.defaults or a.kw_defaults or a.vararg or a.kwarg or a.kwonlyargs or a.posonlyargs:
            raise Skip("defaults or variable parameters")
        if not a.args:
            raise Skip("no parameters")
        params = []
        for arg in a.args:
            try:
                params.append([arg.arg, of_annotation(ast.unparse(arg.annotation)) if arg.annotation else ""])
            except UnknownType as e:
                raise Skip("untyped") from e
        if not all(t for _, t in params):
            raise Skip("untyped")
        captured = self.captures(node)
        bare = ast.FunctionDef(node.name, node.args, node.body, [], node.returns, None, type_params=[])
        return Found(path, node.lineno, node.name, ast.unparse(ast.fix_missing_locations(bare)), json.dumps(params), returns, json.dumps(captured))

    def named(self, node: ast.expr) -> ast.FunctionDef:
        """The definition that a UDF's first argument names."""
        match node:
            case ast.Lambda():
                raise Skip("lambda")
            case ast.Name(id=name) if name in self.defs and self.bound[name] == 1:
                return self.defs[name]
            case ast.Name(id=name) if name in self.imported:
                raise Skip("other module")
            case ast.Name(id=name) if self.bound[name] > 1:
                raise Skip("multiply bound")
            case ast.Attribute(value=value, attr=attr):
                raise Skip("other module" if self.qualified(value) else "method")
        raise Skip("not a function of this module")


def _returns_of(call: ast.Call, at: int) -> ast.expr | None:
    for k in call.keywords:
        if k.arg == "returnType":
            return k.value
        if k.arg == "useArrow" and not (isinstance(k.value, ast.Constant) and not k.value.value):
            raise Skip("Arrow")
    return call.args[at] if len(call.args) > at else None


def extract(text: str, path: str = "") -> list[Found]:
    """All UDFs of a source text; a text that doesn't parse gives one row that says so."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [Found(path, getattr(e, "lineno", None) or 0, "", reason="does not parse")]
    module, out = _Module(tree), []
    random = {id(x.func.value) for x in ast.walk(tree) if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "asNondeterministic"}
    inside = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}

    def add(line: int, name: str, make) -> None:
        try:
            out.append(make())
        except Skip as e:
            out.append(Found(path, line, name, reason=str(e)))

    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            for d in node.decorator_list:
                head = d.func if isinstance(d, ast.Call) else d
                if module.is_vector_udf(head):
                    out.append(Found(path, node.lineno, node.name, reason="Arrow"))
                if not module.is_udf(head):
                    continue

                def decorated(node=node, d=d) -> Found:
                    if id(node) in inside:
                        raise Skip("method")
                    if len(node.decorator_list) > 1:
                        raise Skip("another decorator")
                    if module.bound[node.name] != 1:
                        raise Skip("multiply bound")
                    kind = _returns_of(d, 0) if isinstance(d, ast.Call) else d if isinstance(d, ast.Constant) else None
                    return module.function(node, module.returns(kind), path)

                add(node.lineno, node.name, decorated)
        elif isinstance(node, ast.Call) and node.args:
            first = None
            if module.is_udf(node.func) and not isinstance(node.args[0], ast.Constant) and not (isinstance(node.args[0], ast.Call) or module.qualified(node.args[0]).startswith("pyspark.")):
                first, at = node.args[0], 1
            elif module.is_vector_udf(node.func) and isinstance(node.args[0], (ast.Name, ast.Lambda)):
                out.append(Found(path, node.lineno, ast.unparse(node.args[0]), reason="Arrow"))
            elif isinstance(node.func, ast.Attribute) and node.func.attr == "register" and isinstance(node.func.value, ast.Attribute) and node.func.value.attr == "udf" and len(node.args) > 1:
                first, at = node.args[1], 2
            if first is None:
                continue
            if isinstance(first, ast.Name) and first.id in module.values and isinstance(module.values[first.id], ast.Call) and module.is_udf(module.values[first.id].func):
                continue  # a UDF made elsewhere, and reported there

            def called(node=node, first=first, at=at) -> Found:
                if id(node) in random:
                    raise Skip("nondeterministic")
                kind = _returns_of(node, at)
                found = module.named(first)
                if found.decorator_list:
                    raise Skip("another decorator")
                return module.function(found, module.returns(kind), path)

            add(node.lineno, ast.unparse(first)[:80], called)
    return sorted(out, key=lambda f: (f.line, f.name))


def walk(paths: list[str]) -> Iterator[str]:
    """Python files under paths, without hidden folders."""
    for path in paths:
        if os.path.isfile(path):
            yield path
        for folder, names, files in os.walk(path):
            names[:] = sorted(n for n in names if not n.startswith(".") and n not in ("__pycache__", "node_modules", "site-packages"))
            yield from (os.path.join(folder, f) for f in sorted(files) if f.endswith(".py"))


def digest(text: str, spark_version: str) -> str:
    return hashlib.sha256(f"{VERSION}\0{spark_version}\0{text}".encode()).hexdigest()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All UDFs of the Python files under a path that Spark can read, found by the executors."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.py", recursiveFileLookup=True).select("value", "_metadata.file_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1)):
                rows = [astuple(f) for f in extract(text.as_py(), name.as_py())]
                if rows:
                    columns = [pa.array(c, pa.int32() if i == 1 else pa.string()) for i, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInArrow(run, SCHEMA)
