"""A function's identity: canonical source, captures, and the key of its rewrite."""

from __future__ import annotations

import ast
import builtins
import hashlib
import inspect
import json
import linecache
import sys
import textwrap
import types

from .types import Signature


class NotKeyable(ValueError):
    """The function depends on something that can't be part of a key."""


def definition(fn) -> ast.FunctionDef:
    """The function's definition, without its decorators and annotations of other modules."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    except (OSError, TypeError, SyntaxError) as e:
        raise NotKeyable("no source") from e
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef) and node.name == fn.__name__:
            node.decorator_list = []
            return node
    raise NotKeyable("not a plain function")


def canonical_source(fn) -> str:
    """The definition in one spelling: comments, layout and decorators don't count."""
    return ast.unparse(definition(fn))


def captures(fn) -> dict:
    """What the function takes from outside: name -> literal or module name; NotKeyable for anything else."""
    names = inspect.getclosurevars(fn)
    found = {}
    for name, value in sorted({**names.globals, **names.nonlocals}.items()):
        if isinstance(value, types.ModuleType):
            if value.__name__.split(".")[0] not in sys.stdlib_module_names:
                raise NotKeyable(f"{name} is a module outside the standard library")
            found[name] = f"module {value.__name__}"
        elif _literal(value):
            found[name] = repr(value)
        elif getattr(builtins, name, None) is not value:
            raise NotKeyable(f"{name} is neither a literal nor a standard module")
    return found


def literals(fn) -> dict:
    """The captured values that may stand in for their names in a rewrite."""
    names = inspect.getclosurevars(fn)
    return {k: v for k, v in {**names.globals, **names.nonlocals}.items() if _literal(v)}


def _literal(value) -> bool:
    if isinstance(value, tuple):
        return all(_literal(x) for x in value)
    return value is None or isinstance(value, (bool, int, float, str, bytes))


def key(fn, sig: Signature, spark_version: str) -> str:
    """Changes with anything that could change the function's results or its rewrite."""
    return key_of_source(canonical_source(fn), [list(p) for p in sig.params], sig.returns, spark_version, captures(fn))


def fingerprint(fn, seen: frozenset = frozenset()) -> str:
    """A digest of a function's source and of all it takes from outside, helpers of its own module included."""
    names = inspect.getclosurevars(fn)
    parts = [canonical_source(fn)]
    for name, value in sorted({**names.globals, **names.nonlocals}.items()):
        if isinstance(value, types.FunctionType) and value.__module__ == fn.__module__ and name not in seen:
            parts.append(f"{name} {fingerprint(value, seen | {name, fn.__name__})}")
        elif isinstance(value, types.ModuleType):
            parts.append(f"{name} module {value.__name__}")
        else:
            parts.append(f"{name} {value!r}")
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def load(source: str, captured: dict):
    """The function that a canonical source defines; captured: name -> literal's spelling or ``module ...``."""
    space: dict = {"datetime": __import__("datetime").datetime}
    for name, value in captured.items():
        if value.startswith("module "):
            module = value[7:]
            if module.split(".")[0] not in sys.stdlib_module_names:
                raise NotKeyable(f"{module} is a module outside the standard library")
            __import__(module)
            space[name] = sys.modules[module]
        else:
            space[name] = ast.literal_eval(value)
    tree = ast.parse(source)
    if len(tree.body) != 1 or not isinstance(tree.body[0], ast.FunctionDef):
        raise NotKeyable("not a plain function")
    code = compile(tree, f"<{tree.body[0].name}>", "exec")
    linecache.cache[f"<{tree.body[0].name}>"] = (len(source), None, source.splitlines(True), f"<{tree.body[0].name}>")
    exec(code, space)  # noqa: S102  the caller's own function
    return space[tree.body[0].name]


def key_of_source(source: str, params: list, returns: str, spark_version: str, captured: dict) -> str:
    return hashlib.sha256("\0".join([source, json.dumps(params), returns, spark_version, json.dumps(captured)]).encode()).hexdigest()
