"""Types of UDF parameters and results: annotations, Spark types, categories and kinds."""

from __future__ import annotations

import datetime
import re
import typing
from dataclasses import dataclass

#: Kinds that the lowering rules tell apart.
BOOL, INT, FLOAT, DECIMAL, STRING, BINARY, TIME, ARRAY, MAP, NULL, ANY = "bool int float decimal string binary time array map null any".split()

_ANNOTATIONS = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary", datetime.datetime: "timestamp"}
_KIND = {
    "bigint": INT, "int": INT, "smallint": INT, "tinyint": INT, "double": FLOAT, "float": FLOAT, "string": STRING,
    "boolean": BOOL, "binary": BINARY, "timestamp": TIME, "timestamp_ntz": TIME,
}
_ALIASES = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "str": "string", "real": "float", "bool": "boolean"}
#: Parameter categories that are rewritten without being asked for.
DEFAULT_CATEGORIES = frozenset({"numeric", "string", "bool", "binary", "timestamp", "array", "map"})


class UnknownType(ValueError):
    """A parameter or result has no known Spark type."""


def normal(name: str) -> str:
    """The one spelling of a type name."""
    name = re.sub(r"\s+", "", name.strip().lower())
    if m := re.fullmatch(r"array<(.+)>", name):
        return f"array<{normal(m[1])}>"
    if m := re.fullmatch(r"map<([^,]+),(.+)>", name):
        return f"map<{normal(m[1])},{normal(m[2])}>"
    if re.fullmatch(r"decimal(\(\d+,\d+\))?", name):
        return name if "(" in name else "decimal(10,0)"
    name = _ALIASES.get(name, name)
    if name not in _KIND:
        raise UnknownType(name)
    return name


def kind_of(name: str) -> str:
    if name.startswith("array"):
        return ARRAY
    if name.startswith("map"):
        return MAP
    return DECIMAL if name.startswith("decimal") else _KIND[name]


def category(name: str) -> str:
    return {BOOL: "bool", STRING: "string", BINARY: "binary", TIME: "timestamp", ARRAY: "array", MAP: "map"}.get(kind_of(name), "numeric")


def of_annotation(annotation) -> str:
    """The Spark type that an annotation stands for."""
    if annotation in _ANNOTATIONS:
        return _ANNOTATIONS[annotation]
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin is list and len(args) == 1:
        return f"array<{of_annotation(args[0])}>"
    if origin is dict and len(args) == 2:
        return f"map<{of_annotation(args[0])},{of_annotation(args[1])}>"
    if isinstance(annotation, str):
        try:
            return of_annotation(eval(annotation, {"datetime": datetime.datetime}))  # noqa: S307  names of types only
        except (NameError, SyntaxError, TypeError) as e:
            raise UnknownType(annotation) from e
    raise UnknownType(repr(annotation))


def integer_range(name: str) -> tuple[int, int]:
    bits = {"bigint": 64, "int": 32, "smallint": 16, "tinyint": 8}[name]
    return -(2 ** (bits - 1)), 2 ** (bits - 1) - 1


@dataclass(frozen=True)
class Signature:
    """Parameter names with their types, and the type of the result."""

    params: tuple[tuple[str, str], ...]
    returns: str

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.params]

    @property
    def types(self) -> list[str]:
        return [t for _, t in self.params]


def signature(fn, returns: str | None = None, inputs: list[str] | None = None) -> Signature:
    """From annotations; ``returns`` and ``inputs`` take precedence."""
    code = fn.__code__
    if fn.__defaults__ or fn.__kwdefaults__ or code.co_flags & 0x0C or code.co_kwonlyargcount:
        raise UnknownType("defaults and variable parameters aren't rewritten")
    names = code.co_varnames[: code.co_argcount]
    hints = {n: a for n, a in fn.__annotations__.items()}
    kinds = [normal(t) for t in inputs] if inputs is not None else [of_annotation(hints[n]) if n in hints else _missing(n) for n in names]
    if len(kinds) != len(names):
        raise UnknownType(f"{len(names)} parameters but {len(kinds)} types")
    result = normal(returns) if returns else of_annotation(hints["return"]) if "return" in hints else _missing("return")
    return Signature(tuple(zip(names, kinds)), result)


def _missing(name: str) -> str:
    raise UnknownType(f"{name} has no annotation")
