"""What makes rewrites: the lowering rules, a registry of given ones, an outside command, and chains of these.

A producer returns a Rewrite, declines (it won't change its mind before the cooldown is over), or fails in
passing (it may be asked again).
"""

from __future__ import annotations

import json
import os
import shlex
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from . import java
from .canonical import canonical_source
from .lowering import Decline, lower
from .serve import Rewrite
from .types import Signature


class Trouble(Exception):
    """A producer couldn't be asked just now."""


@dataclass(frozen=True)
class Lowering:
    """The rules over the syntax tree."""

    name: str = "lowering"

    def __call__(self, fn, sig: Signature) -> Rewrite:
        return Rewrite("sql", lower(fn, sig))


class Registry:
    """Given rewrites, found by a function's canonical source and its types, whatever its name's origin."""

    name = "registry"

    def __init__(self):
        self._held: dict[tuple[str, str], Rewrite] = {}

    def add(self, fn, sig: Signature, found: Rewrite) -> None:
        self._held[canonical_source(fn), str(sig)] = found

    def __call__(self, fn, sig: Signature) -> Rewrite:
        found = self._held.get((canonical_source(fn), str(sig)))
        if found is None:
            raise Decline("not in the registry")
        return found


@dataclass(frozen=True)
class Command:
    """An outside program that gets the function in a folder of its own, and leaves OUT.sql or OUT.java there or prints SQL.

    The folder holds FUNCTION.py and TASK.json (parameters, result). Exit code 3 declines; any other but 0 is trouble.
    """

    command: str
    timeout: float = 300
    name: str = "command"

    def available(self) -> bool:
        return bool(self.command) and shutil.which(shlex.split(self.command)[0]) is not None

    def __call__(self, fn, sig: Signature) -> Rewrite:
        if not self.available():
            raise Decline(f"no program {self.command!r}")
        with tempfile.TemporaryDirectory() as folder:
            with open(os.path.join(folder, "FUNCTION.py"), "w", encoding="utf-8") as f:
                f.write(canonical_source(fn))
            with open(os.path.join(folder, "TASK.json"), "w", encoding="utf-8") as f:
                json.dump({"params": sig.params, "returns": sig.returns}, f)
            try:
                said = subprocess.run(shlex.split(self.command), cwd=folder, capture_output=True, text=True, timeout=self.timeout, stdin=subprocess.DEVNULL)
            except subprocess.TimeoutExpired as e:
                raise Trouble(f"{self.command!r} took more than {self.timeout:g} s") from e
            if said.returncode == 3:
                raise Decline(said.stderr.strip()[:500] or "declined")
            if said.returncode:
                raise Trouble(said.stderr.strip()[:500] or f"exit code {said.returncode}")
            for name, kind in (("OUT.sql", "sql"), ("OUT.java", "java")):
                if os.path.exists(path := os.path.join(folder, name)):
                    with open(path, encoding="utf-8") as f:
                        return given(kind, f.read().strip(), sig)
            return given("sql", said.stdout.strip(), sig)


def given(kind: str, text: str, sig: Signature) -> Rewrite:
    """A rewrite from SQL, or from the body of a Java call()."""
    if not text:
        raise Decline("an empty answer")
    if kind == "java":
        cls, source = java.wrap(text, list(sig.params), sig.returns)
        return Rewrite("java", source, cls)
    return Rewrite("sql", text)


@dataclass(frozen=True)
class Chain:
    """Producers in order: the first answer counts. All declining is a decline; trouble of any is trouble, if none answers."""

    producers: tuple[Callable, ...]
    name: str = "chain"

    def ask(self, fn, sig: Signature) -> tuple[str, Rewrite]:
        """The answering producer's name, and its answer."""
        declined, trouble = [], []
        for p in self.producers:
            try:
                return p.name, p(fn, sig)
            except (Decline, ValueError) as e:
                declined.append(f"{p.name}: {e}")
            except Trouble as e:
                trouble.append(f"{p.name}: {e}")
        if trouble:
            raise Trouble("; ".join(trouble))
        raise Decline("; ".join(declined) or "no producer")

    def __call__(self, fn, sig: Signature) -> Rewrite:
        return self.ask(fn, sig)[1]


def automatic(candidates: list[str]) -> Command | None:
    """A command producer of the first program that is installed."""
    return next((c for c in map(Command, candidates) if c.available()), None)
