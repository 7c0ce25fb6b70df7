"""Java UDFs compiled at run time, for loops that SQL has no form for."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import subprocess
import tempfile
import zipfile

import pyspark
from pyspark.sql import SparkSession

_BOXED = {"bigint": "Long", "int": "Integer", "smallint": "Short", "tinyint": "Byte", "double": "Double", "float": "Float", "string": "String", "boolean": "Boolean", "binary": "byte[]", "timestamp": "java.sql.Timestamp"}
#: What a generated class may not touch.
FORBIDDEN = re.compile(r"\b(Runtime|ProcessBuilder|Thread|ClassLoader|System\s*\.\s*(exit|load|loadLibrary|setProperty|getenv)|java\s*\.\s*(io|nio|net|lang\s*\.\s*reflect|util\s*\.\s*concurrent)|javax\s*\.|scala\s*\.\s*sys|sun\s*\.|jdk\s*\.|Unsafe|native|forName)\b")


class Rejected(ValueError):
    """The source doesn't compile or touches what it may not."""


def _blanked(source: str) -> str:
    """The source without the contents of strings and comments."""
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', '""', source, flags=re.S)


def boxed(kind: str) -> str:
    if kind.startswith("array"):
        return "scala.collection.Seq"
    return _BOXED[kind]


def wrap(body: str, params: list[tuple[str, str]], returns: str, members: str = "") -> tuple[str, str]:
    """(class name, source) of a UDF whose call runs ``body``; the name depends on all of it.

    A session keeps the first class of a name, so other contents must have another name.
    """
    args = ", ".join(f"{boxed(t)} {n}" for n, t in params)
    kinds = ", ".join([*(boxed(t) for _, t in params), boxed(returns)])
    shape = f"implements org.apache.spark.sql.api.java.UDF{len(params)}<{kinds}> {{\n{members}\npublic {boxed(returns)} call({args}) throws Exception {{\n{body}\n}}\n}}\n"
    name = "Loomix_" + hashlib.sha256(shape.encode()).hexdigest()[:20]
    return name, f"public class {name} {shape}"


#: Jars that this process has compiled, by class and source.
_jars: dict[tuple[str, str], str] = {}


@functools.lru_cache
def _folder() -> str:
    """A folder of this process alone; the driver serves the jars in it to the executors."""
    return tempfile.mkdtemp(prefix="loomix-java-")


def compile_jar(spark: SparkSession, name: str, source: str) -> str:
    """Path of a jar with the compiled class."""
    if found := FORBIDDEN.search(_blanked(source)):
        raise Rejected(f"{found[0]} isn't allowed")
    if (name, source) in _jars and os.path.exists(_jars[name, source]):
        return _jars[name, source]
    jar = os.path.join(_folder(), f"{name}.jar")
    with tempfile.TemporaryDirectory() as work:
        path = os.path.join(work, f"{name}.java")
        with open(path, "w", encoding="utf-8") as f:
            f.write(source)
        system = spark._jvm.java.lang.System
        compiler = os.path.join(system.getProperty("java.home"), "bin", "javac")
        if not os.path.exists(compiler):
            raise Rejected("no Java compiler")
        jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
        said = subprocess.run([compiler, "-encoding", "UTF-8", "-cp", f"{system.getProperty('java.class.path')}{os.pathsep}{jars}", "-d", work, "-nowarn", path], capture_output=True, text=True)
        if said.returncode:
            raise Rejected(said.stderr[:2000])
        draft = f"{jar}.draft"
        with zipfile.ZipFile(draft, "w") as z:
            for file in sorted(os.listdir(work)):
                if file.endswith(".class"):
                    z.write(os.path.join(work, file), file)
        os.replace(draft, jar)
    _jars[name, source] = jar
    return jar


def register(spark: SparkSession, name: str, cls: str, source: str, returns: str) -> None:
    """Makes the class a function of the session; the jar is served to executors."""
    spark.sql(f"ADD JAR '{compile_jar(spark, cls, source)}'")
    spark.udf.registerJavaFunction(name, cls, returns)
