"""Finding UDFs in source texts, and advice about rewrites."""

import json

import pytest
from pyspark.sql import functions as F

from loomix import advise, extract
from loomix.functions import corpus, notes, scalars
from loomix.serve import native_udf

HEAD = """
import math
import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import functions as fn
from pyspark.sql.functions import udf, udf as u, pandas_udf
from pyspark.sql.types import *
from pyspark.sql.types import LongType, IntegerType, ArrayType, StringType, StructType
from helpers import clean
LIMIT = 7
NAMES = ("a", "b")
RESULT = LongType()
"""


def one(text, at=0):
    return extract.extract(HEAD + text)[at]


FOUND = [
    ('@udf("bigint")\ndef f(x: int) -> int:\n    return x + LIMIT', "bigint", {"LIMIT": "7"}),
    ("@udf\ndef f(x: str):\n    return x", "string", {}),
    ("@u(LongType())\ndef f(x: int):\n    return x", "bigint", {}),
    ("@F.udf(returnType=IntegerType())\ndef f(x: int):\n    return math.floor(x)", "int", {"math": "module math"}),
    ("@fn.udf(ArrayType(StringType()))\ndef f(x: str):\n    return [x]", "array<string>", {}),
    ("def f(x: int):\n    return x\ng = udf(f, RESULT)", "bigint", {}),
    ("def f(x: int):\n    return x\ng = F.udf(f, returnType='long')", "bigint", {}),
    ("def f(x: str) -> bool:\n    return x in NAMES\nspark.udf.register('f', f, 'boolean')", "boolean", {"NAMES": "('a', 'b')"}),
    ("def f(x: str):\n    import re\n    return re.sub('a', 'b', x)\ng = udf(f)", "string", {}),
]


@pytest.mark.parametrize("k", range(len(FOUND)))
def test_found(k):
    text, returns, captured = FOUND[k]
    found = one(text)
    assert (found.reason, found.name, found.returns, json.loads(found.captures)) == ("", "f", returns, captured)
    assert found.source.startswith("def f(x") and "udf" not in found.source and found.key("4.1.2") != found.key("4.1.3")


SKIPPED = [
    ("g = udf(lambda x: x, 'int')", "lambda"),
    ("class C:\n    @udf('int')\n    def f(self, x: int):\n        return x", "method"),
    ("class C:\n    def f(self, x: int):\n        return x\nc = C()\ng = udf(c.f, 'int')", "method"),
    ("g = udf(clean, 'int')", "other module"),
    ("g = udf(np.sqrt, 'double')", "other module"),
    ("if LIMIT:\n    def f(x: int):\n        return x\nelse:\n    def f(x: int):\n        return -x\ng = udf(f, 'int')", "multiply bound"),
    ("def f(x: int):\n    return x\ndef f(x: int):\n    return -x\ng = udf(f, 'int')", "multiply bound"),
    ("@udf('int', useArrow=True)\ndef f(x: int):\n    return x", "Arrow"),
    ("@pandas_udf('int')\ndef f(x):\n    return x", "Arrow"),
    ("def f(x: int):\n    return x\ng = udf(f, 'int').asNondeterministic()", "nondeterministic"),
    ("@udf('int')\ndef f(x: int = 1):\n    return x", "defaults or variable parameters"),
    ("@udf('int')\ndef f(*x):\n    return x", "defaults or variable parameters"),
    ("@udf('int')\ndef f():\n    return 1", "no parameters"),
    ("@udf('a int, b int')\ndef f(x: int):\n    return x", "non-atomic return"),
    ("@udf(StructType())\ndef f(x: int):\n    return x", "non-atomic return"),
    ("@udf('map<string,string>')\ndef f(x: int):\n    return x", "non-atomic return"),
    ("import functools\n@udf('int')\n@functools.cache\ndef f(x: int):\n    return x", "another decorator"),
    ("@udf('int')\ndef f(x):\n    return x", "untyped"),
    ("def helper(x):\n    return x\n@udf('int')\ndef f(x: int):\n    return helper(x)", "captures helper"),
    ("@udf('double')\ndef f(x: float):\n    return np.sqrt(x)", "captures np"),
]


@pytest.mark.parametrize("k", range(len(SKIPPED)))
def test_skipped(k):
    text, reason = SKIPPED[k]
    assert one(text).reason == reason


def test_other_names_are_not_udfs():
    assert extract.extract("def udf(f):\n    return f\n@udf\ndef f(x: int):\n    return x\n") == []
    assert extract.extract("from elsewhere import udf\n@udf\ndef f(x: int):\n    return x\n") == []
    assert extract.extract("x = register('a', 1)") == []
    (bad,) = extract.extract("def f(:\n")
    assert bad.reason == "does not parse"


def test_a_registered_udf_is_reported_once():
    found = extract.extract(HEAD + "def f(x: int):\n    return x\ng = udf(f, 'int')\nspark.udf.register('g', g)\n")
    assert [x.name for x in found] == ["f"]


def test_scan_reads_without_importing(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.py").write_text(HEAD + FOUND[0][0] + "\nraise SystemExit('imported')\n")
    (tmp_path / "a" / "b" / "two.py").write_text(HEAD + SKIPPED[0][0])
    (tmp_path / "a" / "note.txt").write_text("@udf")
    rows = extract.scan(spark, str(tmp_path / "a")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.name, r.reason) for r in rows) == [("one.py", "f", ""), ("two.py", "lambda x: x", "lambda")]
    assert [p.rsplit("/", 1)[1] for p in extract.walk([str(tmp_path)])] == ["one.py", "two.py"]
    assert extract.scan(spark, str(tmp_path / "a")).groupBy("reason").count().count() == 2


# Advice.


def regex_loop(s: str) -> str:
    import re

    for p in ("a", "b", "c"):
        s = re.sub(p, "", s)
    return re.sub("d", "", s) if re.search("e", s) else s


def test_regex_calls():
    assert advise.python_regex_calls(regex_loop) == 5
    assert advise.python_regex_calls(scalars.plus_one.fn) == 0
    assert advise.python_regex_calls(corpus()["extract_domain"].fn) == 1
    assert advise.python_regex_calls(notes.fhi_clean_health_history.fn) == 1


def test_risk():
    see = lambda f: advise.regression_risk(f).verdict
    assert see(scalars.plus_one) == advise.OK
    assert see(corpus()["casefold_lower"]) == advise.NOT_SERVED
    assert see(scalars.longest_digit_run) == advise.AT_RISK  # an array of characters
    assert see(native_udf(sql="regexp_replace(regexp_replace(regexp_replace(s, 'a', ''), 'b', ''), 'c', '')")(bare)) == advise.LIKELY
    assert see(native_udf(sql="btrim(s)")(bare)) == advise.OK


def bare(s: str) -> str:
    return s.strip()


def test_timing(spark):
    df = advise.frame(spark, 20_000, **advise.FRAMES["plain"]).cache()
    found = advise.benchmark_all(df, {"native": "length(s)", "broken": "length(", "hidden": corpus()["casefold_lower"]("s"), "python": F.udf(len, "int")("s")}, runs=1)
    rate = {t.name: t.rate for t in found}
    assert rate["native"] > 0 and rate["python"] > 0 and rate["broken"] == rate["hidden"] == 0
    assert advise.choose_best(found).name in ("native", "python") and advise.choose_best([t for t in found if not t.rate]) is None
    assert {t.name: t.error for t in found}["hidden"] == "runs as Python"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1234.5), ("b|c", None)], "name string, rate double")
    assert advise.to_markdown(df) == "| name | rate |\n| - | - |\n| a | 1,234.5 |\n| b\\|c |  |\n"
    assert advise.to_csv(df) == "name,rate\na,1234.5\nb|c,\n"
    df.write.mode("append").csv(str(tmp_path / "r"), header=True)
    df.write.mode("append").csv(str(tmp_path / "r"), header=True)
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 4
    for kind in ("json", "orc", "parquet"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2


def test_frames(spark):
    for name, columns in advise.FRAMES.items():
        assert advise.frame(spark, 10, **columns).columns == ["x", *columns], name
    assert advise.frame(spark, 200, **advise.FRAMES["nulls"]).where("maybe is null").count() == 2
