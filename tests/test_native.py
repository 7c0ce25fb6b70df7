"""Lowering, serving, verification, the corpus and its queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomix.canonical import NotKeyable, canonical_source, captures, key
from loomix.functions import NEAR, corpus, scalars
from loomix.java import Rejected, compile_jar, wrap
from loomix.lowering import Decline, lower
from loomix.serve import bind, native_udf, served_kind
from loomix.types import UnknownType, normal, of_annotation, signature
from loomix.verify import verify

PYTHON = {"kms_encrypt", "always_decline", "pymap_to_json", "casefold_lower", "float_str"}


def test_corpus_is_native():
    assert {n for n, f in corpus().items() if not f.native} == PYTHON


@pytest.mark.parametrize("name", sorted(set(corpus()) - PYTHON - {"np_exp", "udfb_converttoeuro"}))
def test_rewrites_equal_python(spark, name):
    report = verify(spark, corpus()[name], draws=40, tolerance=NEAR.get(name, 0))
    assert report.ok, report.problems


def test_currency_with_samples(spark):
    samples = [(10.0, c) for c in ("EUR", "USD", "GBP", "CHF")] + [(None, "EUR"), (1.0, None)]
    assert verify(spark, corpus()["udfb_converttoeuro"], samples).ok


def mutant(fn, sql):
    return native_udf(sql=sql)(fn)


MUTANTS = [
    (scalars.mod_bucket, "value % modulus"), (scalars.mod_bucket, "pmod(value, modulus)"),
    (scalars.round_half, "cast(round(x) AS bigint)"), (scalars.zfill3, "lpad(s, 3, '0')"), (scalars.pad_left5, "lpad(s, 5, '0')"),
    (scalars.split_dot, "split(s, '.')"), (scalars.trim_whitespace, "trim(s)"), (scalars.spark_str, "cast(x AS string)"),
    (scalars.spark_eq, "a = b"), (scalars.is_none_branch, "x"), (scalars.weekday_of, "cast(dayofweek(ts) AS bigint)"),
    (scalars.floor_div, "x div y"), (scalars.tpcds_in_quarter, "moy BETWEEN start_moy AND start_moy + span"),
    (scalars.tpcds_below_threshold, "CASE WHEN avg > 0 THEN revenue <= 0.1D * avg END"), (scalars.title_case, "initcap(s)"),
    (scalars.common_round2, "round(x, 2)"), (scalars.bool_str, "cast(b AS string)"), (scalars.contains_ingredient, "contains(lower(text), needle)"),
]


@pytest.mark.parametrize("k", range(len(MUTANTS)))
def test_lookalikes_are_rejected(spark, k):
    native, sql = MUTANTS[k]
    assert not verify(spark, mutant(native.fn, sql), draws=20).ok


def halve(x: int) -> int:
    return None if x is None else x // 2


def first_known(x: int, y: int) -> int:
    return x if x is not None else y


def strict_and(a: bool, b: bool) -> bool:
    if a is None or b is None:
        return None
    return a and b


def next_one(x: int) -> int:
    return None if x is None else x + 1


def double(x: int) -> int:
    return None if x is None else x * 2


def negated(x: int) -> int:
    return None if x is None else -x


def to_even(x):
    import decimal

    return None if x is None else x.quantize(decimal.Decimal(1), rounding=decimal.ROUND_HALF_EVEN)


def itself(x):
    return x


#: Function, types, result, the right SQL, and wrong ones.
CASES = [
    (halve, ["bigint"], "bigint", "CASE WHEN x < 0 AND x % 2 <> 0 THEN x div 2 - 1 ELSE x div 2 END", ["x div 2"]),
    (first_known, ["bigint"] * 2, "bigint", "coalesce(x, y)", ["x", "coalesce(y, x)"]),
    (strict_and, ["boolean"] * 2, "boolean", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a AND b END", ["a AND b"]),
    (next_one, ["int"], "bigint", "cast(x AS bigint) + 1", ["x + 1"]),
    (double, ["tinyint"], "int", "cast(x AS int) * 2", ["x * cast(2 AS tinyint)"]),
    (negated, ["smallint"], "int", "-cast(x AS int)", ["-x"]),
    (to_even, ["decimal(10,2)"], "decimal(10,0)", "bround(x, 0)", ["round(x, 0)", "floor(x)"]),
    (itself, ["decimal(38,18)"], "decimal(38,18)", "x", ["cast(x AS decimal(38,0))"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_mutants_die_on_edge_values(spark, k):
    fn, types, returns, right, wrong = CASES[k]
    assert verify(spark, native_udf(returns, inputs=types, sql=right)(fn), draws=1).ok
    for sql in wrong:
        assert not verify(spark, native_udf(returns, inputs=types, sql=sql)(fn), draws=1).ok, sql


def test_decimals_are_lowered_as_far_as_they_stay_themselves(spark):
    native = native_udf("decimal(10,2)", inputs=["decimal(10,2)"])(itself)
    assert native.native and verify(spark, native, draws=5).ok
    with pytest.raises(Decline):
        lower(next_one, signature(next_one, "decimal(10,2)", ["decimal(10,2)"]))


def member(x: str, items: list[str]) -> bool:
    return x in items


def seconds_from(start: str, n: int) -> list[str]:
    from datetime import datetime, timedelta

    try:
        begin = datetime.strptime(start, "%Y-%m-%d %H:%M:%S")
        return [str(begin + timedelta(seconds=i)) for i in range(n + 1)] if n < 100 else []
    except Exception:
        return []


_STEPS = "transform(sequence(0, cast(n AS int)), i -> date_format(timestampadd(SECOND, i, {t}), 'yyyy-MM-dd HH:mm:ss'))"
_PARSED = "try_to_timestamp(start, 'yyyy-MM-dd HH:mm:ss')"
_GOOD = f"CASE WHEN {_PARSED} IS NULL OR n IS NULL OR n < 0 OR n >= 100 THEN array() ELSE {_STEPS.format(t=_PARSED)} END"


def digits_of(s: str) -> str:
    import re

    return re.sub(r"\d", "#", s)


def after_astral(s: str) -> str:
    import re

    return re.sub("(?<=🎉)x", "y", s)


def first_line(s: str) -> bool:
    import re

    return re.search("^a.$", s) is not None


LOOKALIKES = [
    (member, "exists(items, e -> e <=> x)", ["array_contains(items, x)"], [("a", ["a", None]), (None, ["a", None]), (None, ["a"]), ("b", [None])]),
    (seconds_from, _GOOD.replace("array()", "cast(array() AS array<string>)"), [
        _GOOD.replace("array()", "cast(NULL AS array<string>)"),
        _GOOD.replace("array()", "cast(array() AS array<string>)").replace("sequence(0, cast(n AS int))", "sequence(0, greatest(cast(n AS int) - 1, 0))"),
        _GOOD.replace("array()", "cast(array() AS array<string>)").replace(_PARSED, "try_cast(start AS timestamp)"),
    ], [("2024-01-01 00:00:00", 3), ("2024-01-01", 2), ("bad", 1), (None, 1), ("2024-01-01 00:00:00", None), ("2024-02-30 00:00:00", 1)]),
    (digits_of, r"regexp_replace(s, '[\\p{Nd}]', '#')", [r"regexp_replace(s, '\\d', '#')"], [("a1",), ("\uff11",)]),
    (after_astral, "regexp_replace(s, '(?<=🎉)x', 'y')", ["replace(s, '🎉x', 'yx')"], [("🎉x",)]),
    (first_line, "s rlike '(?d)^a.$'", ["s rlike '^a.$'"], [("ab",), ("a\r",), ("ab\n",), ("ab\u2028",), ("ab\r",)]),
]


@pytest.mark.parametrize("k", range(len(LOOKALIKES)))
def test_more_lookalikes(spark, k):
    fn, right, wrong, samples = LOOKALIKES[k]
    good = verify(spark, native_udf(sql=right)(fn), samples, draws=10)
    assert good.ok, good.problems
    for sql in wrong:
        assert not verify(spark, native_udf(sql=sql)(fn), samples, draws=10).ok, sql


def test_upper_is_not_initcap(spark):
    assert not verify(spark, native_udf(sql="initcap(useragent)")(scalars.upper_useragent.fn)).ok


def test_guards_may_only_be_left_out_where_nulls_spread(spark):
    """A leading guard is right but slow; without it the common part is computed once."""
    for sql in ("upper(s)", "CASE WHEN s IS NULL THEN NULL ELSE upper(s) END"):
        assert verify(spark, native_udf(sql=sql)(shout_known), draws=5).ok


def shout_known(s: str) -> str:
    return None if s is None else s.upper()


def test_the_deadline_holds_for_all_jobs(spark):
    import time

    slow = native_udf(java_body="if (x != null && x == 7) { long k = 0; while (k >= 0) k = (k + 1) & 0xFFFFFF; } return x;")(same_one)
    began = time.time()
    report = verify(spark, slow, draws=5, timeout=4)
    assert not report.ok and "more than 4 s" in report.problems[0] and time.time() - began < 40


def same_one(x: int) -> int:
    return x


def test_lowering_of_more_constructs(spark):
    def negative(x: int) -> int:
        return -x

    def truth(s: str, n: int) -> bool:
        return not s or bool(n)

    def pieces(x: int) -> int:
        return ~x + (x >> 1)

    for fn in (negative, truth, pieces):
        native = native_udf()(fn)
        assert native.native and verify(spark, native, draws=30).ok, fn.__name__

    source = "def wide(x: int) -> int:\n" + "".join(f"    if x > {i}:\n        y = {i}\n    else:\n        y = 0\n" for i in range(14)) + "    return y\n"
    from loomix.canonical import load

    with pytest.raises(Decline, match="too many paths"):
        lower(load(source, {}), signature(load(source, {})))


def test_verdicts_are_of_this_corpus():
    from loomix.serve import verdicts

    assert {n for n, f in corpus().items() if f.native and f.digest() not in verdicts()} == set()


def plus(x: int, y: int) -> int:
    return x + y


def test_gates():
    def untyped(x):
        return x

    def default(x: int = 1) -> int:
        return x

    for fn in (untyped, default):
        with pytest.raises(UnknownType):
            signature(fn)
    assert normal("ARRAY< long >") == "array<bigint>" and of_annotation(dict[str, str]) == "map<string,string>"
    assert signature(plus, inputs=["int", "tinyint"]).types == ["int", "tinyint"]


OUTSIDE = object()


def test_keys():
    def helper(x: int) -> int:
        return OUTSIDE

    with pytest.raises(NotKeyable):
        captures(helper)
    sig = signature(plus)
    assert key(plus, sig, "4.1.2") != key(plus, sig, "4.1.3")
    assert "native_udf" not in canonical_source(scalars.plus_one.fn)


def test_declines():
    def loop(n: int) -> int:
        while n > 1:
            n -= 1
        return n

    def mixed(a: str, b: int) -> bool:
        return a < b

    def power(a: int, b: int) -> int:
        return a**b

    for fn in (loop, mixed, power):
        with pytest.raises(Decline):
            lower(fn, signature(fn))


def test_binding_of_many_placeholders():
    assert bind("_p1 + _p10", [f"c{i}" for i in range(11)]) == "c1 + c10"


def test_fail_open(spark):
    native = corpus()["casefold_lower"]
    df = spark.createDataFrame([("Straße",)], "s string").select(native("s").alias("r"))
    assert df.first().r == "strasse" and served_kind(df) == "python"


def test_java_limits(spark):
    cls, source = wrap("Runtime.getRuntime().exit(1); return x;", [("x", "bigint")], "bigint")
    with pytest.raises(Rejected):
        compile_jar(spark, cls, source)
    assert wrap("return x;", [("x", "bigint")], "bigint")[0] != wrap("return x ;", [("x", "bigint")], "bigint")[0]


def test_predicates_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = df.where(scalars.plus_one(F.col("l_partkey")) > 5).where(scalars.common_discount_price(F.col("l_discount"), F.lit(0.0)) > 0.05)
    assert served_kind(plan) == "native"
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where(scalars.common_is_adult(F.col("p_retailprice").cast("long")))
    assert served_kind(part) == "native"
    df = df.where(native_udf(inputs=["int", "int"])(at_least)("l_linenumber", F.lit(3)))
    assert "PushedFilters: [IsNotNull(l_linenumber), GreaterThanOrEqual(l_linenumber,3)]" in df._jdf.queryExecution().toString()


def at_least(x: int, y: int) -> bool:
    return x >= y





def test_queries_equal_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    oracle = __spark_entry__.oracle_sql()
    spell = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    for name, query in __spark_entry__.queries().items():
        if not name.startswith(("udf_", "plan_", "stream_")):
            continue
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted(tuple(map(spell, r)) for r in df.select(*columns).collect())
        if name in oracle:
            found = con.execute(oracle[name])
            at = [[d[0] for d in found.description].index(c) for c in columns]
            assert got == sorted(tuple(spell(r[i]) for i in at) for r in found.fetchall()), name
    assert __spark_entry__.entry(spark).count() > 0
