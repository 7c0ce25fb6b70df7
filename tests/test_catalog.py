"""The catalog's states, sharing, approval, producers, sessions and command lines."""

import datetime
import decimal
import json
import threading

import pytest
from pyspark.sql import functions as F

import loomix
from loomix import api, approve, conf, prefill, producers, worker
from loomix.catalog import AWAITING, FAILED, PENDING, PROVISIONAL, RUNNING, SUCCESS, Catalog, Row, Shared, collect_stats, decode, encode, latest, merged, newest
from loomix.lowering import Decline
from loomix.serve import NativeFunction, Rewrite, served_kind
from loomix.types import signature


class Clock:
    now = 1000.0

    def __call__(self):
        self.now += 0.001
        return self.now


def row(key, **values):
    return Row(key, values.pop("name", key), "def f(x): ...", json.dumps([["x", "bigint"]]), "bigint", **values)


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def catalog(clock):
    out = Catalog(clock=clock, cooldown=100, max_retries=2, claim_timeout=50, max_samples=3)
    yield out
    out.close()


def test_life_of_a_row(catalog):
    assert catalog.lookup("a") == ("miss", None)
    assert catalog.insert_pending(row("a")) and not catalog.insert_pending(row("a")) and catalog.size() == 1
    assert catalog.lookup("a")[0] == "wait"
    assert catalog.claim("a") and not catalog.claim("a")
    assert catalog.get("a").status == RUNNING and catalog.get("a").attempts == 1
    assert catalog.mark_success("a", "sql", "x + 1", producer="lowering", agreed=7)
    assert catalog.get("a").status == PROVISIONAL and catalog.lookup("a")[0] == "wait"
    assert catalog.promote("a") and not catalog.promote("a")
    state, found = catalog.lookup("a")
    assert state == "hit" and (found.payload, found.producer, found.agreed) == ("x + 1", "lowering", 7)


def test_unknown_types_are_refused(catalog):
    for bad in (Row("a", params='[["x", ""]]', returns="bigint"), Row("a", params="[]")):
        with pytest.raises(ValueError):
            catalog.insert_pending(bad)


def test_only_one_claims(tmp_path):
    catalogs = [Catalog(str(tmp_path / "c.db")) for _ in range(6)]
    catalogs[0].insert_pending(row("a"))
    won = []
    threads = [threading.Thread(target=lambda c=c: won.append(c.claim("a"))) for c in catalogs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 5 + [True]


def test_failures_cool_down_and_end(catalog, clock):
    catalog.insert_pending(row("a"))
    for turn in range(2):
        assert catalog.claim("a")
        assert catalog.mark_failed("a", "wrong", "sql", "x - 1")
        assert catalog.get("a").payload == "x - 1" and catalog.lookup("a")[1].status == FAILED
        clock.now += 200
        assert catalog.lookup("a")[1].status == (PENDING if turn == 0 else FAILED)
    # Passing trouble uses up no attempt.
    catalog.insert_pending(row("b"))
    for _ in range(5):
        assert catalog.claim("b") and catalog.release("b", "no network")
        assert catalog.lookup("b")[1].status == FAILED
        clock.now += 200
        assert catalog.lookup("b")[1].status == PENDING


def test_lost_workers(catalog, clock):
    catalog.insert_pending(row("a"))
    catalog.claim("a")
    assert catalog.reclaim_stale() == 0
    clock.now += 60
    assert catalog.reclaim_stale() == 1 and catalog.get("a").status == PENDING
    catalog.claim("a")
    catalog.mark_success("a", "sql", "x")
    clock.now += 60
    assert catalog.reclaim_stale() == 1 and catalog.get("a").status == FAILED


def test_oldest_first(catalog):
    for k in "cab":
        catalog.insert_pending(row(k))
    seen = []
    while r := catalog.oldest_pending():
        seen.append(r.key)
        catalog.claim(r.key)
    assert seen == ["c", "a", "b"]


def test_tolerance_and_policy(catalog):
    catalog.upsert_success(row("a", kind="sql", payload="x", tolerance=0.1))
    catalog.promote("a")
    assert catalog.lookup("a", 0.1)[0] == "hit" and catalog.lookup("a", 0.01)[0] == "wait"
    assert catalog.get("a").status == PENDING
    catalog.upsert_success(row("b", kind="sql", payload="x"))
    catalog.promote("b")
    assert catalog.lookup("b", approval=True)[0] == "wait" and catalog.get("b").status == AWAITING
    assert [r.key for r in catalog.awaiting()] == ["b"]
    assert catalog.approve("b", "someone") and catalog.lookup("b", approval=True)[0] == "hit"


def test_rejection_is_final(catalog, clock):
    catalog.upsert_success(row("a", kind="sql", payload="x"))
    assert catalog.park("a") and catalog.reject("a", "someone", "unreadable")
    clock.now += 1000
    assert catalog.lookup("a")[1].status == FAILED and catalog.get("a").error == "unreadable"


def test_samples(catalog):
    for i in range(5):
        catalog.add_samples("a", [(i, "x")])
    catalog.add_samples("a", [(3, "x")])
    assert sorted(catalog.samples("a")) == [(2, "x"), (3, "x"), (4, "x")]
    args = (None, True, 1, 1.5, float("inf"), "é", b"\x00", datetime.datetime(2024, 2, 29, 1), decimal.Decimal("1.50"), ["a", None], [["b"]], {"k": None})
    assert decode(encode(args)) == args
    assert str(decode(encode((float("nan"), -0.0)))) == "(nan, -0.0)"


def test_shared_table(spark, tmp_path, clock):
    path = str(tmp_path / "shared")
    one, two = Catalog(clock=clock), Catalog(clock=clock)
    first = Shared(spark, one, path, threshold=2)
    assert first.lookup("a") == ("miss", None) and first.flush() == 0
    for k, payload in (("a", "x"), ("a", "x + 0"), ("b", "x * 2")):
        one.upsert_success(row(k, kind="sql", payload=payload))
        one.promote(k)
        first.publish(one.get(k))
    assert len(first.staged) == 1 and first.flush() == 1
    second = Shared(spark, two, path)
    assert second.lookup("a")[1].payload == "x + 0"  # the latest
    assert two.get("a").status == SUCCESS  # kept here
    assert second.lookup("b")[1].payload == "x * 2" and second.lookup("c") == ("miss", None)
    three = Catalog(clock=clock)
    three.upsert_success(row("b", kind="sql", payload="x * 2"))
    three.park("b")
    three.reject("b", "someone")
    assert Shared(spark, three, path).lookup("b")[0] == "wait"  # a rejection here wins


def test_relational_parts(spark, catalog):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 1, "c"), (None, 1, "d")], "k int, t int, v string")
    assert sorted(map(tuple, latest(rows, ["k"], ["t"]).collect()), key=str) == [(1, 3, None), (2, 1, "c"), (None, 1, "d")]
    assert newest(rows, ["k"], ["t"], 2).count() == 4
    assert sorted(map(tuple, merged(rows.where("k is not null"), spark.createDataFrame([(1, 9, "z")], "k int, t int, v string"), ["k"]).collect())) == [(1, 9, "z"), (2, 1, "c")]
    assert latest(rows.where("false"), ["k"], ["t"]).count() == 0
    for k, ok in (("a", True), ("b", False), ("c", True)):
        catalog.insert_pending(row(k))
        catalog.claim(k)
        catalog.mark_success(k, "sql", "x", producer="p")
        catalog.promote(k) if ok else catalog.mark_failed(k, "no")
    assert [tuple(r) for r in collect_stats(spark, catalog).collect()] == [("p", "", 2, 3)]


# Producers.


def plus(x: int, y: int) -> int:
    return x + y


def loop(n: int) -> int:
    while n > 1:
        n = n // 2
    return n


def declines(fn, sig):
    raise Decline("no")


def troubled(fn, sig):
    raise producers.Trouble("later")


declines.name, troubled.name = "declines", "troubled"


def test_chain():
    sig = signature(plus)
    assert producers.Chain((declines, troubled, producers.Lowering())).ask(plus, sig) == ("lowering", Rewrite("sql", "cast((x + y) AS bigint)"))
    with pytest.raises(Decline):
        producers.Chain((declines,))(plus, sig)
    with pytest.raises(producers.Trouble):
        producers.Chain((declines, troubled, declines))(plus, sig)


def test_registry_goes_by_source():
    held, sig = producers.Registry(), signature(plus)
    held.add(plus, sig, Rewrite("sql", "y + x"))
    assert held(plus, sig).payload == "y + x"
    with pytest.raises(Decline):
        held(plus, signature(plus, inputs=["int", "int"]))
    with pytest.raises(Decline):
        held(loop, signature(loop))


def test_command(tmp_path):
    program = tmp_path / "answer.sh"
    for text, want in (("echo 'x + y'", "x + y"), ("echo 'y + x' > OUT.sql; grep -q 'def plus' FUNCTION.py && grep -q bigint TASK.json", "y + x"), ("exit 3", Decline), ("exit 1", producers.Trouble), ("true", Decline), ("sleep 9", producers.Trouble)):
        program.write_text(f"#!/bin/sh\n{text}\n")
        program.chmod(0o755)
        made = producers.Command(str(program), timeout=2)
        if isinstance(want, str):
            assert made(plus, signature(plus)).payload == want
        else:
            with pytest.raises(want):
                made(plus, signature(plus))
    program.write_text("#!/bin/sh\necho 'return x + y;' > OUT.java\n")
    assert producers.Command(str(program))(plus, signature(plus)).kind == "java"
    assert producers.automatic(["no-such-program-here", str(program)]).command == str(program) and producers.automatic(["no-such-program-here"]) is None
    with pytest.raises(Decline):
        producers.Command("no-such-program-here")(plus, signature(plus))


# Sessions.


@pytest.fixture
def session(spark, tmp_path):
    yield api.enable(spark, catalog=str(tmp_path / "c.db"), shared=str(tmp_path / "shared"), shareThreshold=1, maxExamples=10)
    api.shutdown()


def test_udf_is_served_from_the_catalog(spark, session):
    made = loomix.udf(plus)
    assert made.native and session.catalog.size() == 1
    df = spark.range(3).select(made("id", F.lit(2).cast("long")).alias("r"))
    assert [r.r for r in df.collect()] == [2, 3, 4] and served_kind(df) == "native"
    assert session.shared.table().count() == 1
    api.shutdown()
    assert conf.get(spark, "maxExamples") == "100"


def test_udf_stays_python_if_nothing_is_found(spark, session):
    made = loomix.udf(loop)
    df = spark.range(5).select(made("id").alias("r"))
    assert not made.native and served_kind(df) == "python" and [r.r for r in df.collect()] == [0, 1, 1, 1, 1]
    (found,) = session.catalog._rows("")
    assert found.status == FAILED and "While" in found.error


def test_vector_udfs_and_gates_are_left_alone(spark, session):
    vector = F.pandas_udf(lambda s: s + 1, "long")
    assert loomix.udf(vector) is vector
    plain = F.udf(lambda x: x, "long")
    assert loomix.udf(plain) is plain and loomix.udf(plain.asNondeterministic()) is not None
    conf.override(inputCategories="string")
    assert not loomix.udf(plus).native and session.catalog.size() == 0

    def untyped(x):
        return x

    assert not loomix.udf(untyped, "string").native
    table = F.udtf(type("T", (), {"eval": lambda self: iter([(1,)])}), returnType="x int")
    assert loomix.udf(table) is table


def test_register_for_sql(spark, session):
    spark.range(3).createOrReplaceTempView("three")
    loomix.register(spark, "my_plus", plus)
    df = spark.sql("SELECT my_plus(id, 5L) AS r FROM three")
    assert [r.r for r in df.collect()] == [5, 6, 7] and served_kind(df) == "native"
    loomix.register(spark, "my_loop", loop)
    assert [r.r for r in spark.sql("SELECT my_loop(id) AS r FROM three").collect()] == [0, 1, 1]


def test_register_impl(spark, session):
    good = loomix.register_impl(loop, sql="least(n, 1)")
    assert good.status == SUCCESS and good.producer == "human" and good.agreed > 10
    assert loomix.udf(loop).native
    bad = loomix.register_impl(plus, sql="x - y")
    assert bad.status == FAILED and "Spark gives" in bad.error and not loomix.udf(plus).native
    java = loomix.register_impl(loop, java_body="if (n == null) return null; return n <= 1 ? n : 1L;")
    assert (java.status, java.kind) == (SUCCESS, "java")


def test_staged_impl_waits_for_a_worker(spark, session):
    conf.override(inlineWorker=False)
    assert loomix.register_impl(loop, sql="least(n, 1)", check=False).status == PENDING
    assert not loomix.udf(loop).native
    assert session.poll() and not session.poll()
    assert loomix.udf(loop).native


def test_approval_of_a_session(spark, session, capsys):
    conf.override(requireApproval="numeric")
    assert not loomix.udf(plus).native
    (parked,) = session.catalog.awaiting()
    path = session.catalog._db.execute("PRAGMA database_list").fetchone()[2]
    assert approve.main(["--catalog", path, "list"]) == 0 and "plus" in capsys.readouterr().out
    assert approve.main(["--catalog", path, "show", parked.key[:12]]) == 0 and "x + y" in capsys.readouterr().out
    assert approve.main(["--catalog", path, "approve", "nothing"]) == 1
    assert approve.main(["--catalog", path, "--reviewer", "someone", "approve", parked.key[:12]]) == 0
    assert loomix.udf(plus).native
    loomix.udf(loop)
    session.catalog.upsert_success(row("zz", kind="sql", payload="x"))
    session.catalog.park("zz")
    assert approve.main(["--catalog", path, "reject", "zz", "no"]) == 0 and session.catalog.get("zz").status == FAILED


def test_samples_take_part(spark, session):
    df = spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert loomix.sample(df, plus, ["a", "b"]) == 64
    assert len(session.catalog.samples(api.key(plus, signature(plus), spark.version))) == 64


def test_background_worker(spark, tmp_path):
    held = api.enable(spark, background=True, inlineWorker=False, pollIntervalSeconds=0.1, maxExamples=5)
    try:
        assert not loomix.udf(plus).native
        held.worker.join(0.1)
        for _ in range(1200):
            if held.catalog._rows("")[0].status == SUCCESS:
                break
            held.stop.wait(0.1)
        (found,) = held.catalog._rows("")
        assert found.status == SUCCESS, found
        assert loomix.udf(plus).native
    finally:
        api.shutdown()
    assert not held.worker.is_alive()


SCRIPT = '''
from pyspark.sql.functions import udf

@udf("bigint")
def twice(x: int) -> int:
    return x * 2

@udf("bigint")
def hard(x: int) -> int:
    while x > 3:
        x = x // 3
    return x

other = udf(lambda x: x)
'''


def test_prefill_and_worker(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "job.py").write_text(SCRIPT)
    path = str(tmp_path / "c.db")
    held = api.enable(spark, catalog=path, maxExamples=5)
    see = lambda queue=False: {(x.name, x.outcome) for x in prefill.prefill(held, [str(tmp_path / "src")], queue)}
    assert see(queue=True) == {("twice", prefill.QUEUED), ("hard", prefill.QUEUED), ("lambda x: x", "skipped")}
    api.shutdown()
    assert worker.main(["--catalog", path, "--once"]) == 0 and "2 worked off" in capsys.readouterr().out
    held = api.enable(spark, catalog=path)
    assert see() == {("twice", prefill.CACHED), ("hard", prefill.FAILED_BEFORE), ("lambda x: x", "skipped")}
    assert see() == set()  # unchanged
    (tmp_path / "src" / "job.py").write_text(SCRIPT + "\n@udf('string')\ndef shout(s: str) -> str:\n    return s.upper()\n")
    assert ("shout", prefill.REWRITTEN) in see()
    api.shutdown()
    assert prefill.main([str(tmp_path / "src"), "--catalog", path]) == 0


def test_settings(spark):
    assert conf.number(spark, "maxRetries") == 3 and conf.flag(spark, "inlineWorker")
    spark.conf.set("spark.loomix.maxRetries", "5")
    assert conf.number(spark, "maxRetries") == 5
    conf.override(maxRetries=7)
    assert conf.number(spark, "maxRetries") == 7  # a process's own setting comes first
    conf.override(maxRetries=None)
    spark.conf.unset("spark.loomix.maxRetries")
    with pytest.raises(KeyError):
        conf.override(nothing=1)


def test_wrong_rewrites_are_not_served(spark):
    wrong = loomix.native_udf(sql="x + 2")(one_more)
    df = spark.range(2).select(wrong("id").alias("r"))
    assert [r.r for r in df.collect()] == [1, 2] and served_kind(df) == "python"
    assert isinstance(wrong, NativeFunction) and not wrong.trusted(spark)


def one_more(x: int) -> int:
    return x + 1
