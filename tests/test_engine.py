"""Runs, plan JSON and events."""

import threading

import pytest
from test_plans import linear, rules, table

from cleargrain.errors import Category, CleaningError
from cleargrain.events import Session
from cleargrain.functions.expressions import Binary, Cast, Coalesce, Col, IsNull, Unary, lit
from cleargrain.operators.engine import Engine, supervised
from cleargrain.plans.model import CastColumn, Deduplicate, DeriveColumn, Filter, FilterRows, Join, Materialize, Plan, Project, ReplaceLiteral, Scan, Union, Validate
from cleargrain.plans.types import BOOLEAN, INT64, timestamp
from cleargrain.sinks.store import Store
from cleargrain.streaming.batches import Context, RunGate


def test_plans_come_back_from_json():
    plan = Plan(
        {
            "a": Scan("t", ("x", "y"), IsNull(Col("x"), True)), "b": Scan("u", ("z",)), "j": Join(("a", "b"), "left", ((Col("x"), Cast(Col("z"), INT64)),)), "u": Union(("j", "j2")), "j2": Filter(("j",), Unary("not", Binary("equal", Col("x"), lit(1.5)))),
            "r": rules(CastColumn("x", timestamp("millisecond", "UTC"), "set_null"), ReplaceLiteral("y", lit("a"), lit(None)), DeriveColumn("d", "d", BOOLEAN, Coalesce((lit(True), Col("x")))), Deduplicate(("x",)), Validate(lit(True), "warning", "m"))("u"),
            "p": Project(("r",), ("x",)), "out": Materialize(("p",), "label"),
        },
        "out",
    )
    again = Plan.from_json(plan.canonical())
    assert again == plan and again.fingerprint() == plan.fingerprint()
    for bad in ("", "{}", '{"version":1,"root":"a","nodes":{"a":{"kind":"Eval"}}}', "[" * 5000):
        with pytest.raises(CleaningError):
            Plan.from_json(bad)


def test_a_run_publishes_or_leaves_nothing(spark, tmp_path):
    t = table(spark, "i long, s string", [(1, "7"), (2, "x")])
    engine = Engine(spark, lambda _: t, Store(spark, str(tmp_path)))
    made = engine.materialize(linear("i s", rules(FilterRows(Binary("equal", Col("s"), lit("7"))), CastColumn("s", INT64))), "good", ["i"])
    assert made.rows == 1 and engine.session.events[-1].metadata == {"rows": 1}
    with pytest.raises(CleaningError) as e:
        engine.materialize(linear("i s", rules(CastColumn("s", INT64))), "bad")
    assert e.value.category is Category.CAST_FAILURE and not list((tmp_path / "staging").iterdir())
    with pytest.raises(CleaningError):
        engine.store.read("bad")
    assert engine.verify(linear("i s", rules(Deduplicate(("s",)))), "checked", ["i"])["accepted"].rows == 2
    plan = linear("i s", lambda i: Project((i,), ("s",)))
    p = engine.preview(plan, "n1", rows=5, scan_rows=1)
    assert p.table.num_rows == 1 and p.scan_truncated and not p.source_exhausted
    assert engine.preview(plan, "n0").source_exhausted
    for target in ("out", "gone"):
        with pytest.raises(CleaningError):
            engine.preview(plan, target)
    with engine.gate, RunGate(1) as held:
        engine.gate = held
        with pytest.raises(CleaningError) as e:
            engine.materialize(plan, "busy")
    assert e.value.category is Category.BUSY and e.value.retryable


def test_running_jobs_are_cancelled(spark):
    slow = lambda: spark.range(0, 10**12, 1, 4).selectExpr("sum(sqrt(id))").collect()
    context = Context()
    threading.Timer(0.5, context.cancelled.set).start()
    with pytest.raises(CleaningError) as e, supervised(spark, context):
        slow()
    assert e.value.category is Category.CANCELLED
    with pytest.raises(CleaningError) as e, supervised(spark, Context(0.3)):
        slow()
    assert e.value.category is Category.DEADLINE


def test_events_are_ordered_and_hold_no_secrets():
    ids = iter("abcdefgh")
    s = Session("s", lambda: 1.0, lambda: next(ids))
    s.connection_tested("c"), s.connection_failed("c", Category.NOT_FOUND), s.asset_discovered("c", "a"), s.asset_inspected("a", 3), s.dataset_imported("d"), s.snapshot_materialized("n", 5), s.completed()
    assert [e.happened for e in s.events] == ["tested", "failed", "discovered", "inspected", "imported", "materialized", "completed"] and [e.id for e in s.events] == list("abcdefg")
    with pytest.raises(CleaningError):
        s._add("dataset", "d", "imported", note="password=x")


def test_kept_tables_can_be_cleared(spark):
    from cleargrain.workspace import clear, settled, shared_folder

    kept = settled(spark.range(3), "t")
    assert kept.count() == 3
    clear(spark)
    from cleargrain.sinks.files import Files

    assert Files(spark).entries(shared_folder(spark)) == [] and settled(spark.range(2), "t").count() == 2
