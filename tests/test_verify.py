"""Routing of rows by validation and deduplication."""

import math

import pytest
from test_plans import linear, rules, table

from cleargrain.errors import CleaningError, sanitised
from cleargrain.functions.expressions import Binary, Col, lit
from cleargrain.operators import verify as verify_module
from cleargrain.operators.verify import Provenance, dense_ordinals, verify
from cleargrain.plans.model import CastColumn, Deduplicate, DeriveColumn, DropColumn, FilterRows, Rename, Trim, Validate
from cleargrain.plans.types import INT64


def routed(spark, t, *found, order=("i",)):
    with sanitised():
        return verify(linear(" ".join(t[0].columns), rules(*found)), lambda _: t, list(order), Provenance())


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


ABOVE = Binary("greater_than", Col("v"), lit(0))


def test_false_and_null_fail_warnings_stay(spark):
    t = table(spark, "i long, v long", [(0, 1), (1, 0), (2, None)], {"v"})
    v = routed(spark, t, Validate(ABOVE, "warning", "low"), Validate(ABOVE, "error", "low"))
    assert rows(v.accepted, "i") == [(0,)]
    assert rows(v.validation_findings, "source_row_ordinal", "rule_ordinal", "severity", "predicate_outcome") == [(1, 0, "warning", "false"), (1, 1, "error", "false"), (2, 0, "warning", "null"), (2, 1, "error", "null")]
    assert rows(v.rejected, "i", "v", "source_row_ordinal", "rejection_kind", "rule_ordinal") == [(1, 0, 1, "validation_error", 1), (2, None, 2, "validation_error", 1)]
    assert rows(v.validation_summary, "rule_ordinal", "evaluated_count", "pass_count", "fail_count", "warning_count", "error_count", "null_count", "false_count") == [(0, 3, 1, 2, 2, 0, 1, 1), (1, 3, 1, 2, 0, 2, 1, 1)]


def test_an_error_stops_later_rules_for_the_row(spark):
    t = table(spark, "i long, v long, s string", [(0, 0, "x"), (1, 1, "7")])
    v = routed(spark, t, Validate(ABOVE, "error", "low"), CastColumn("s", INT64), Deduplicate(("s",)))
    assert rows(v.accepted, "i", "s") == [(1, 7)]
    assert rows(v.dedup_summary, "evaluated_count", "unique_count", "duplicate_count") == [(1, 1, 0)]


def test_keys_are_equal_by_value(spark):
    t = table(spark, "i long, x double", [(0, math.nan), (1, math.nan), (2, 0.0), (3, -0.0), (4, None), (5, None), (6, 1.0)], {"x"})
    v = routed(spark, t, Deduplicate(("x",)))
    assert rows(v.accepted, "i") == [(0,), (2,), (4,), (6,)]
    assert rows(v.duplicate_findings, "source_row_ordinal", "first_source_row_ordinal", "encoded_key_byte_count") == [(1, 0, 9), (3, 2, 9), (5, 4, 1)]


def test_text_keys_are_exact(spark):
    t = table(spark, "i long, s string", [(0, ""), (1, None), (2, "\u00e9"), (3, "e\u0301"), (4, "\u00c9"), (5, "\u00e9")], {"s"})
    v = routed(spark, t, Deduplicate(("s",)))
    assert rows(v.accepted, "i") == [(0,), (1,), (2,), (3,), (4,)]
    assert rows(v.duplicate_findings, "source_row_ordinal", "encoded_key_byte_count") == [(5, 7)]


def test_nobody_is_promoted_when_the_first_row_falls_later(spark):
    t = table(spark, "i long, k long, v long", [(0, 1, 0), (1, 1, 5), (2, 2, 5)])
    assert rows(routed(spark, t, Deduplicate(("k",)), Validate(ABOVE, "error", "low")).accepted, "i") == [(2,)]
    assert rows(routed(spark, t, Validate(ABOVE, "error", "low"), Deduplicate(("k",))).accepted, "i") == [(1,), (2,)]


def test_filters_leave_no_trace_and_ordinals_keep_gaps(spark):
    t = table(spark, "i long, k long", [(n * 10, n % 3) for n in range(8)])
    v = routed(spark, t, FilterRows(Binary("greater_than", Col("i"), lit(20))), Deduplicate(("k",)))
    assert rows(v.rejected, "source_row_ordinal", "rejection_kind") == [(6, "duplicate"), (7, "duplicate")]
    assert rows(v.accepted, "i") == [(30,), (40,), (50,)]


def test_rejected_rows_show_what_was_scanned(spark):
    t = table(spark, "i long, s string", [(0, " a "), (1, "a")])
    v = routed(spark, t, Trim("s"), Rename("s", "text"), DeriveColumn("d", "d", INT64, Binary("add", Col("i"), lit(1))), Deduplicate(("s",)), DropColumn("d"))
    assert rows(v.rejected, "i", "s") == [(1, "a")] and v.accepted.columns == ["__ordinal", "i", "text"]


def test_all_none_and_no_rows(spark):
    t = table(spark, "i long, v long", [(0, 1), (1, 1)])
    assert routed(spark, t, Validate(ABOVE, "warning", "low")).rejected is None
    assert routed(spark, t, Validate(Binary("less_than", Col("v"), lit(0)), "error", "all")).accepted.count() == 0
    v = routed(spark, table(spark, "i long, v long", []), Validate(ABOVE, "error", "low"), Deduplicate(("v",)))
    assert v.accepted.count() == 0 and rows(v.dedup_summary, "evaluated_count") == [(0,)] and rows(v.validation_summary, "evaluated_count") == [(0,)]


def test_a_row_with_too_many_findings_fails_the_run(spark):
    from cleargrain.plans.model import ApplyRules, Materialize, Plan, Scan

    t = table(spark, "i long, v long", [(0, 0)])
    many = tuple(Validate(ABOVE, "warning", "low") for _ in range(129))
    plan = Plan({"s": Scan("t", ("i", "v")), "a": ApplyRules(("s",), many), "b": ApplyRules(("a",), many), "out": Materialize(("b",), "x")}, "out")
    with pytest.raises(CleaningError), sanitised():
        verify(plan, lambda _: t, ["i"])


def test_ordinals_are_dense_over_partitions(spark):
    df = spark.range(1000).repartition(7).selectExpr("id * 3 AS k")
    got = dense_ordinals(df, ["k"]).collect()
    assert sorted((r["k"], r["__ordinal"]) for r in got) == [(3 * i, i) for i in range(1000)]


def test_ordinals_of_ties_do_not_hang_on_the_partitioning(spark):
    df = spark.range(600).selectExpr("id % 7 AS k", "id AS v")
    first, second = (sorted(map(tuple, dense_ordinals(d, ["k"]).collect())) for d in (df.repartition(3), df.repartition(11, "v")))
    assert first == second and sorted(x[2] for x in first) == list(range(600))


def test_rules_that_would_fail_are_not_evaluated_for_rows_that_are_out(spark):
    t = table(spark, "i long, v long", [(0, 0), (1, 5), (2, 20)])
    big = Binary("greater_than_or_equal", Binary("divide", lit(10), Col("v")), lit(1))
    some = Binary("not_equal", Col("v"), lit(0))
    v = routed(spark, t, Validate(some, "error", "zero"), Validate(big, "error", "big"), Validate(big, "warning", "big"))
    assert rows(v.accepted, "i") == [(1,)] and rows(v.rejected, "i", "rule_ordinal") == [(0, 0), (2, 1)]
    assert rows(routed(spark, t, Validate(some, "error", "zero"), FilterRows(big)).accepted, "i") == [(1,)]
    with pytest.raises(CleaningError), sanitised():
        routed(spark, t, Validate(big, "error", "big")).accepted.collect()


def test_plans_grow_with_the_rules(spark):
    """Each deduplication reads a kept frame twice, whatever went before."""
    t = table(spark, "i long, v long, w long", [(n, n % 5, n % 7) for n in range(40)])
    written = []
    original = verify_module.settled
    verify_module.settled = lambda df, name: written.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")) or original(df, name)
    try:
        v = routed(spark, t, *[Deduplicate((("v",), ("w",), ("v", "w"))[k % 3]) for k in range(9)])
    finally:
        verify_module.settled = original
    assert rows(v.dedup_summary, "rule_ordinal", "evaluated_count")[:3] == [(0, 40), (1, 5), (2, 5)]
    assert len(written) == 10 and max(written) <= 4
