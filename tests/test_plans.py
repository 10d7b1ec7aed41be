"""Plans, rules and expressions on small literal tables."""

import math

import pytest

from cleargrain.errors import Category, CleaningError, sanitised
from cleargrain.functions.expressions import Binary, Cast, Coalesce, Col, IsNull, Lit, Unary, lit, nullable, referenced, type_of
from cleargrain.operators.compile import compile_plan
from cleargrain.operators.preview import preview, preview_node
from cleargrain.plans.model import ApplyRules, CastColumn, Deduplicate, DeriveColumn, DropColumn, FillNull, Filter, FilterRows, Join, Materialize, Plan, Project, Rename, ReplaceLiteral, Scan, Trim, Union, Validate
from cleargrain.plans.types import BOOLEAN, FLOAT64, INT64, UTF8, LogicalField, LogicalSchema, simple


def table(spark, ddl, rows, nulls=()):
    df = spark.createDataFrame(rows, ddl)
    kinds = {"bigint": "int64", "int": "int32", "string": "utf8", "double": "float64", "boolean": "boolean", "smallint": "int16", "tinyint": "int8", "date": "date32", "binary": "binary"}
    return df, LogicalSchema(tuple(LogicalField(n, n, simple(kinds[t]), n in nulls) for n, t in df.dtypes))


def linear(columns, *nodes):
    made = {"n0": Scan("t", tuple(columns.split()))}
    for i, n in enumerate(nodes, 1):
        made[f"n{i}"] = n(f"n{i - 1}")
    return Plan(made | {"out": Materialize((f"n{len(nodes)}",), "result")}, "out")


def rules(*r):
    return lambda i: ApplyRules((i,), r)


def run(spark, t, *nodes, columns=None):
    r = compile_plan(linear(columns or " ".join(t[0].columns), *nodes), lambda _: t)
    with sanitised():
        return [tuple(x) for x in r.df.collect()], r.schema


def test_golden_chain(spark):
    t = table(spark, "col_a string, col_b long", [(" x ", 1), (" keep ", None), ("drop", 5)], {"col_b"})
    rows, schema = run(
        spark, t,
        rules(Trim("col_a"), ReplaceLiteral("col_a", lit("x"), lit("y")), FillNull("col_b", lit(0)), Rename("col_a", "col_a_renamed"), DeriveColumn("col_c", "col_c", BOOLEAN, Binary("equal", Col("col_b"), lit(0))), FilterRows(Binary("not_equal", Col("col_a"), lit("drop")))),
    )
    assert rows == [("y", 1, False), ("keep", 0, True)]
    assert [(f.name, f.nullable) for f in schema.fields] == [("col_a_renamed", False), ("col_b", False), ("col_c", True)]


def test_trim_takes_unicode_space_at_the_ends_only(spark):
    assert run(spark, table(spark, "s string", [(" \t a b \n",), (None,)], {"s"}), rules(Trim("s")))[0] == [("a b",), (None,)]


def test_a_derived_literal_is_a_value(spark):
    t = table(spark, "a long", [(1,)])
    assert run(spark, t, rules(DeriveColumn("k", "k", UTF8, lit(" v ")), Trim("k"), FilterRows(Binary("equal", Col("k"), lit("v")))))[0] == [(1, "v")]


def test_cast_policies(spark):
    t = table(spark, "s string", [("1",), ("x",), (None,)], {"s"})
    rows, schema = run(spark, t, rules(CastColumn("s", INT64, "set_null")))
    assert rows == [(1,), (None,), (None,)] and schema.fields[0].type == INT64
    with pytest.raises(CleaningError) as e:
        run(spark, t, rules(CastColumn("s", INT64)))
    assert e.value.category is Category.CAST_FAILURE and "x" not in str(e.value).split(":")[1]


def test_a_strict_cast_fails_even_if_its_column_is_dropped(spark):
    t = table(spark, "s string, a long", [("x", 1)])
    with pytest.raises(CleaningError):
        run(spark, t, rules(CastColumn("s", INT64), DropColumn("s")))


def test_booleans_are_cast_from_exact_text_only(spark):
    t = table(spark, "s string", [("true",), ("TRUE",), ("yes",), ("false",)])
    assert run(spark, t, rules(CastColumn("s", BOOLEAN, "set_null")))[0] == [(True,), (None,), (None,), (False,)]


def test_replace_and_fill_law(spark):
    t = table(spark, "x double", [(1.0,), (math.nan,), (None,)], {"x"})
    rows, schema = run(spark, t, rules(FillNull("x", lit(2.0))))
    assert rows[0] == (1.0,) and math.isnan(rows[1][0]) and rows[2] == (2.0,) and not schema.fields[0].nullable
    rows, schema = run(spark, t, rules(ReplaceLiteral("x", lit(1.0), lit(None))))
    assert rows[0] == (None,) and schema.fields[0].nullable


@pytest.mark.parametrize(
    "bad",
    [
        Trim("n"), FillNull("n", lit(1.5)), FillNull("n", lit(None)), ReplaceLiteral("f", lit(1), lit(2.0)), Rename("n", "s"), DropColumn("gone"), CastColumn("b", UTF8),
        DeriveColumn("d", "d", INT64, lit(1.0)), DeriveColumn("n", "d", INT64, lit(1)), DeriveColumn("d", "d", INT64, Col("n"), False), FilterRows(Col("n")), FilterRows(Binary("less_than", Col("s"), lit("a"))),
        FilterRows(Binary("equal", Col("s"), lit(1))), FillNull("t", lit(300)),
    ],
)
def test_rules_that_do_not_go_with_the_schema(spark, bad):
    t = table(spark, "n long, s string, f double, b binary, t tinyint", [], {"n", "s", "f"})
    with pytest.raises(CleaningError):
        run(spark, t, rules(bad))


def test_the_last_column_stays(spark):
    with pytest.raises(CleaningError):
        run(spark, table(spark, "a long", [(1,)]), rules(DropColumn("a")))


def test_kleene_logic_and_null_predicates(spark):
    t = table(spark, "a boolean, b boolean", [(x, y) for x in (True, False, None) for y in (True, False, None)], {"a", "b"})
    kept = lambda op: run(spark, t, lambda i: Filter((i,), Binary(op, Col("a"), Col("b"))))[0]
    assert kept("and") == [(True, True)]
    assert len(kept("or")) == 5
    assert len(run(spark, t, lambda i: Filter((i,), Unary("not", Binary("and", Col("a"), Col("b")))))[0]) == 5


def test_arithmetic_law(spark):
    t = table(spark, "a long, b long", [(-7, 2), (7, -2)])
    d = lambda n, op: DeriveColumn(n, n, INT64, Binary(op, Col("a"), Col("b")))
    assert run(spark, t, rules(d("q", "divide"), d("r", "modulo")))[0] == [(-7, 2, -3, -1), (7, -2, -3, 1)]
    for rows, op in (([(1, 0)], "divide"), ([(1, 0)], "modulo"), ([(2**63 - 1, 1)], "add"), ([(-(2**63), -1)], "divide")):
        with pytest.raises(CleaningError):
            run(spark, table(spark, "a long, b long", rows), rules(d("x", op)))
    with pytest.raises(CleaningError):
        run(spark, table(spark, "a long", [(-(2**63),)]), rules(DeriveColumn("x", "x", INT64, Unary("negate", Col("a")))))
    f = lambda op: rules(DeriveColumn("x", "x", FLOAT64, Binary(op, Col("a"), Col("b"))))
    for rows, op in (([(1e308, 10.0)], "multiply"), ([(1.0, 0.0)], "divide")):
        with pytest.raises(CleaningError):
            run(spark, table(spark, "a double, b double", rows), f(op))


def test_mixed_widths_compare_by_their_least_type(spark):
    assert run(spark, table(spark, "a int, b long", [(1, 1), (2, 3)]), lambda i: Filter((i,), Binary("equal", Col("a"), Col("b"))))[0] == [(1, 1)]
    t = table(spark, "a int, b long", [(None, 2), (3, 4)], {"a"})
    assert run(spark, t, rules(DeriveColumn("c", "c", INT64, Coalesce((Col("a"), Col("b"))), False)))[0] == [(None, 2, 2), (3, 4, 3)]


def test_expression_laws():
    schema = LogicalSchema((LogicalField("a", "a", INT64, True), LogicalField("b", "b", INT64, False)))
    assert referenced(Binary("add", Col("b"), Binary("add", Col("a"), Col("b")))) == ["a", "b"]
    assert not nullable(IsNull(Col("a")), schema) and not nullable(Coalesce((Col("a"), Col("b"))), schema) and nullable(Binary("add", Col("a"), Col("b")), schema)
    assert type_of(Cast(Col("a"), UTF8), schema) == UTF8
    deep = lit(1)
    for _ in range(70):
        deep = Unary("negate", deep)
    wide = Coalesce(tuple(lit(1) for _ in range(1100)))
    for bad in (deep, wide, Lit(math.inf, "float64"), Lit("password=hunter2", "utf8"), Lit(1 << 64, "uint64")):
        with pytest.raises(CleaningError):
            Plan({"s": Scan("t", ("a",)), "f": Filter(("s",), Binary("equal", bad, bad)), "o": Materialize(("f",), "x")}, "o")


def test_plans_are_checked():
    s, out = Scan("t", ("a",)), Materialize(("s",), "x")
    Plan({"s": s, "out": out}, "out")
    bad = [
        ({"s": s}, "gone"), ({"s": s, "out": Materialize(("s",), " ")}, "out"), ({"s": s, "out": Materialize(("s",), "my token")}, "out"), ({"s": Scan("t", ()), "out": out}, "out"), ({"s": Scan("t", ("a", "a")), "out": out}, "out"),
        ({"a": Project(("b",), ("x",)), "b": Project(("a",), ("x",)), "out": Materialize(("a",), "x")}, "out"), ({"s": s, "u": Union(("s",)), "out": Materialize(("u",), "x")}, "out"),
        ({"s": s, "j": Join(("s", "s"), "cross", ((Col("a"), Col("a")),)), "out": Materialize(("j",), "x")}, "out"), ({"s": s, "r": ApplyRules(("s",), ()), "out": Materialize(("r",), "x")}, "out"),
        ({"s": s, "r": ApplyRules(("s",), (Deduplicate(()),)), "out": Materialize(("r",), "x")}, "out"), ({"s": s, "r": ApplyRules(("s",), (Validate(lit(True), "fatal", "m"),)), "out": Materialize(("r",), "x")}, "out"),
        ({"s": s} | {f"p{i}": Project(("s",), ("a",)) for i in range(70)} | {"out": out}, "out"),
    ]
    for nodes, root in bad:
        with pytest.raises(CleaningError):
            Plan(nodes, root)


def test_fingerprints_follow_content_not_order():
    s, out = Scan("t", ("a",)), Materialize(("s",), "x")
    assert Plan({"s": s, "out": out}, "out").fingerprint() == Plan({"out": out, "s": s}, "out").fingerprint()
    assert Plan({"s": s, "out": out}, "out").fingerprint() != Plan({"s": Scan("t", ("b",)), "out": out}, "out").fingerprint()


def test_join_and_union_errors(spark):
    t = table(spark, "a long", [(1,)])
    both = lambda node: compile_plan(Plan({"l": Scan("t", ("a",)), "r": Scan("t", ("a",)), "n": node, "out": Materialize(("n",), "x")}, "out"), lambda _: t)
    with pytest.raises(CleaningError):
        both(Join(("l", "r"), "inner", ((Col("a"), Col("a")),)))
    assert both(Join(("l", "r"), "semi", ((Col("a"), Col("a")),))).df.count() == 1
    assert both(Union(("l", "r"))).df.count() == 2


def test_previews_tell_what_they_left_out(spark):
    t = table(spark, "a long, s string", [(i, "x" * 100) for i in range(20)])
    p = preview(*t, rows=5)
    assert p.table.num_rows == 5 and p.rows_truncated and not p.bytes_truncated
    p = preview(*t, rows=20, most_bytes=600)
    assert not p.rows_truncated and p.bytes_truncated and 0 < p.table.num_rows < 20
    plan = linear("a s", lambda i: Project((i,), ("a",)), lambda i: Filter((i,), Binary("less_than", Col("a"), lit(3))))
    assert preview_node(plan, lambda _: t, "n2").table.to_pydict() == {"a": [0, 1, 2]}
    with pytest.raises(CleaningError):
        preview(*t, rows=20_000)


def test_partitioning_does_not_change_rows(spark):
    df, schema = table(spark, "a long, s string", [(i, f" {i} ") for i in range(50)])
    made = [sorted(run(spark, (df.repartition(n), schema), rules(Trim("s"), FilterRows(Binary("greater_than", Col("a"), lit(9)))))[0]) for n in (1, 7)]
    assert made[0] == made[1] and len(made[0]) == 40
