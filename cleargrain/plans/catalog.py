"""Named queries over the test tables, each with the SQL that must give the same rows.

Column ids in these plans are the columns' names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.functions.expressions import Binary, Cast, Coalesce, Col, Expr, IsNull, Unary, lit
from cleargrain.operators.cleaning import Stage, apply_stage, deduplicate, metrics, normalize, run_pipeline
from cleargrain.operators.compile import Sources, compile_plan
from cleargrain.operators.preview import preview, preview_node
from cleargrain.operators.verify import Provenance, Verified, verify
from cleargrain.plans.model import ApplyRules, CastColumn, Deduplicate, DeriveColumn, DropColumn, FillNull, Filter, FilterRows, Join, Materialize, Node, Plan, Project, Rename, ReplaceLiteral, Scan, Trim, Union, Validate
from cleargrain.plans.types import BOOLEAN, FLOAT64, INT64, UTF8, LogicalSchema, schema_of, simple
from cleargrain.workspace import local_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    """Tables by name; a name `table#prefix` has the prefix before each column's name and id."""

    def read(asset: str) -> tuple[DataFrame, LogicalSchema]:
        table, _, prefix = asset.partition("#")
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        df = df.select(*[F.col(c).alias(prefix + c) for c in df.columns]) if prefix else df
        schema = schema_of(df.schema, asset)
        return df, replace(schema, fields=tuple(replace(f, id=f.name) for f in schema.fields))

    return read


def query(name: str, sql: str):
    """Registers a function of (spark, sf_dir), or of nothing that gives a plan."""

    def add(make):
        ORACLE_SQL[name] = sql
        if make.__code__.co_argcount == 0:
            QUERIES[name] = lambda spark, sf_dir: compile_plan(make(), sources(spark, sf_dir)).df
        else:
            QUERIES[name] = make
        return make

    return add


def b(op: str, left: object, right: object) -> Binary:
    return Binary(op, expr(left), expr(right))


def expr(x: object) -> Expr:
    return x if isinstance(x, Expr) else Col(x[1:]) if isinstance(x, str) and x.startswith("@") else lit(x)


def pipe(asset: str, columns: str, *nodes: Callable[[str], Node], where: Expr | None = None) -> Plan:
    """A linear plan; nodes are functions of their input's name."""
    made: dict[str, Node] = {"n0": Scan(asset, tuple(columns.split()), where)}
    for i, node in enumerate(nodes, 1):
        made[f"n{i}"] = node(f"n{i - 1}")
    made["out"] = Materialize((f"n{len(nodes)}",), "result")
    return Plan(made, "out")


def rules(*found) -> Callable[[str], Node]:
    return lambda i: ApplyRules((i,), tuple(found))


def project(columns: str) -> Callable[[str], Node]:
    return lambda i: Project((i,), tuple(columns.split()))


def where(e: Expr) -> Callable[[str], Node]:
    return lambda i: Filter((i,), e)


def derive(name: str, t, e: Expr, nullable: bool = True) -> DeriveColumn:
    return DeriveColumn(name, name, t, e, nullable)


# --- scans, projections, filters


@query("scan_project", "SELECT p_name, p_partkey, p_retailprice FROM part")
def _():
    return pipe("part", "p_partkey p_name p_retailprice", project("p_name p_partkey p_retailprice"))


@query("scan_predicate", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def _():
    return pipe("lineitem", "l_orderkey l_linenumber l_quantity", where=b("greater_than", "@l_quantity", 45.0))


@query("filter_three_valued", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders WHERE NULLIF(o_orderstatus, 'F') = 'O' OR NOT (o_totalprice > 50000)")
def _():
    return pipe(
        "orders", "o_orderkey o_orderstatus o_totalprice", rules(ReplaceLiteral("o_orderstatus", lit("F"), lit(None)), Rename("o_orderstatus", "s")),
        where(b("or", b("equal", "@o_orderstatus", "O"), Unary("not", b("greater_than", "@o_totalprice", 50000.0)))), project("o_orderkey o_orderstatus"),
    )


@query("filter_and_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') <> 'MACHINERY' AND c_acctbal >= 0")
def _():
    return pipe(
        "customer", "c_custkey c_mktsegment c_acctbal", rules(ReplaceLiteral("c_mktsegment", lit("BUILDING"), lit(None))),
        where(b("and", b("not_equal", "@c_mktsegment", "MACHINERY"), b("greater_than_or_equal", "@c_acctbal", 0.0))), project("c_custkey"),
    )


FLAGSHIP_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN trim(o_orderstatus) = 'F' THEN 'FINISHED' ELSE trim(o_orderstatus) END AS status, coalesce(o_totalprice, 0.0) AS o_totalprice,
coalesce(o_totalprice, 0.0) > 200000 AS is_big FROM orders WHERE o_totalprice > 1000"""


@query("flagship_cleaning", FLAGSHIP_SQL)
def _flagship():
    return pipe(
        "orders", "o_orderkey o_custkey o_orderstatus o_totalprice",
        rules(
            Trim("o_orderstatus"), ReplaceLiteral("o_orderstatus", lit("F"), lit("FINISHED")), FillNull("o_totalprice", lit(0.0)),
            derive("is_big", BOOLEAN, b("greater_than", "@o_totalprice", 200000.0)), Rename("o_orderstatus", "status"),
        ),
        project("o_orderkey o_custkey o_orderstatus o_totalprice is_big"), where=b("greater_than", "@o_totalprice", 1000.0),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_cleaning"](spark, sf_dir)


# --- rules


@query("rule_rename", "SELECT n_nationkey, n_name AS nation FROM nation")
def _():
    return pipe("nation", "n_nationkey n_name", rules(Rename("n_name", "nation")))


@query("rule_drop", "SELECT r_regionkey FROM region")
def _():
    return pipe("region", "r_regionkey r_name", rules(DropColumn("r_name")))


@query("rule_trim", "SELECT p_partkey, trim(chr(9) || ' ' || p_name || ' ', ' ' || chr(9)) AS p_name FROM part")
def _trim(spark, sf_dir):
    df, schema = sources(spark, sf_dir)("part")
    padded = df.withColumn("p_name", F.concat(F.lit("\t "), "p_name", F.lit(" ")))
    plan = pipe("part", "p_partkey p_name", rules(Trim("p_name")))
    return compile_plan(plan, lambda _: (padded, schema)).df


@query("rule_fill_null", "SELECT s_suppkey, coalesce(NULLIF(s_nationkey, 3), -1)::BIGINT AS s_nationkey FROM supplier")
def _():
    return pipe("supplier", "s_suppkey s_nationkey", rules(CastColumn("s_nationkey", INT64), ReplaceLiteral("s_nationkey", lit(3), lit(None)), FillNull("s_nationkey", lit(-1))))


@query("rule_filter_rows", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10")
def _():
    return pipe("part", "p_partkey p_size", rules(FilterRows(b("less_than_or_equal", "@p_size", 10))))


@query("rule_replace_literal", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _():
    return pipe("orders", "o_orderkey o_orderpriority", rules(ReplaceLiteral("o_orderpriority", lit("1-URGENT"), lit("URGENT"))))


@query("rule_replace_null", "SELECT event_id, coalesce(NULLIF(event_type, 'click'), 'none') AS event_type FROM events")
def _():
    return pipe("events", "event_id event_type", rules(ReplaceLiteral("event_type", lit("click"), lit(None)), ReplaceLiteral("event_type", lit(None), lit("none"))))


@query("rule_replace_to_null", "SELECT event_id, NULLIF(event_type, 'view') AS event_type FROM events")
def _():
    return pipe("events", "event_id event_type", rules(ReplaceLiteral("event_type", lit("view"), lit(None))))


@query("rule_cast_strict", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS l_quantity FROM lineitem")
def _():
    return pipe("lineitem", "l_orderkey l_linenumber l_quantity", rules(CastColumn("l_orderkey", UTF8), CastColumn("l_linenumber", INT64), CastColumn("l_quantity", INT64)))


@query("rule_cast_set_null", "SELECT c_custkey, TRY_CAST(replace(c_mktsegment, 'BUILDING', '17') AS BIGINT) AS c_mktsegment FROM customer")
def _():
    return pipe("customer", "c_custkey c_mktsegment", rules(ReplaceLiteral("c_mktsegment", lit("BUILDING"), lit("17")), CastColumn("c_mktsegment", INT64, "set_null")))


@query("rule_derive", "SELECT s_suppkey, coalesce(NULLIF(s_acctbal, 0.0), -1.0) AS balance, s_acctbal < 0 AS in_debt, 'supplier' AS kind FROM supplier")
def _():
    return pipe(
        "supplier", "s_suppkey s_acctbal",
        rules(ReplaceLiteral("s_acctbal", lit(0.0), lit(None)), derive("balance", FLOAT64, Coalesce((Col("s_acctbal"), lit(-1.0))), False), derive("in_debt", BOOLEAN, b("less_than", Coalesce((Col("s_acctbal"), lit(0.0))), 0.0)), derive("kind", UTF8, lit("supplier"), False)),
        project("s_suppkey balance in_debt kind"),
    )


@query("rule_chain_golden", "SELECT c_custkey, CASE WHEN trim(c_mktsegment) = 'AUTOMOBILE' THEN 'CAR' ELSE trim(c_mktsegment) END AS segment, coalesce(NULLIF(c_acctbal, 0.0), 0.0) AS c_acctbal, c_acctbal > 5000 AS rich FROM customer WHERE coalesce(NULLIF(c_acctbal, 0.0), 0.0) > 100")
def _():
    return pipe(
        "customer", "c_custkey c_mktsegment c_acctbal",
        rules(
            Trim("c_mktsegment"), ReplaceLiteral("c_mktsegment", lit("AUTOMOBILE"), lit("CAR")), ReplaceLiteral("c_acctbal", lit(0.0), lit(None)), FillNull("c_acctbal", lit(0.0)),
            Rename("c_mktsegment", "segment"), derive("rich", BOOLEAN, b("greater_than", "@c_acctbal", 5000.0)), FilterRows(b("greater_than", "@c_acctbal", 100.0)),
        ),
    )


# --- expressions


@query("cmp_lub", "SELECT c_custkey FROM customer WHERE c_nationkey = c_custkey OR c_custkey < c_nationkey")
def _():
    return pipe("customer", "c_custkey c_nationkey", where(b("or", b("equal", "@c_nationkey", "@c_custkey"), b("less_than", "@c_custkey", "@c_nationkey"))), project("c_custkey"))


@query("cmp_int_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= l_quantity")
def _():
    return pipe("lineitem", "l_orderkey l_linenumber l_quantity", where(b("greater_than_or_equal", "@l_linenumber", "@l_quantity")), project("l_orderkey l_linenumber"))


@query("cmp_timestamp", "SELECT o.o_orderkey FROM orders o WHERE o_orderdate <= CAST('1997-01-01' AS TIMESTAMP)")
def _():
    return pipe("orders", "o_orderkey o_orderdate", where(b("less_than_or_equal", "@o_orderdate", Cast(lit("1997-01-01 00:00:00"), _timestamp()))), project("o_orderkey"))


def _timestamp():
    from cleargrain.plans.types import timestamp

    return timestamp()


@query("is_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') IS NULL AS absent, NULLIF(o_orderstatus, 'P') IS NOT NULL AS present FROM orders")
def _():
    return pipe("orders", "o_orderkey o_orderstatus", rules(ReplaceLiteral("o_orderstatus", lit("P"), lit(None)), derive("absent", BOOLEAN, IsNull(Col("o_orderstatus")), False), derive("present", BOOLEAN, IsNull(Col("o_orderstatus"), True), False), DropColumn("o_orderstatus")))


@query("coalesce_lub", "SELECT c_custkey, coalesce(NULLIF(c_nationkey, 5)::BIGINT, c_custkey) AS key FROM customer")
def _():
    return pipe("customer", "c_custkey c_nationkey", rules(CastColumn("c_nationkey", INT64), ReplaceLiteral("c_nationkey", lit(5), lit(None)), CastColumn("c_nationkey", simple("int32")), derive("key", INT64, Coalesce((Col("c_nationkey"), Col("c_custkey")))), DropColumn("c_nationkey")))


@query("cast_expr", "SELECT p_partkey, p_size::VARCHAR AS size_text, p_size::DOUBLE AS size_float, (p_size > 25)::BIGINT AS large FROM part")
def _():
    return pipe("part", "p_partkey p_size", rules(derive("size_text", UTF8, Cast(Col("p_size"), UTF8)), derive("size_float", FLOAT64, Cast(Col("p_size"), FLOAT64)), derive("large", INT64, Cast(b("greater_than", "@p_size", 25), INT64)), DropColumn("p_size")))


@query("arith_int", "SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_suppkey AS s, l_partkey * 3 AS m FROM lineitem")
def _():
    return pipe("lineitem", "l_orderkey l_linenumber l_partkey l_suppkey", rules(derive("a", INT64, b("add", "@l_orderkey", "@l_partkey")), derive("s", INT64, b("subtract", "@l_orderkey", "@l_suppkey")), derive("m", INT64, b("multiply", "@l_partkey", 3)), DropColumn("l_partkey"), DropColumn("l_suppkey")))


@query("arith_float", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, l_extendedprice / l_quantity AS unit FROM lineitem")
def _():
    return pipe("lineitem", "l_orderkey l_linenumber l_extendedprice l_discount l_quantity", rules(derive("net", FLOAT64, b("multiply", "@l_extendedprice", b("subtract", 1.0, "@l_discount"))), derive("unit", FLOAT64, b("divide", "@l_extendedprice", "@l_quantity"))), project("l_orderkey l_linenumber net unit"))


@query("div_mod", "SELECT o_orderkey, (o_custkey - 700) // 7 AS q, (o_custkey - 700) % 7 AS r, (o_custkey - 700) // (-7) AS nq FROM orders")
def _():
    shifted = b("subtract", "@o_custkey", 700)
    return pipe("orders", "o_orderkey o_custkey", rules(derive("q", INT64, b("divide", shifted, 7)), derive("r", INT64, b("modulo", shifted, 7)), derive("nq", INT64, b("divide", shifted, -7)), DropColumn("o_custkey")))


@query("negate", "SELECT s_suppkey, -s_suppkey AS n, -s_acctbal AS nb FROM supplier")
def _():
    return pipe("supplier", "s_suppkey s_acctbal", rules(derive("n", INT64, Unary("negate", Col("s_suppkey"))), derive("nb", FLOAT64, Unary("negate", Col("s_acctbal"))), DropColumn("s_acctbal")))


@query("contains", "SELECT p_partkey, contains(p_type, 'BRASS') AS brass FROM part")
def _():
    return pipe("part", "p_partkey p_type", rules(derive("brass", BOOLEAN, b("contains", "@p_type", "BRASS")), DropColumn("p_type")))


# --- joins and unions


def join(how: str, out: str, left: str = "customer", lcols: str = "c_custkey c_name", right: str = "orders", rcols: str = "o_orderkey o_custkey o_totalprice", keys=(("@c_custkey", "@o_custkey"),), lwhere: Expr | None = None, rwhere: Expr | None = None) -> Plan:
    return Plan(
        {
            "l": Scan(left, tuple(lcols.split()), lwhere), "r": Scan(right, tuple(rcols.split()), rwhere), "j": Join(("l", "r"), how, tuple((expr(x), expr(y)) for x, y in keys)),
            "p": Project(("j",), tuple(out.split())), "out": Materialize(("p",), "joined"),
        },
        "out",
    )


_BIG = b("greater_than", "@o_totalprice", 150000.0)
_FEW = b("less_than", "@c_custkey", 500)


@query("join_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000")
def _():
    return join("inner", "c_custkey o_orderkey o_totalprice", rwhere=_BIG)


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey")
def _():
    return join("left", "c_custkey o_orderkey", rwhere=_BIG)


@query("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey < 500) RIGHT JOIN orders ON c_custkey = o_custkey")
def _():
    return join("right", "c_custkey o_orderkey", lwhere=_FEW)


@query("join_full", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey < 500) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey")
def _():
    return join("full", "c_custkey o_orderkey", lwhere=_FEW, rwhere=_BIG)


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def _():
    return join("semi", "c_custkey c_name", rwhere=_BIG)


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _():
    return join("anti", "c_custkey c_name", rwhere=b("greater_than", "@o_totalprice", 400000.0))


@query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS r_l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_quantity > 40")
def _():
    return join("inner", "l_orderkey l_linenumber r_l_quantity", "lineitem", "l_orderkey l_linenumber l_suppkey l_quantity", "lineitem#r_", "r_l_orderkey r_l_suppkey r_l_quantity", (("@l_orderkey", "@r_l_orderkey"), ("@l_suppkey", "@r_l_suppkey")), b("greater_than", "@l_quantity", 40.0))


@query("join_expr_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey - 10 = s_suppkey * 2")
def _():
    return join("inner", "c_custkey s_suppkey", right="supplier", rcols="s_suppkey", keys=((b("subtract", "@c_custkey", 10), b("multiply", "@s_suppkey", 2)),))


@query("join_null_key", "SELECT c_custkey, n_name FROM (SELECT *, NULLIF(c_nationkey, 3) AS k FROM customer) LEFT JOIN (SELECT *, NULLIF(n_nationkey, 3) AS nk FROM nation) ON k = nk")
def _():
    return Plan(
        {
            "l": Scan("customer", ("c_custkey", "c_nationkey")), "lr": ApplyRules(("l",), (CastColumn("c_nationkey", INT64), ReplaceLiteral("c_nationkey", lit(3), lit(None)))),
            "r": Scan("nation", ("n_nationkey", "n_name")), "rr": ApplyRules(("r",), (CastColumn("n_nationkey", INT64), ReplaceLiteral("n_nationkey", lit(3), lit(None)))),
            "j": Join(("lr", "rr"), "left", ((Col("c_nationkey"), Col("n_nationkey")),)), "p": Project(("j",), ("c_custkey", "n_name")), "out": Materialize(("p",), "joined"),
        },
        "out",
    )


@query("join_chain", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def _():
    return Plan(
        {
            "o": Scan("orders", ("o_orderkey", "o_custkey", "o_orderstatus"), b("equal", "@o_orderstatus", "P")), "c": Scan("customer", ("c_custkey", "c_name", "c_nationkey")), "n": Scan("nation", ("n_nationkey", "n_name")),
            "oc": Join(("o", "c"), "inner", ((Col("o_custkey"), Col("c_custkey")),)), "ocn": Join(("oc", "n"), "inner", ((Col("c_nationkey"), Col("n_nationkey")),)),
            "p": Project(("ocn",), ("o_orderkey", "c_name", "n_name")), "out": Materialize(("p",), "joined"),
        },
        "out",
    )


@query("union_two", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _():
    return Plan(
        {
            "a": Scan("customer", ("c_custkey", "c_acctbal")), "ar": ApplyRules(("a",), (Rename("c_custkey", "key"), Rename("c_acctbal", "balance"))), "b": Scan("supplier", ("s_suppkey", "s_acctbal")),
            "u": Union(("ar", "b")), "out": Materialize(("u",), "all"),
        },
        "out",
    )


@query("union_three_lub", "SELECT c_custkey::DOUBLE AS key FROM customer UNION ALL SELECT n_nationkey::DOUBLE FROM nation UNION ALL SELECT p_retailprice FROM part")
def _():
    return Plan(
        {
            "a": Scan("customer", ("c_custkey",)), "ar": ApplyRules(("a",), (Rename("c_custkey", "key"),)), "b": Scan("nation", ("n_nationkey",)), "c": Scan("part", ("p_retailprice",)),
            "u": Union(("ar", "b", "c")), "out": Materialize(("u",), "all"),
        },
        "out",
    )


# --- verification

_ORDINAL = "row_number() OVER (ORDER BY event_id) - 1"
_VALID = Validate(b("less_than", "@value", 80.0), "warning", "value is high")
_TYPED = Validate(b("not_equal", "@event_type", "view"), "error", "views are not wanted")


def _events(*found) -> Plan:
    return pipe("events", "event_id user_id event_type value", rules(*found))


def _verified(spark: SparkSession, sf_dir: str, *found) -> Verified:
    return verify(_events(*found), sources(spark, sf_dir), ["event_id"], Provenance())


def _core(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


@query("validate_findings", f"SELECT o AS source_row_ordinal, 1 AS rule_ordinal, 'warning' AS severity, CASE WHEN t IS NULL THEN 'null' ELSE 'false' END AS predicate_outcome FROM (SELECT {_ORDINAL} AS o, NULLIF(event_type, 'click') AS t FROM events) WHERE t IS NULL OR t = 'view'")
def _validate_findings(spark, sf_dir):
    v = _verified(spark, sf_dir, ReplaceLiteral("event_type", lit("click"), lit(None)), replace(_TYPED, severity="warning"))
    return _core(v.validation_findings, "source_row_ordinal", "rule_ordinal", "severity", "predicate_outcome")


@query("validate_summary", "SELECT 1 AS rule_ordinal, 'views are not wanted' AS message, count(*) AS evaluated_count, count(*) FILTER (t <> 'view') AS pass_count, count(*) FILTER (t IS NULL OR t = 'view') AS fail_count, 0::BIGINT AS warning_count, count(*) FILTER (t IS NULL OR t = 'view') AS error_count, count(*) FILTER (t IS NULL) AS null_count, count(*) FILTER (t = 'view') AS false_count FROM (SELECT NULLIF(event_type, 'click') AS t FROM events)")
def _validate_summary(spark, sf_dir):
    v = _verified(spark, sf_dir, ReplaceLiteral("event_type", lit("click"), lit(None)), _TYPED)
    return _core(v.validation_summary, "rule_ordinal", "message", "evaluated_count", "pass_count", "fail_count", "warning_count", "error_count", "null_count", "false_count")


@query("validate_accepted", "SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def _validate_accepted(spark, sf_dir):
    return _core(_verified(spark, sf_dir, _VALID, _TYPED).accepted, "event_id", "event_type")


_DEDUP_SQL = f"SELECT *, {_ORDINAL} AS o, NULLIF(event_type, 'click') AS t FROM events"
_DEDUP = (ReplaceLiteral("event_type", lit("click"), lit(None)), Deduplicate(("user_id", "event_type")))


@query("dedup_accepted", f"SELECT event_id, user_id, t AS event_type FROM (SELECT *, min(o) OVER (PARTITION BY user_id, t) AS f FROM ({_DEDUP_SQL})) WHERE o = f")
def _dedup_accepted(spark, sf_dir):
    return _core(_verified(spark, sf_dir, *_DEDUP).accepted, "event_id", "user_id", "event_type")


@query("dedup_findings", f"SELECT o AS source_row_ordinal, f AS first_source_row_ordinal, 2 AS key_column_count, (9 + CASE WHEN t IS NULL THEN 1 ELSE 5 + strlen(t) END)::BIGINT AS encoded_key_byte_count FROM (SELECT *, min(o) OVER (PARTITION BY user_id, t) AS f FROM ({_DEDUP_SQL})) WHERE o > f")
def _dedup_findings(spark, sf_dir):
    return _core(_verified(spark, sf_dir, *_DEDUP).duplicate_findings, "source_row_ordinal", "first_source_row_ordinal", "key_column_count", "encoded_key_byte_count")


@query("dedup_summary", f"SELECT 2 AS key_column_count, count(*) AS evaluated_count, count(DISTINCT (user_id, coalesce(t, '~'))) AS unique_count, count(*) - count(DISTINCT (user_id, coalesce(t, '~'))) AS duplicate_count FROM ({_DEDUP_SQL})")
def _dedup_summary(spark, sf_dir):
    return _core(_verified(spark, sf_dir, *_DEDUP).dedup_summary, "key_column_count", "evaluated_count", "unique_count", "duplicate_count")


_ROUTE = f"""SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE min(CASE WHEN event_type <> 'view' THEN o END) OVER (PARTITION BY user_id, event_type = 'view') END AS f FROM (SELECT *, {_ORDINAL} AS o FROM events)"""


@query("rejected_rows", f"SELECT event_id, user_id, event_type, value, o AS source_row_ordinal, CASE WHEN event_type = 'view' THEN 'validation_error' ELSE 'duplicate' END AS rejection_kind, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS rule_ordinal FROM ({_ROUTE}) WHERE event_type = 'view' OR o > f")
def _rejected(spark, sf_dir):
    v = _verified(spark, sf_dir, _TYPED, Deduplicate(("user_id",)))
    return _core(v.rejected, "event_id", "user_id", "event_type", "value", "source_row_ordinal", "rejection_kind", "rule_ordinal")


@query("routing_validate_then_dedup", f"SELECT event_id, user_id FROM ({_ROUTE}) WHERE event_type <> 'view' AND o = f")
def _routing(spark, sf_dir):
    return _core(_verified(spark, sf_dir, _TYPED, Deduplicate(("user_id",))).accepted, "event_id", "user_id")


@query("routing_winner_rejected", f"SELECT event_id FROM (SELECT *, min(o) OVER (PARTITION BY user_id) AS f FROM (SELECT *, {_ORDINAL} AS o FROM events)) WHERE o = f AND event_type <> 'view'")
def _winner(spark, sf_dir):
    return _core(_verified(spark, sf_dir, Deduplicate(("user_id",)), _TYPED).accepted, "event_id")


@query("routing_filter_gaps", f"SELECT o AS source_row_ordinal FROM (SELECT *, {_ORDINAL} AS o FROM events) WHERE value > 50 AND NOT (value < 80)")
def _gaps(spark, sf_dir):
    v = _verified(spark, sf_dir, FilterRows(b("greater_than", "@value", 50.0)), _VALID)
    return _core(v.validation_findings, "source_row_ordinal")


_PART = "user_id - 5"


@query("routing_guarded", f"SELECT event_id FROM events WHERE user_id <> 5 AND CASE WHEN user_id <> 5 THEN 100 // ({_PART}) >= 1 END")
def _guarded(spark, sf_dir):
    """A rule that would fail the run isn't evaluated for rows that an earlier one rejected."""
    some = Validate(b("not_equal", "@user_id", 5), "error", "user 5")
    large = Validate(b("greater_than_or_equal", b("divide", 100, b("subtract", "@user_id", 5)), 1), "error", "far from 5")
    return _core(_verified(spark, sf_dir, some, large).accepted, "event_id")


_THREE = f"""WITH a AS (SELECT *, {_ORDINAL} AS o FROM events), b AS (SELECT *, min(o) OVER (PARTITION BY user_id, event_type) AS f FROM a), c AS (SELECT *, min(o) OVER (PARTITION BY user_id) AS g FROM b WHERE o = f),
d AS (SELECT *, min(o) OVER (PARTITION BY event_type) AS h FROM c WHERE o = g) """


@query("dedup_three_rules", _THREE + "SELECT 0 AS rule_ordinal, count(*) AS evaluated_count, count(*) FILTER (o = f) AS unique_count, count(*) FILTER (o > f) AS duplicate_count FROM b UNION ALL SELECT 1, count(*), count(*) FILTER (o = g), count(*) FILTER (o > g) FROM c UNION ALL SELECT 2, count(*), count(*) FILTER (o = h), count(*) FILTER (o > h) FROM d")
def _three(spark, sf_dir):
    """Each rule sees what the one before left."""
    v = _verified(spark, sf_dir, Deduplicate(("user_id", "event_type")), Deduplicate(("user_id",)), Deduplicate(("event_type",)))
    return _core(v.dedup_summary, "rule_ordinal", "evaluated_count", "unique_count", "duplicate_count")


@query("dedup_three_accepted", _THREE + "SELECT event_id, o AS __ordinal FROM d WHERE o = h")
def _three_accepted(spark, sf_dir):
    return _core(_verified(spark, sf_dir, Deduplicate(("user_id", "event_type")), Deduplicate(("user_id",)), Deduplicate(("event_type",))).accepted, "event_id", "__ordinal")


# --- the cleaning pipeline

_CUSTOMERS = """SELECT 'C' || o_orderkey::VARCHAR AS customer_id, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN ' ' ELSE ' ' || c_name END AS name,
CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 'User' || o_custkey::VARCHAR || '@Example.COM ' END AS email, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS amount,
c_mktsegment AS category, CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS created_at,
c_acctbal AS margin_pct FROM orders JOIN customer ON o_custkey = c_custkey"""
_EIGHT = "customer_id, name, email, amount, category, status, created_at, margin_pct"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables in the shape of the pipeline's customers, with blanks and nulls."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    when = lambda k, n, v: F.when(F.col(k) % n == 0, F.lit(v))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("customer_id"),
        when("o_custkey", 11, None).when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"),
        when("o_custkey", 13, None).otherwise(F.concat(F.lit("User"), F.col("o_custkey").cast("string"), F.lit("@Example.COM "))).alias("email"),
        when("o_orderkey", 17, None).otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("c_mktsegment").alias("category"),
        when("o_orderkey", 19, "").when(F.col("o_orderkey") % 23 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"),
        when("o_orderkey", 29, None).otherwise(F.col("o_orderdate")).alias("created_at"),
        F.col("c_acctbal").alias("margin_pct"),
    )


def _keep(order: str, condition: str = "true") -> str:
    ties = "customer_id NULLS FIRST, name NULLS FIRST, email NULLS FIRST, amount NULLS FIRST, category NULLS FIRST, status NULLS FIRST, margin_pct NULLS FIRST"
    return f"SELECT {_EIGHT} FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at {order} NULLS LAST, {ties}) AS n FROM ({_CUSTOMERS}) WHERE {condition}) WHERE n = 1"


@query("pipe_filter", f"SELECT {_EIGHT} FROM ({_CUSTOMERS}) WHERE status IS NOT NULL AND status <> ''")
def _pipe_filter(spark, sf_dir):
    return apply_stage(customers(spark, sf_dir), Stage("f", "filter", {"column": "status"}))


@query("pipe_dedup_first", _keep("ASC"))
def _pipe_first(spark, sf_dir):
    return deduplicate(customers(spark, sf_dir), "email")


@query("pipe_dedup_last", _keep("DESC"))
def _pipe_last(spark, sf_dir):
    return deduplicate(customers(spark, sf_dir), "email", "Keep last", "Treat as duplicate")


@query("pipe_dedup_no_nulls", _keep("ASC", "email IS NOT NULL AND email <> ''"))
def _pipe_no_nulls(spark, sf_dir):
    return deduplicate(customers(spark, sf_dir), "email", "Keep first", "Remove null rows")


@query("pipe_dedup_merge", f"SELECT category, string_agg(DISTINCT name, ' | ' ORDER BY name) AS name, string_agg(DISTINCT email, ' | ' ORDER BY email) AS email, max(amount) AS amount, max(status) AS status, min(created_at) AS created_at, max(margin_pct) AS margin_pct FROM ({_CUSTOMERS}) GROUP BY category")
def _pipe_merge(spark, sf_dir):
    return deduplicate(customers(spark, sf_dir), "category", "Merge records")


@query("pipe_normalize", f"SELECT customer_id, CASE WHEN trim(coalesce(name, '')) = '' THEN name ELSE trim(name) END AS name, CASE WHEN email IS NULL OR trim(email) = '' THEN email ELSE lower(trim(email)) END AS email, amount, category, status, created_at, margin_pct FROM ({_CUSTOMERS})")
def _pipe_normalize(spark, sf_dir):
    return normalize(customers(spark, sf_dir))


@query("pipe_normalize_unknown", f"SELECT customer_id, CASE WHEN name IS NULL OR trim(name) = '' THEN 'Unknown' ELSE trim(name) END AS name, CASE WHEN email IS NULL OR trim(email) = '' THEN email ELSE lower(trim(email)) END AS email, amount, category, status, created_at, margin_pct FROM ({_CUSTOMERS})")
def _pipe_unknown(spark, sf_dir):
    return normalize(customers(spark, sf_dir), "Remove null rows")


_METRICS = """SELECT rows_in, rows_out, floor(with_null / greatest(rows_out, 1) * 1000 + 0.5) / 10 AS missing_pct, null_cells,
greatest(0, least(100, floor(100 - null_cells / (greatest(rows_out, 1) * 4) * 100 + 0.5)))::BIGINT AS quality_score,
CASE WHEN floor(100 - null_cells / (greatest(rows_out, 1) * 4) * 100 + 0.5) >= 80 THEN 'Good' WHEN floor(100 - null_cells / (greatest(rows_out, 1) * 4) * 100 + 0.5) >= 60 THEN 'Fair' ELSE 'Poor' END AS quality_label,
floor((rows_in - rows_out) / rows_in * 1000 + 0.5) / 10 AS duplicates_pct
FROM (SELECT (SELECT count(*) FROM ({before})) AS rows_in, count(*) AS rows_out, count(*) FILTER (name IS NULL OR email IS NULL OR amount IS NULL OR status IS NULL) AS with_null,
(count(*) FILTER (name IS NULL OR trim(name) = '') + count(*) FILTER (email IS NULL) + count(*) FILTER (amount IS NULL) + count(*) FILTER (status IS NULL OR trim(status) = ''))::BIGINT AS null_cells FROM ({after}))"""


@query("pipe_metrics", _METRICS.format(before=_CUSTOMERS, after=_keep("ASC")))
def _pipe_metrics(spark, sf_dir):
    source = customers(spark, sf_dir)
    return metrics(source, deduplicate(source, "email"))


@query("pipe_run_from_here", f"SELECT {_EIGHT} FROM (SELECT customer_id, name, CASE WHEN email IS NULL OR trim(email) = '' THEN email ELSE lower(trim(email)) END AS email, amount, category, status, created_at, margin_pct FROM (SELECT * REPLACE (CASE WHEN trim(coalesce(name, '')) = '' THEN name ELSE trim(name) END AS name) FROM ({_keep('ASC')}) WHERE status IS NOT NULL AND status <> ''))")
def _pipe_run(spark, sf_dir):
    stages = [Stage("a", "source"), Stage("b", "deduplicate", {"column": "email"}), Stage("c", "filter"), Stage("d", "normalize"), Stage("e", "export")]
    return run_pipeline(customers(spark, sf_dir), stages, until="d")[-1][1]


@query("pipe_export", f"SELECT category, count(*) AS n FROM ({_keep('ASC')}) GROUP BY category")
def _pipe_export(spark, sf_dir):
    """The view that an export stage makes, queried by SQL."""
    run_pipeline(customers(spark, sf_dir), [Stage("a", "source"), Stage("b", "deduplicate", {"column": "email"}), Stage("e-1", "export")])
    return spark.sql("SELECT category, count(*) AS n FROM stage_e_1 GROUP BY category")


@query("preview_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _preview(spark, sf_dir):
    """The rows that a preview of an ordered source shows."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return spark.createDataFrame(preview(df, schema_of(df.schema, "orders"), 100).table)


@query("node_preview_prefix", "SELECT least(count(*), 700) AS n, true AS kept, count(*) > 700 AS rows_truncated FROM orders WHERE o_totalprice > 1000")
def _node_preview(spark, sf_dir):
    """A preview of a node within a plan: of its rows, before those after it."""
    p = preview_node(_flagship(), sources(spark, sf_dir), "n1", rows=700)
    kept = all(x > 1000 for x in p.table.column("o_totalprice").to_pylist())
    return local_rows(spark, [(p.table.num_rows, kept, p.rows_truncated)], "n long, kept boolean, rows_truncated boolean")


from cleargrain.plans import catalog_io, catalog_laws  # noqa: E402, F401 register their queries here
