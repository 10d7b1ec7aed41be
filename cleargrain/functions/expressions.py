"""Typed expressions: checked and given their nullability before any Spark column is built."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.errors import Category, fail, raised, secret_value
from cleargrain.plans.types import BOOLEAN, FLOAT64, INT64, NULL, UINT64, UTF8, LogicalSchema, LogicalType, lub, spark_type

#: Fixed limits of expressions.
MAX_NODES, MAX_DEPTH = 1024, 64
LITERALS = {"null": NULL, "boolean": BOOLEAN, "int64": INT64, "uint64": UINT64, "float64": FLOAT64, "utf8": UTF8}
COMPARISONS = ("equal", "not_equal")
ORDERINGS = ("less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal")
ARITHMETIC = ("add", "subtract", "multiply", "divide", "modulo")


class Expr:
    def children(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Col(Expr):
    id: str


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    kind: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # not, negate
    of: Expr

    def children(self):
        return (self.of,)


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # COMPARISONS, ORDERINGS, ARITHMETIC, and, or, contains
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool = False

    def children(self):
        return (self.of,)


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    type: LogicalType

    def children(self):
        return (self.of,)


@dataclass(frozen=True)
class Coalesce(Expr):
    of: tuple[Expr, ...]

    def children(self):
        return self.of


def lit(value: object) -> Lit:
    """A literal by Python's own type; whole numbers are int64."""
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "int64" if isinstance(value, int) else "float64" if isinstance(value, float) else "utf8"
    return Lit(value, kind)


def walk(e: Expr) -> Iterator[Expr]:
    """All nodes; without recursion, so that nothing deep is entered before `guard` has seen it."""
    stack = [e]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(node.children())


def guard(e: Expr) -> None:
    """Bounds, literals and shapes."""
    stack, count = [(e, 1)], 0
    while stack:
        node, depth = stack.pop()
        count += 1
        if count > MAX_NODES or depth > MAX_DEPTH:
            fail(Category.LIMIT_EXCEEDED, "an expression is too large")
        if isinstance(node, Lit):
            _check_literal(node)
        if isinstance(node, Coalesce) and not node.of:
            fail(Category.INVALID_PLAN, "coalesce needs an expression")
        stack.extend((c, depth + 1) for c in node.children())


def _check_literal(node: Lit) -> None:
    v, kind = node.value, node.kind
    if kind not in LITERALS:
        fail(Category.TYPE_ERROR, "no such literal")
    fits = {
        "null": v is None,
        "boolean": isinstance(v, bool),
        "int64": isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63,
        "uint64": isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 64,
        "float64": isinstance(v, float) and math.isfinite(v),
        "utf8": isinstance(v, str),
    }
    if not fits[kind]:
        fail(Category.TYPE_ERROR, f"a literal isn't a {kind}")
    if kind == "utf8" and secret_value(v):
        fail(Category.INVALID_PLAN, "a literal looks like a secret")


def referenced(e: Expr) -> list[str]:
    """Ids of the columns that an expression reads, sorted, each once."""
    return sorted({n.id for n in walk(e) if isinstance(n, Col)})


def castable(a: LogicalType, b: LogicalType) -> bool:
    """Whether the engine casts one type to the other, strictly or not."""
    if not (a.executable and b.executable) or (a.kind == "binary") != (b.kind == "binary"):
        return False
    if a == b or a.kind == "null":
        return True
    if "null" in (a.kind, b.kind):
        return False
    timed = ("date32", "timestamp")
    if a.kind in timed and b.kind == "utf8":
        return False
    if a.kind in timed or b.kind in timed:
        return (a.kind in timed and b.kind in timed) or a.kind == "utf8"
    return True


def type_of(e: Expr, schema: LogicalSchema) -> LogicalType:
    """The expression's type; a type error if it has none. `guard` comes first."""
    match e:
        case Col(id):
            t = schema.by_id(id).type
            if not t.executable:
                fail(Category.TYPE_ERROR, "a column's type can't be computed with")
            return t
        case Lit(_, kind):
            return LITERALS[kind]
        case Unary("not", of):
            if type_of(of, schema) not in (BOOLEAN, NULL):
                fail(Category.TYPE_ERROR, "not needs a boolean")
            return BOOLEAN
        case Unary("negate", of):
            t = type_of(of, schema)
            if not t.numeric:
                fail(Category.TYPE_ERROR, "negate needs a number")
            return t
        case Binary("and" | "or", left, right):
            if any(type_of(x, schema) not in (BOOLEAN, NULL) for x in (left, right)):
                fail(Category.TYPE_ERROR, "a logical operator needs booleans")
            return BOOLEAN
        case Binary("contains", left, right):
            if any(type_of(x, schema) not in (UTF8, NULL) for x in (left, right)):
                fail(Category.TYPE_ERROR, "contains needs text")
            return BOOLEAN
        case Binary(op, left, right):
            met = lub(type_of(left, schema), type_of(right, schema))
            if met is None or met.kind == "binary":
                return fail(Category.TYPE_ERROR, "the operands have no common type")
            if op in COMPARISONS:
                return BOOLEAN
            if op in ORDERINGS:
                if not (met.ordered or met == NULL):
                    fail(Category.TYPE_ERROR, "only numbers, dates and timestamps are ordered")
                return BOOLEAN
            if op in ARITHMETIC:
                if not met.numeric:
                    fail(Category.TYPE_ERROR, "arithmetic needs numbers")
                return met
            return fail(Category.INVALID_PLAN, "no such operator")
        case IsNull(of):
            type_of(of, schema)
            return BOOLEAN
        case Cast(of, to):
            if not castable(type_of(of, schema), to):
                fail(Category.TYPE_ERROR, "no such cast")
            return to
        case Coalesce(of):
            met: LogicalType | None = NULL
            for x in of:
                met = lub(met, type_of(x, schema))
                if met is None:
                    fail(Category.TYPE_ERROR, "coalesce's operands have no common type")
            return met
    return fail(Category.INVALID_PLAN, "no such expression")


def nullable(e: Expr, schema: LogicalSchema) -> bool:
    match e:
        case Col(id):
            return schema.by_id(id).nullable
        case Lit(value, _):
            return value is None
        case IsNull():
            return False
        case Coalesce(of):
            return all(nullable(x, schema) for x in of)
        case _:
            return any(nullable(x, schema) for x in e.children())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: object, t: LogicalType) -> Column:
    if isinstance(value, float) and value == 0:
        value = 0.0  # one zero
    return F.lit(value).cast(spark_type(t))


def strict_cast(c: Column, a: LogicalType, b: LogicalType) -> Column:
    """A cast that fails the run on the first value that doesn't fit."""
    if a == b:
        return c
    target = spark_type(b)
    if a.kind == "utf8" and b.kind == "boolean":
        return F.when(c.isNull(), F.lit(None).cast("boolean")).when(c.isin("true", "false"), c == "true").otherwise(raised(Category.CAST_FAILURE, "a value can't be cast"))
    out = c.cast(target)
    if b.kind in ("uint8", "uint16", "uint32", "uint64"):
        out = F.when(c.isNull() | _in_range(out, b), out).otherwise(raised(Category.CAST_FAILURE, "a value can't be cast"))
    return out


def try_cast(c: Column, a: LogicalType, b: LogicalType) -> Column:
    """A cast that gives null for a value that doesn't fit."""
    if a == b:
        return c
    if a.kind == "utf8" and b.kind == "boolean":
        return F.when(c.isin("true", "false"), c == "true")
    out = c.try_cast(spark_type(b))
    return F.when(_in_range(out, b), out) if b.kind in ("uint8", "uint16", "uint32", "uint64") else out


def _in_range(c: Column, t: LogicalType) -> Column:
    top = (1 << int(t.kind[4:])) - 1
    return (c >= 0) & (c <= F.lit(top).cast(T.DecimalType(20, 0)))


def to_column(e: Expr, schema: LogicalSchema) -> Column:
    """The Spark column of a checked expression. No implicit coercion is left to Spark."""
    match e:
        case Col(id):
            return quoted(schema.by_id(id).name)
        case Lit(value, kind):
            return literal(value, LITERALS[kind])
        case Unary("not", of):
            return ~_boolean(of, schema)
        case Unary("negate", of):
            return -to_column(of, schema)
        case Binary("and", left, right):
            return _boolean(left, schema) & _boolean(right, schema)
        case Binary("or", left, right):
            return _boolean(left, schema) | _boolean(right, schema)
        case Binary("contains", left, right):
            return F.contains(to_column(left, schema).cast("string"), to_column(right, schema).cast("string"))
        case Binary(op, left, right):
            ta, tb = type_of(left, schema), type_of(right, schema)
            met = lub(ta, tb)
            a, b = strict_cast(to_column(left, schema), ta, met), strict_cast(to_column(right, schema), tb, met)
            if met == NULL:
                return F.lit(None).cast("boolean" if op in COMPARISONS + ORDERINGS else "void")
            return _operator(op, a, b, met)
        case IsNull(of, negated):
            c = to_column(of, schema)
            return c.isNotNull() if negated else c.isNull()
        case Cast(of, to):
            return strict_cast(to_column(of, schema), type_of(of, schema), to)
        case Coalesce(of):
            met = type_of(e, schema)
            return F.coalesce(*[strict_cast(to_column(x, schema), type_of(x, schema), met) for x in of])
    return fail(Category.INVALID_PLAN, "no such expression")


def _boolean(e: Expr, schema: LogicalSchema) -> Column:
    return to_column(e, schema).cast("boolean")


def _operator(op: str, a: Column, b: Column, met: LogicalType) -> Column:
    match op:
        case "equal":
            return a == b
        case "not_equal":
            return a != b
        case "less_than":
            return a < b
        case "less_than_or_equal":
            return a <= b
        case "greater_than":
            return a > b
        case "greater_than_or_equal":
            return a >= b
    if met.integer:
        narrow = spark_type(met)
        if op == "divide":
            quotient = F.call_function("div", a, b) if met.kind != "uint64" else F.call_function("floor", a / b)
            return _bounded(quotient, met).cast(narrow)
        if op == "modulo":
            return (a % b).cast(narrow)
        return _bounded({"add": a + b, "subtract": a - b, "multiply": a * b}[op], met).cast(narrow)
    out = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": a / b, "modulo": a % b}[op]
    finite = out.isNull() | ~(F.isnan(out) | (F.abs(out) == float("inf"))) | F.isnan(a) | F.isnan(b)
    return F.when(finite, out).otherwise(raised(Category.INVALID_DATA, "a result isn't finite")).cast(spark_type(met))


def _bounded(c: Column, t: LogicalType) -> Column:
    """Unsigned results below zero or beyond the type fail the run; signed ones overflow in Spark."""
    if t.kind not in ("uint8", "uint16", "uint32", "uint64"):
        return c
    return F.when(c.isNull() | _in_range(c, t), c).otherwise(raised(Category.INVALID_DATA, "an arithmetic result is out of range"))


def predicate(e: Expr, schema: LogicalSchema) -> Column:
    """A checked boolean column."""
    guard(e)
    if type_of(e, schema) not in (BOOLEAN, NULL):
        fail(Category.TYPE_ERROR, "a predicate must be a boolean")
    return _boolean(e, schema)
