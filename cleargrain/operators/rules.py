"""Cleaning rules: each changes the schema first, and then the DataFrame by built-in functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.errors import Category, fail, raised
from cleargrain.functions.expressions import Lit, castable, guard, nullable, predicate, quoted, strict_cast, to_column, try_cast, type_of
from cleargrain.plans.model import CastColumn, DeriveColumn, DropColumn, FillNull, FilterRows, Rename, ReplaceLiteral, Rule, Trim
from cleargrain.plans.types import LogicalField, LogicalSchema, spark_type

#: All Unicode white space at either end.
EDGES = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def _literal_fits(value: Lit, f: LogicalField) -> bool:
    """Whether a literal may stand in a column: an int64 in any signed one, a uint64 in any unsigned, a float in any float."""
    kind, t = value.kind, f.type
    if kind == "null":
        return True
    return (
        (kind == "boolean" and t.kind == "boolean")
        or (kind == "utf8" and t.kind == "utf8")
        or (kind == "float64" and t.kind in ("float32", "float64"))
        or (kind == "int64" and t.kind.startswith("int") and -(1 << (int(t.kind[3:]) - 1)) <= value.value < 1 << (int(t.kind[3:]) - 1))
        or (kind == "uint64" and t.kind.startswith("uint") and value.value < 1 << int(t.kind[4:]))
    )


def _constant(e) -> Lit:
    if not isinstance(e, Lit):
        fail(Category.INVALID_PLAN, "a rule's value must be a literal")
    guard(e)
    return e


def schema_after(schema: LogicalSchema, rule: Rule) -> LogicalSchema:
    """The schema after the rule; fails if the rule doesn't go with the schema."""

    def changed(id: str, **how) -> LogicalSchema:
        schema.by_id(id)
        return replace(schema, fields=tuple(replace(f, **how) if f.id == id else f for f in schema.fields))

    match rule:
        case Rename(id, to):
            if any(f.name == to and f.id != id for f in schema.fields):
                fail(Category.INVALID_PLAN, "a column name repeats")
            return changed(id, name=to)
        case DropColumn(id):
            schema.by_id(id)
            if len(schema.fields) == 1:
                fail(Category.INVALID_PLAN, "the last column can't be dropped")
            return replace(schema, fields=tuple(f for f in schema.fields if f.id != id))
        case Trim(id):
            if schema.by_id(id).type.kind != "utf8":
                fail(Category.TYPE_ERROR, "only text can be trimmed")
            return schema
        case CastColumn(id, to, policy):
            f = schema.by_id(id)
            if not castable(f.type, to):
                fail(Category.TYPE_ERROR, "no such cast")
            return changed(id, type=to, nullable=f.nullable or policy == "set_null")
        case ReplaceLiteral(id, old, new):
            f, a, b = schema.by_id(id), _constant(old), _constant(new)
            if not f.type.executable or (f.type.kind == "binary" and (a.kind, b.kind) != ("null", "null")) or not (_literal_fits(a, f) and _literal_fits(b, f)):
                fail(Category.TYPE_ERROR, "a literal doesn't fit its column")
            if b.kind == "null":
                return changed(id, nullable=True)
            return changed(id, nullable=False) if a.kind == "null" else schema
        case FillNull(id, value):
            f, v = schema.by_id(id), _constant(value)
            if v.kind == "null" or f.type.kind == "binary" or not f.type.executable or not _literal_fits(v, f):
                fail(Category.TYPE_ERROR, "a literal doesn't fit its column")
            return changed(id, nullable=False)
        case DeriveColumn(id, name, declared, expression, may_be_null):
            guard(expression)
            if any(f.id == id or f.name == name for f in schema.fields):
                fail(Category.INVALID_PLAN, "a column's id or name repeats")
            found = type_of(expression, schema)
            if found != declared and found.kind != "null":
                fail(Category.TYPE_ERROR, "a derived column isn't of its declared type")
            if nullable(expression, schema) and not may_be_null:
                fail(Category.TYPE_ERROR, "a derived column may be null")
            return replace(schema, fields=(*schema.fields, LogicalField(id, name, declared, may_be_null)))
        case FilterRows(p):
            predicate(p, schema)
            return schema
    return fail(Category.UNSUPPORTED, f"{type(rule).__name__} needs a verification run")


def value_after(schema: LogicalSchema, rule: Rule) -> tuple[str, Column] | None:
    """The name and the new value of the column that the rule sets, if it sets one."""
    match rule:
        case Trim(id):
            c = quoted(name := schema.by_id(id).name)
            return name, F.regexp_replace(c, EDGES, "")
        case CastColumn(id, to, policy):
            f = schema.by_id(id)
            return f.name, (strict_cast if policy == "error" else try_cast)(quoted(f.name), f.type, to)
        case ReplaceLiteral(id, old, new):
            f = schema.by_id(id)
            c, t = quoted(f.name), spark_type(f.type)
            if old.kind == "null":
                return f.name, c if new.kind == "null" else F.coalesce(c, to_column(new, schema).cast(t))
            made = F.lit(None).cast(t) if new.kind == "null" else to_column(new, schema).cast(t)
            return f.name, F.when(c == to_column(old, schema).cast(t), made).otherwise(c)
        case FillNull(id, value):
            f = schema.by_id(id)
            return f.name, F.coalesce(quoted(f.name), to_column(value, schema).cast(spark_type(f.type)))
        case DeriveColumn(_, name, declared, expression, _):
            return name, to_column(expression, schema).cast(spark_type(declared))
    return None


def _checked(df: DataFrame, schema: LogicalSchema, rule: Rule) -> DataFrame:
    """A strict cast fails the run even if its column is dropped later: a filter stays where a column is pruned."""
    if not isinstance(rule, CastColumn) or rule.on_failure != "error":
        return df
    f = schema.by_id(rule.column)
    if f.type == rule.type:
        return df
    c = quoted(f.name)
    bad = c.isNotNull() & try_cast(c, f.type, rule.type).isNull()
    return df.where(F.when(bad, raised(Category.CAST_FAILURE, "a value can't be cast").cast("boolean")).otherwise(True))


def apply_rule(df: DataFrame, schema: LogicalSchema, rule: Rule) -> tuple[DataFrame, LogicalSchema]:
    after = schema_after(schema, rule)
    match rule:
        case Rename(id, to):
            old = schema.by_id(id).name
            return df.select(*[quoted(f.name).alias(to) if f.name == old else quoted(f.name) for f in schema.fields]), after
        case DropColumn():
            return df.select(*[quoted(f.name) for f in after.fields]), after
        case FilterRows(p):
            return df.where(predicate(p, schema)), after
    name, value = value_after(schema, rule)
    df = _checked(df, schema, rule)
    if isinstance(rule, DeriveColumn):
        return df.select(*[quoted(f.name) for f in schema.fields], value.alias(name)), after
    return df.select(*[value.alias(name) if f.name == name else quoted(f.name) for f in schema.fields]), after
