"""Plans compiled to DataFrames. Types are settled here; the physical strategy is left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame

from cleargrain.errors import Category, fail
from cleargrain.functions.expressions import predicate, quoted, strict_cast, to_column, type_of
from cleargrain.operators.rules import apply_rule
from cleargrain.plans.model import ApplyRules, Filter, Join, Materialize, Node, Plan, Project, Scan, Union
from cleargrain.plans.types import LogicalSchema, lub

#: An asset's name -> its rows and schema.
Sources = Callable[[str], tuple[DataFrame, LogicalSchema]]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    schema: LogicalSchema


def compile_plan(plan: Plan, sources: Sources, target: str | None = None) -> Relation:
    """The relation of the plan's root, or of `target`; only what it reads is compiled."""
    target = target or plan.root
    if target not in plan.nodes:
        fail(Category.NOT_FOUND, "no such node")
    if target == plan.root and not isinstance(plan.nodes[target], Materialize):
        fail(Category.INVALID_PLAN, "a plan ends in Materialize")
    wanted, stack = set(), [target]
    while stack:
        if (at := stack.pop()) not in wanted:
            wanted.add(at)
            stack.extend(plan.nodes[at].inputs)
    done: dict[str, Relation] = {}
    for name in plan.order:
        if name in wanted:
            done[name] = _compile(plan.nodes[name], [done[i] for i in plan.nodes[name].inputs], sources)
    return done[target]


def _select(r: Relation, ids: tuple[str, ...]) -> Relation:
    fields = tuple(r.schema.by_id(i) for i in ids)
    return Relation(r.df.select(*[quoted(f.name) for f in fields]), replace(r.schema, fields=fields))


def scan(node: Scan, sources: Sources) -> Relation:
    out = _select(Relation(*sources(node.asset)), node.projection)
    return Relation(out.df.where(predicate(node.predicate, out.schema)), out.schema) if node.predicate is not None else out


def _compile(node: Node, inputs: list[Relation], sources: Sources) -> Relation:
    match node:
        case Scan():
            return scan(node, sources)
        case Project(_, columns):
            return _select(inputs[0], columns)
        case Filter(_, p):
            return Relation(inputs[0].df.where(predicate(p, inputs[0].schema)), inputs[0].schema)
        case ApplyRules(_, rules):
            df, schema = inputs[0].df, inputs[0].schema
            for rule in rules:
                df, schema = apply_rule(df, schema, rule)
            return Relation(df, schema)
        case Join(_, how, keys):
            return _join(inputs[0], inputs[1], how, keys)
        case Union():
            return reduce(_union, inputs)
        case Materialize():
            return inputs[0]
    return fail(Category.UNSUPPORTED, "no such node")


def _join(left: Relation, right: Relation, how: str, keys) -> Relation:
    """Equal keys after casts to their least common type; null keys match nothing. Left fields, then right fields."""
    if how not in ("semi", "anti"):
        ids, names = {f.id for f in left.schema.fields}, {f.name for f in left.schema.fields}
        if any(f.id in ids or f.name in names for f in right.schema.fields):
            fail(Category.INVALID_PLAN, "the sides of a join share a column id or name")
    ls, rs = [], []
    l, r = left.df, right.df
    for i, (a, b) in enumerate(keys):
        ta, tb = type_of(a, left.schema), type_of(b, right.schema)
        met = lub(ta, tb)
        if met is None or met.kind in ("null", "binary", "list", "struct"):
            fail(Category.TYPE_ERROR, "join keys have no common type")
        l = l.withColumn(f"__left_{i}", strict_cast(to_column(a, left.schema), ta, met))
        r = r.withColumn(f"__right_{i}", strict_cast(to_column(b, right.schema), tb, met))
        ls.append(f"__left_{i}")
        rs.append(f"__right_{i}")
    condition = reduce(lambda x, y: x & y, [quoted(a) == quoted(b) for a, b in zip(ls, rs, strict=True)])
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    joined = l.join(r, condition, kind)
    sides = left.schema.fields if how in ("semi", "anti") else tuple(
        replace(f, nullable=f.nullable or how in (("right", "full") if own == 0 else ("left", "full"))) for own, s in enumerate((left, right)) for f in s.schema.fields
    )
    return Relation(joined.select(*[quoted(f.name) for f in sides]), replace(left.schema, fields=tuple(sides)))


def _union(a: Relation, b: Relation) -> Relation:
    """All rows of both; columns by position, with the first input's ids and names."""
    if len(a.schema.fields) != len(b.schema.fields):
        fail(Category.INVALID_PLAN, "the inputs of a union differ in width")
    fields, left, right = [], [], []
    for x, y in zip(a.schema.fields, b.schema.fields, strict=True):
        met = lub(x.type, y.type)
        if met is None:
            fail(Category.TYPE_ERROR, "the inputs of a union have no common type")
        fields.append(replace(x, type=met, nullable=x.nullable or y.nullable))
        left.append(strict_cast(quoted(x.name), x.type, met).alias(x.name))
        right.append(strict_cast(quoted(y.name), y.type, met).alias(x.name))
    return Relation(a.df.select(*left).union(b.df.select(*right)), replace(a.schema, fields=tuple(fields)))
